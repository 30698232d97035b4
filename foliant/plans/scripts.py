"""Ordered transforms and citations over whole tables. SQL cannot say them; tests hold them against golden cases."""

from __future__ import annotations

from pyspark.sql import functions as F

from foliant.catalogue import query
from foliant.functions.vocabularies import vocabulary
from foliant.operators import citations as C
from foliant.operators import scripts as X
from foliant.operators import sections as S
from foliant.plans.base import once


def _sections(spark, folder):
    return once(spark, folder, "sections", "section_id", "text", "footnotes").where("text is not null")


def _utterances(spark, folder):
    return once(spark, folder, "utterances", "utt_id", "text", "lang").where("text is not null")


@query("mend_seams")
def mend_seams(spark, folder):
    parts = F.filter(F.split("text", "\n\n", -1), lambda p: F.trim(F.regexp_replace(p, r"\s", " ")) != "")
    return X.spread(_sections(spark, folder), ["section_id"], X.mended_column(parts), "paragraph_no", "paragraph")


@query("weave_notes")
def weave_notes(spark, folder):
    rows = _sections(spark, folder)
    paragraphs = S.paragraphs(rows)
    notes = F.coalesce("footnotes", F.expr("array()").cast("array<struct<ref:string,text:string>>"))
    return X.spread(paragraphs, ["section_id", "paragraph_no"], X.woven_column("paragraph", notes), "piece_no", "p").select("section_id", "paragraph_no", "piece_no", "p.text", "p.manner", "p.ref")


@query("script_runs")
def script_runs(spark, folder):
    return X.spread(_utterances(spark, folder), ["utt_id"], X.tagged_column("text", F.coalesce("lang", F.lit("en"))), "piece_no", "p").select("utt_id", "piece_no", "p.text", "p.lang")


@query("breath_points")
def breath_points(spark, folder):
    return _utterances(spark, folder).where("lang = 'en'").select("utt_id", X.pointed_column("text").alias("text"))


@query("sentence_chunks")
def sentence_chunks(spark, folder):
    return X.spread(_utterances(spark, folder), ["utt_id"], X.chunked_column("text"), "chunk_no", "chunk")


@query("line_batches")
def line_batches(spark, folder):
    rows = once(spark, folder, "documents", "doc_id", "text").where("text is not null")
    return X.spread(rows, ["doc_id"], X.batched_column("text"), "batch_no", "batch")


def _cited(spark, folder):
    """Citations written out: the locators of the pairings behind sigla of the vocabulary, dealt by key, with the forms
    that are no citations among them (no space, two spaces, a line end)."""
    sigla = [e[3] for e in vocabulary()]
    rows = once(spark, folder, "pairings", "pairing_id", "citations").select("pairing_id", F.posexplode("citations").alias("n", "c")).where("c.locator is not null")
    deal = F.pmod(F.col("pairing_id") * 7 + F.col("n"), F.lit(len(sigla)))
    siglum = F.element_at(F.array(*[F.lit(s) for s in sigla]), deal.cast("int") + 1)
    gap = F.element_at(F.array(*[F.lit(g) for g in (" ", ". ", ", ", "", "  ", "\n", " ")]), (F.pmod("pairing_id", F.lit(7)) + 1).cast("int"))
    text = F.concat(F.lit("See "), siglum, gap, F.col("c.locator"), F.lit("; 9:2, and the rest."))
    return rows.select((F.col("pairing_id") * 10 + F.col("n")).alias("cite_id"), text.alias("text"))


@query("citation_scan")
def citation_scan(spark, folder):
    return C.citations(_cited(spark, folder), "cite_id")


@query("citation_speak")
def citation_speak(spark, folder):
    return _cited(spark, folder).select("cite_id", "text", C.spoken(F.col("text")).alias("spoken"))


@query("near_miss")
def near_miss(spark, folder):
    return C.near_misses(_cited(spark, folder), "cite_id")


@query("spoken_utterances")
def spoken_utterances(spark, folder):
    return _utterances(spark, folder).select("utt_id", C.spoken(F.col("text")).alias("text"))
