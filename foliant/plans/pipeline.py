"""The chain of layers from sections to speakable utterances, in one plan without a shuffle after the first read.

mend -> weave or drop the notes -> speak citations -> tag scripts -> point breaths; then what is recited: chunks, pauses."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliant.catalogue import query
from foliant.functions.text import is_apparatus
from foliant.operators import citations as C
from foliant.operators import providers as V
from foliant.operators import relations as R
from foliant.operators import scripts as X
from foliant.plans.base import once

NO_NOTES = "cast(array() as array<struct<ref:string,text:string>>)"


def redacted(sections: DataFrame, verbatim_notes: bool = False) -> DataFrame:
    """section_id, utt_idx, text, manner, lang of sections (section_id, text, footnotes): the book variant drops the notes,
    `verbatim_notes` weaves them in as digressions."""
    notes = F.coalesce("footnotes", F.expr(NO_NOTES)) if verbatim_notes else F.expr(NO_NOTES)
    parts = F.filter(F.split("text", "\n\n", -1), lambda p: F.trim(F.regexp_replace(p, r"\s", " ")) != "")
    mended = X.spread(sections.where("text is not null").withColumn("notes", notes), ["section_id", "notes"], X.mended_column(parts), "p", "paragraph")
    woven = X.spread(mended, ["section_id", "p"], X.woven_column(F.col("paragraph"), F.col("notes")), "w", "piece")
    spoken = woven.select("section_id", "p", "w", "piece.manner", C.spoken(F.col("piece.text")).alias("text"))
    tagged = X.spread(spoken, ["section_id", "p", "w", "manner"], X.tagged_column(F.col("text"), F.lit("en")), "t", "x")
    text = F.when(F.col("x.lang") == "en", X.pointed_column(F.col("x.text"))).otherwise(F.col("x.text"))
    order = F.col("p").cast("bigint") * 1_000_000 + F.col("w").cast("bigint") * 1_000 + F.col("t")
    return tagged.select("section_id", order.alias("utt_idx"), text.alias("text"), "manner", F.col("x.lang").alias("lang"))


def recited(utterances: DataFrame, by: list[str]) -> DataFrame:
    """`by`, utt_idx, pause, chunks: what a reciter is given (C5), with the pause before each utterance in seconds."""
    plan = R.pauses(utterances, by, "utt_idx", F.trim("text") != "")
    return plan.select(*by, "utt_idx", "lang", "pause", X.chunked_column(F.col("text")).alias("chunks"))


def _sections(spark, folder):
    return once(spark, folder, "sections", "section_id", "title", "text", "footnotes").where(~F.coalesce(is_apparatus("title"), F.lit(False)))


@query("book_script")
def book_script(spark, folder):
    return redacted(_sections(spark, folder))


@query("verbatim_script")
def verbatim_script(spark, folder):
    return redacted(_sections(spark, folder), verbatim_notes=True)


@query("recite_plan")
def recite_plan(spark, folder):
    return recited(redacted(_sections(spark, folder)), ["section_id"])


@query("glossed_paragraphs")
def glossed_paragraphs(spark, folder):
    rows = _sections(spark, folder).where("text is not null").select("section_id", F.posexplode(F.split("text", "\n\n", -1)).alias("p", "paragraph"), F.col("footnotes").alias("notes"))
    named = rows.select((F.col("section_id") * 100_000 + F.col("p")).alias("paragraph_id"), "paragraph", F.filter("notes", lambda n: F.contains(F.col("paragraph"), F.concat(F.lit("[^"), n["ref"], F.lit("]")))).alias("notes"))
    return V.glossed(named, "paragraph_id", V.Offline())


@query("interpreted_utterances")
def interpreted_utterances(spark, folder):
    switches = once(spark, folder, "switches", "switch_id", "utt_id", "text", "lang").groupBy("utt_id").agg(F.array_sort(F.collect_list(F.struct("switch_id", "text", "lang"))).alias("s"))
    utterances = once(spark, folder, "utterances", "utt_id", "text").where("text is not null")
    pieces = V.switched_column(F.col("text"), F.transform("s", lambda x: F.struct(x["text"].alias("text"), x["lang"].alias("lang"))))
    return X.spread(utterances.join(switches, "utt_id"), ["utt_id"], pieces, "piece_no", "p").select("utt_id", "piece_no", "p.text", "p.lang")
