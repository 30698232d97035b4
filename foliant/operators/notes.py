"""Notes and anchors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliant.functions.text import anchors
from foliant.operators.carry import carried


def anchor_rows(sections: DataFrame, key: str = "section_id", text: str = "text") -> DataFrame:
    """`key`, anchor_no, ref: one row per anchor, in order from 0."""
    return sections.select(key, F.posexplode(anchors(text)).alias("anchor_no", "ref"))


def note_rows(sections: DataFrame, key: str = "section_id", notes: str = "footnotes") -> DataFrame:
    """`key`, ref, note: the notes of each section; of notes with one ref the last one holds. Null arrays have none."""
    rows = sections.select(key, F.posexplode(notes).alias("__n", "__note"))
    return rows.groupBy(key, F.col("__note.ref").alias("ref")).agg(F.max_by("__note.text", "__n").alias("note"))


def anchored(anchor: DataFrame, notes: DataFrame, key: str = "section_id") -> DataFrame:
    """Anchors with their notes; unknown refs stay with a null note."""
    return anchor.join(notes, [key, "ref"], "left")


def leftover(anchor: DataFrame, notes: DataFrame, key: str = "section_id") -> DataFrame:
    """Notes that no anchor names."""
    return notes.join(anchor.select(key, "ref").distinct(), [key, "ref"], "left_anti")


def sections_naming(anchor: DataFrame, notes: DataFrame, doc: str) -> DataFrame:
    """Notes with every section of their document that names their ref: the refs are extracted and joined on, which
    is the text search without comparing each note with each text."""
    return notes.join(anchor.select(doc, "ref", F.col("section_id").alias("named_in")).distinct(), [doc, "ref"])


def pairing_gate(anchor: DataFrame, notes: DataFrame, doc: str) -> DataFrame:
    """`doc`, notes, anchored, kept: F8. A document's notes are kept if at least half of them are anchored."""
    hit = notes.join(anchor.select(doc, "ref").distinct().withColumn("__hit", F.lit(1)), [doc, "ref"], "left")
    counted = hit.groupBy(doc).agg(F.count("*").alias("notes"), F.count("__hit").alias("anchored"))
    return counted.withColumn("kept", 2 * F.col("anchored") >= F.col("notes"))


def continued_notes(lines: DataFrame, doc: str, page: str, line: str, number: Column, gap: int = 1) -> DataFrame:
    """Adds note_page and note_line, of the line that opened the note: W7. A line without number goes on with the last
    note if that began at most `gap` pages before; otherwise both are null, a leftover."""
    opener = F.when(number.isNotNull(), F.struct(F.col(page).alias("p"), F.col(line).alias("l")))
    near = carried(lines, [doc], [page, line], {"__open": ("last", opener)}).withColumn("__open", F.when(F.col(page) - F.col("__open.p") <= gap, F.col("__open")))
    return near.select(*lines.columns, F.col("__open.p").alias("note_page"), F.col("__open.l").alias("note_line"))


def reciprocal_links(links: DataFrame, source: str = "source", target: str = "target") -> DataFrame:
    """`a`, `b`, a < b: J8. Pairs that link to each other, by grouping the canonical pair: no self join."""
    real = links.where(F.col(source) != F.col(target)).select(F.least(source, target).alias("a"), F.greatest(source, target).alias("b"), (F.col(source) < F.col(target)).alias("__up")).distinct()
    return real.groupBy("a", "b").agg(F.count("*").alias("__n")).where("__n = 2").select("a", "b")
