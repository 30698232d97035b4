"""Pages and their furniture, faces, outlines and hanging entries.

Input tables are long: one row per block, span or line of a page, in the order of its number. Every operator groups by
document, and by page where it can, so no document is gathered; ties are broken by the first place.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliant.functions.text import is_page_number, repetition_key
from foliant.operators.carry import carried

# Fixed values.
SHORT_CHARS = 80
EDGE_PAGES = 3
HEADING_MARGIN = 1.0
INDENT_MARGIN = 2.0
NOTE_GAP, NOTE_SHARE = 0.5, 0.05


def furniture(blocks: DataFrame, doc: str = "doc_id", page: str = "page_no", block: str = "block_no", text: str = "text") -> DataFrame:
    """`doc`, key, scope (`everywhere`, `edge`): A3, A16, U1. Short blocks (80 characters at most) count once a page and
    text; `everywhere` keys come on max(3, pages // 20) pages, `edge` keys three times as a page's first or last block.
    Keys without letters and marks are dropped; blank blocks are no blocks. Both counts are partial aggregations."""
    rows = blocks.where(F.trim(text) != "").select(doc, page, block, F.col(text).alias("__text"))
    pages = blocks.groupBy(doc).agg(F.count_distinct(page).alias("pages"))
    short = F.length("__text") <= SHORT_CHARS
    distinct = rows.where(short).select(doc, page, "__text").distinct()
    counted = distinct.groupBy(doc, repetition_key("__text").alias("key")).agg(F.count("*").alias("n"))
    everywhere = counted.join(pages, doc).where((F.col("key") != "") & (F.col("n") >= F.greatest(F.lit(3), F.floor(F.col("pages") / 20)))).select(doc, "key", F.lit("everywhere").alias("scope"))
    edges = rows.groupBy(doc, page).agg(F.min_by("__text", block).alias("a"), F.max_by("__text", block).alias("b"))
    edges = edges.select(doc, F.explode(F.array_distinct(F.array("a", "b"))).alias("__text")).where(short)
    edge = edges.groupBy(doc, repetition_key("__text").alias("key")).agg(F.count("*").alias("n")).where((F.col("key") != "") & (F.col("n") >= EDGE_PAGES)).select(doc, "key", F.lit("edge").alias("scope"))
    return everywhere.unionByName(edge)


def without_furniture(blocks: DataFrame, keys: DataFrame, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """The blocks that are no page numbers (F3) and whose key is not furniture when short (F4): an anti join on
    (document, key); null texts stay."""
    drop = keys.select(doc, F.col("key").alias("__key")).distinct()
    keyed = blocks.withColumn("__key", F.when(F.length(text) <= SHORT_CHARS, repetition_key(text)))
    kept = keyed.join(drop, [doc, "__key"], "left_anti")
    return kept.where(~F.coalesce(is_page_number(text), F.lit(False))).select(*blocks.columns)


def _heaviest(weights: DataFrame, by: list[str], size: str, weight: str, first: str) -> DataFrame:
    """The heaviest size of each group, the first of several."""
    best = F.max_by(size, F.struct(F.col(weight), -F.col(first)))
    return weights.groupBy(*by).agg(best.alias(size), F.max(weight).alias(weight))


def font_profile(spans: DataFrame, doc: str = "doc_id") -> DataFrame:
    """`doc`, body_size, note_size: A1. Spans hold size, text, superscript, span_no. Sizes to one decimal weigh by the
    characters they set; the note size is the heaviest below body - 0.5, if it has a twentieth of the body's weight."""
    weights = spans.where(~F.col("superscript")).groupBy(doc, F.bround("size", 1).alias("size")).agg(F.sum(F.length("text")).alias("weight"), F.min("span_no").alias("first"))
    body = _heaviest(weights, [doc], "size", "weight", "first").select(doc, F.col("size").alias("body_size"), F.col("weight").alias("body_weight"))
    smaller = weights.join(body, doc).where(F.col("size") < F.col("body_size") - NOTE_GAP)
    note = _heaviest(smaller, [doc, "body_weight"], "size", "weight", "first").where(F.col("weight") >= F.col("body_weight") * NOTE_SHARE).select(doc, F.col("size").alias("note_size"))
    return body.join(note, doc, "left").select(doc, "body_size", "note_size")


def dominant_size(spans: DataFrame, *by: str) -> DataFrame:
    """`by`, size: A2, the heaviest size of each block; 0.0 where it has superscripts only."""
    plain = F.when(~F.col("superscript"), F.bround("size", 1))
    weights = spans.groupBy(*by, plain.alias("size")).agg(F.sum(F.length("text")).alias("weight"), F.min("span_no").alias("first"))
    weighed = weights.withColumn("weight", F.when(F.col("size").isNull(), F.lit(-1)).otherwise(F.col("weight")))
    return _heaviest(weighed, list(by), "size", "weight", "first").select(*by, F.coalesce("size", F.lit(0.0)).alias("size"))


def block_roles(sizes: DataFrame, profile: DataFrame, doc: str = "doc_id", page: str = "page_no") -> DataFrame:
    """Adds is_heading (F5), is_note (F6) and is_note_kept (F7: where every block that is no heading is a note, none is)."""
    joined = sizes.join(profile, doc)
    note = F.coalesce(F.abs(F.col("size") - F.col("note_size")) < F.abs(F.col("size") - F.col("body_size")), F.lit(False))
    roles = joined.withColumn("is_heading", F.col("size") > F.col("body_size") + HEADING_MARGIN).withColumn("is_note", note)
    whole = F.min((F.col("is_heading") | F.col("is_note")).cast("int")).over(Window.partitionBy(doc, page)) == 1
    return roles.withColumn("is_note_kept", F.col("is_note") & ~whole).drop("body_size", "note_size")


def merged_headings(roles: DataFrame, doc: str = "doc_id", page: str = "page_no", block: str = "block_no") -> DataFrame:
    """Adds heading_no: W6. Consecutive heading blocks of one size on a page are one heading, named by its first block."""
    order = Window.partitionBy(doc, page).orderBy(block)
    goes_on = F.col("is_heading") & (F.lag("size").over(order) == F.col("size"))
    start = F.when(~F.coalesce(goes_on, F.lit(False)), F.col(block))
    return roles.withColumn("heading_no", F.last(start, ignorenulls=True).over(order))


def outline_leaves(entries: DataFrame, doc: str = "doc_id", order: str = "entry_no", level: str = "level") -> DataFrame:
    """The entries whose next entry is not deeper: W2, on the outline as it is given."""
    after = F.lead(level).over(Window.partitionBy(doc).orderBy(order))
    return entries.withColumn("__next", after).where(F.col("__next").isNull() | (F.col("__next") <= F.col(level))).drop("__next")


def advancing(entries: DataFrame, doc: str, order: str, page: str) -> DataFrame:
    """The entries whose page is beyond all pages before: W3."""
    far = carried(entries, [doc], [order], {"__far": ("max", F.col(page))}, before=True)
    return far.where(F.col("__far").isNull() | (F.col(page) > F.col("__far"))).drop("__far")


def section_bounds(starts: DataFrame, doc: str, order: str, page: str, last: Column) -> DataFrame:
    """Adds end_page: W1, the page before the next start, not before the own one; the last section ends at `last`."""
    after = F.lead(page).over(Window.partitionBy(doc).orderBy(order))
    return starts.withColumn("end_page", F.greatest(F.coalesce(after - 1, last), F.col(page)))


def in_page_range(rows: DataFrame, sections: DataFrame, doc: str, page: str, start: str, end: str) -> DataFrame:
    """Rows with the section whose pages hold them: J6, J7. Sections of a document do not overlap, so the section is
    the last one that starts up to the page: an as-of join by a window over both, without a range join; rows outside
    their candidate's pages are dropped."""
    mine = [c for c in rows.columns]
    theirs = [c for c in sections.columns if c not in (doc,)]
    left = rows.select(F.col(doc), F.col(page).alias("__at"), F.lit(1).alias("__side"), F.struct(*mine).alias("__row"))
    right = sections.select(F.col(doc), F.col(start).alias("__at"), F.lit(0).alias("__side"), F.struct(*theirs).alias("__section"))
    both = left.unionByName(right, allowMissingColumns=True)
    found = carried(both, [doc], ["__at", "__side"], {"__found": ("last", F.col("__section"))})
    out = found.where((F.col("__side") == 1) & (F.col("__at") <= F.col(f"__found.{end}")))
    return out.select("__row.*", *[F.col(f"__found.{c}").alias(c) for c in theirs])


def hanging_entries(lines: DataFrame, doc: str, page: str, line: str, x: str) -> DataFrame:
    """Adds entry_no from 1: W5. A line at its page's margin (within 2.0) opens an entry, and so does the first line."""
    margin = F.min(x).over(Window.partitionBy(doc, page))
    marked = lines.withColumn("__opens", (F.col(x) <= margin + INDENT_MARGIN).cast("bigint"))
    # The first line opens an entry whatever its place: where it does not by itself, all numbers are one higher.
    first = marked.groupBy(doc).agg((1 - F.min_by("__opens", F.struct(page, line))).alias("__add"))
    counted = carried(marked, [doc], [page, line], {"entry_no": ("sum", F.col("__opens"))})
    return counted.join(first, doc).withColumn("entry_no", F.col("entry_no") + F.col("__add")).select(*[c for c in lines.columns if c != "entry_no"], "entry_no")


def forward_filled(rows: DataFrame, by: list[str], order: list[str], label: str, out: str) -> DataFrame:
    """Adds `out`: the last label that is not null up to the row."""
    return carried(rows, by, order, {out: ("last", F.col(label))})


def continued_entries(rows: DataFrame, by: list[str], order: list[str], done: Column) -> DataFrame:
    """Adds entry_no: W12. A row whose predecessor is not `done` continues it; a null is as good as done."""
    marked = carried(rows.withColumn("__done", F.coalesce(done, F.lit(True))), by, order, {"__before": ("last", F.col("__done"))}, before=True)
    opens = F.coalesce("__before", F.lit(True)).cast("bigint")
    return carried(marked, by, order, {"entry_no": ("sum", opens)}).drop("__done", "__before")
