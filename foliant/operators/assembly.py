"""Books put together from page spans (T18, T19), endnotes from chapters of notes (T5), upserts of drafted entries.

A page comes as spans: doc_id, page_no, page_label, block_no, line_no, span_no, text, size, superscript. Lines, blocks and pages
are grouped by their own keys, so no group is larger than a page; only note continuation and section text look at a book."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliant.functions.text import flattened, is_bibliography_heading
from foliant.operators import notes as N
from foliant.operators import pages as P
from foliant.operators.carry import carried

# Titles before which all is front matter; note starts; labels of note sections.
BODY_START = r"(?i)^\s*(\d+[.\s]|introduction\b|prologue\b|part\b|chapter\b)"
NOTE_START = r"(?s)^(\d+)\.?\s+(.*)$"
CHAPTER_LABEL = r"(?i)^chapter\s+(\d+)"
NUMBERED_HEADING = r"^(\d+)\s*\|"
FRONT = "introduction foreword preface prologue epilogue conclusion afterword".split()
NOTES_HEADING = r"(?i)^(?:end)?notes$"


def block_texts(spans: DataFrame, with_anchors: Column) -> DataFrame:
    """doc_id, page_no, page_label, block_no, plain, body, size: PJ6, PJ7, A2. `body` has raised digits as anchors
    `[^p{label}-n{number}]` where `with_anchors` holds."""
    digits = F.trim("text")
    anchor = F.concat(F.lit("[^p"), F.col("page_label"), F.lit("-n"), digits, F.lit("]"))
    marked = F.when(with_anchors & F.col("superscript") & digits.rlike("^[0-9]+$"), anchor).otherwise(F.col("text"))
    rows = spans.select("doc_id", "page_no", "page_label", "block_no", "line_no", "span_no", F.col("text").alias("t"), marked.alias("m"))
    joined = lambda c: F.transform(F.array_sort(F.collect_list(F.struct("span_no", c))), lambda x: x[c])
    by = ["doc_id", "page_no", "page_label", "block_no"]
    lines = rows.groupBy(*by, "line_no").agg(F.array_join(joined("t"), "").alias("t"), F.array_join(joined("m"), "").alias("m"))
    stacked = lambda c: F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", c))), lambda x: x[c]), "\n")
    blocks = lines.groupBy(*by).agg(flattened(stacked("t")).alias("plain"), flattened(stacked("m")).alias("body"))
    return blocks.join(P.dominant_size(spans, "doc_id", "page_no", "block_no"), ["doc_id", "page_no", "block_no"])


def assembled(spans: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(paragraphs, notes) of each book: T18. Paragraphs: doc_id, page_no, block_no, text; notes: doc_id, page_no, ref, text.

    Furniture goes unless it is a heading; wrapped headings are joined; small blocks are notes unless a whole page is small;
    lines of notes without a number go on with the last note of this page or the one before, else they are text."""
    profile = P.font_profile(spans)
    sized = spans.join(profile.select("doc_id", F.col("note_size").isNotNull().alias("noted")), "doc_id")
    blocks = block_texts(sized, F.col("noted"))
    keys = P.furniture(blocks.withColumnRenamed("plain", "text").select("doc_id", "page_no", "block_no", "text"))
    rows = blocks.join(profile, "doc_id").withColumn("heading", F.col("size") > F.col("body_size") + P.HEADING_MARGIN).drop("body_size", "note_size")
    small = P.without_furniture(rows.where("not heading"), keys, text="plain")
    kept = P.block_roles(small.unionByName(rows.where("heading")).where("plain <> ''"), profile)
    heads = P.merged_headings(kept.where("is_heading")).groupBy("doc_id", "page_no", F.col("heading_no").alias("block_no")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("block_no", "body"))), lambda x: x["body"]), " ").alias("text"))
    body = kept.where("not is_heading and not is_note_kept").select("doc_id", "page_no", "block_no", F.col("body").alias("text"))
    of_notes = kept.where("is_note_kept").select("doc_id", "page_no", "block_no")
    lines = spans.join(of_notes, ["doc_id", "page_no", "block_no"]).groupBy("doc_id", "page_no", "page_label", "block_no", "line_no").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("span_no", "text"))), lambda x: x["text"]), "").alias("raw"))
    lines = lines.withColumn("text", flattened("raw")).where("text <> ''").withColumn("at", F.struct("block_no", "line_no"))
    number = F.regexp_extract("text", NOTE_START, 1)
    opened = N.continued_notes(lines, "doc_id", "page_no", "at", F.when(number != "", number))
    loose = opened.where("note_page is null").select("doc_id", "page_no", "block_no", "text")
    part = F.struct("page_no", "at", F.when(number != "", F.regexp_extract("text", NOTE_START, 2)).otherwise(F.col("text")).alias("t"), number.alias("n"), F.col("page_label").alias("l"))
    found = opened.where("note_page is not null").groupBy("doc_id", "note_page", "note_line").agg(F.array_sort(F.collect_list(part)).alias("p"))
    ref = F.concat(F.lit("p"), F.col("p")[0]["l"], F.lit("-n"), F.col("p")[0]["n"])
    notes = found.select("doc_id", F.col("note_page").alias("page_no"), ref.alias("ref"), flattened(F.array_join(F.transform("p", lambda x: x["t"]), " ")).alias("text"))
    return body.unionByName(heads).unionByName(loose).where("text <> ''"), notes


def split_sections(paragraphs: DataFrame, notes: DataFrame, outline: DataFrame, last_pages: DataFrame) -> DataFrame:
    """doc_id, section_idx, title, text, footnotes: T19, W1-W4, J6, J7. `outline`: doc_id, entry_no, level, title, page;
    `last_pages`: doc_id, last_page. Leaves that advance begin sections, what stands before the first one that looks like
    the body is front matter, a book without outline is one section "Text"; empty sections go (F24)."""
    leaves = P.outline_leaves(outline).join(last_pages, "doc_id").where(F.col("page").between(1, F.col("last_page")))
    starts = P.advancing(leaves.select("doc_id", "entry_no", F.trim(F.regexp_replace("title", r"\s+", " ")).alias("title"), "page"), "doc_id", "entry_no", "page")
    first = starts.groupBy("doc_id").agg(F.min(F.when(F.col("title").rlike(BODY_START), F.col("entry_no"))).alias("first"), F.min("entry_no").alias("least"))
    body = starts.join(first, "doc_id").where("first is null or entry_no >= first").select("doc_id", "entry_no", "title", "page")
    front = first.where("first > least").select("doc_id", F.lit(-1).cast("int").alias("entry_no"), F.lit("Front matter").alias("title"), F.lit(1).alias("page"))
    whole = last_pages.join(starts.select("doc_id").distinct(), "doc_id", "left_anti").select("doc_id", F.lit(0).alias("entry_no"), F.lit("Text").alias("title"), F.lit(1).alias("page"))
    bounds = body.unionByName(front).unionByName(whole).join(last_pages, "doc_id")
    sections = P.section_bounds(bounds, "doc_id", "entry_no", "page", F.col("last_page")).select("doc_id", "entry_no", "title", F.col("page").alias("start_page"), "end_page")
    texts = P.in_page_range(paragraphs, sections, "doc_id", "page_no", "start_page", "end_page").groupBy("doc_id", "entry_no").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page_no", "block_no", "text"))), lambda x: x["text"]), "\n\n").alias("text"))
    listed = P.in_page_range(notes, sections, "doc_id", "page_no", "start_page", "end_page").groupBy("doc_id", "entry_no").agg(F.transform(F.array_sort(F.collect_list(F.struct("page_no", "ref", "text"))), lambda x: F.struct(x["ref"].alias("ref"), x["text"].alias("text"))).alias("footnotes"))
    out = sections.join(texts, ["doc_id", "entry_no"], "left").join(listed, ["doc_id", "entry_no"], "left").where("text <> '' or size(footnotes) > 0")
    return out.select("doc_id", F.col("entry_no").alias("section_idx"), "title", F.coalesce("text", F.lit("")).alias("text"), "footnotes", is_bibliography_heading("title").alias("is_bibliography"))


def section_label(text: Column, heading: bool = False) -> Column:
    """The section a label or heading names: `chapter-4`, or the name of a front section; null for none."""
    number = F.regexp_extract(text, NUMBERED_HEADING if heading else CHAPTER_LABEL, 1)
    return F.when(number != "", F.concat(F.lit("chapter-"), number)).when(F.lower(text).isin(*FRONT), F.lower(text))


def endnotes(blocks: DataFrame) -> DataFrame:
    """doc_id, section, number, ref, text: T5, W8. `blocks`: doc_id, file_no, unit_no, tag, text. In files whose first heading is
    "Notes", a label sets the section and ends the open note, a numbered paragraph opens a note, others go on with it on a
    line of their own; of one section and number the last holds."""
    head = blocks.where(F.col("tag").isin("h1", "h2", "h3")).groupBy("doc_id", "file_no").agg(F.min_by("text", "unit_no").alias("head"))
    rows = blocks.where("tag = 'p' and text <> ''").join(head.where(F.col("head").rlike(NOTES_HEADING)).select("doc_id", "file_no"), ["doc_id", "file_no"])
    label = section_label(F.col("text"))
    number = F.when(label.isNull(), F.nullif(F.regexp_extract("text", NOTE_START, 1), F.lit("")))
    filled = carried(rows.withColumns({"label": label, "number": number}), ["doc_id"], ["file_no", "unit_no"], {"section": ("last", F.col("label")), "labels": ("sum", F.col("label").isNotNull().cast("bigint"))})
    opens = F.when(F.col("number").isNotNull() & F.col("section").isNotNull(), F.struct("labels", "file_no", "unit_no", "number"))
    noted = carried(filled.withColumn("opens", opens), ["doc_id"], ["file_no", "unit_no"], {"note": ("last", F.col("opens"))})
    # A note of an earlier label is closed.
    inside = noted.where("label is null and note.labels = labels")
    text = F.when(F.col("opens").isNotNull(), F.regexp_extract("text", NOTE_START, 2)).otherwise(F.col("text"))
    notes = inside.groupBy("doc_id", "section", "note").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("file_no", "unit_no", text.alias("t")))), lambda x: x["t"]), "\n").alias("text"))
    last = notes.groupBy("doc_id", "section", F.col("note.number").alias("number")).agg(F.max_by("text", F.struct("note.file_no", "note.unit_no")).alias("text"))
    return last.select("doc_id", "section", "number", F.concat(F.col("section"), F.lit("-n"), F.col("number")).alias("ref"), "text")


def anchored_endnotes(anchors: DataFrame, headings: DataFrame, notes: DataFrame) -> DataFrame:
    """doc_id, file_no, place, ref: J3, W9. `anchors`: doc_id, file_no, place, number; `headings`: doc_id, file_no, text (null without one). The
    section of a file is that of its heading, else of the file before."""
    of_file = carried(headings.withColumn("own", section_label(F.col("text"), heading=True)), ["doc_id"], ["file_no"], {"section": ("last", F.col("own"))})
    placed = anchors.join(of_file.select("doc_id", "file_no", "section"), ["doc_id", "file_no"])
    return placed.join(notes.select("doc_id", "section", "number", "ref"), ["doc_id", "section", "number"]).select("doc_id", "file_no", "place", "ref")


def upserted(current: DataFrame, new: DataFrame, key: str = "siglum", value: str = "spoken") -> DataFrame:
    """SK6: the current entries, with new ones added; a resolved entry is never changed, a stub only by a resolved one."""
    a = current.select(key, F.col(value).alias("__a"), F.lit(True).alias("__in"))
    b = new.select(key, F.col(value).alias("__b"))
    resolved = lambda c: F.coalesce(F.col(c) != "", F.lit(False))
    return a.join(b, key, "full").select(key, F.when(F.col("__in") & (resolved("__a") | ~resolved("__b")), F.col("__a")).otherwise(F.col("__b")).alias(value))


def drafted_lexicon(existing: DataFrame, found: DataFrame, counts: DataFrame) -> DataFrame:
    """term, mechanism, value, n: SK17. New terms only, the first answer of each, the most frequent first; `found` holds
    term, order, mechanism, value, `counts` term and n."""
    first = found.groupBy("term").agg(F.min_by(F.struct("mechanism", "value"), "order").alias("x"), F.min("order").alias("order"))
    rows = first.join(existing.select("term"), "term", "left_anti").join(counts.select("term", "n"), "term", "left")
    return rows.select("term", "x.mechanism", "x.value", F.coalesce("n", F.lit(0)).alias("n"), "order").orderBy(F.desc("n"), "order").drop("order")
