"""Projections and predicates over text."""

from __future__ import annotations

from pyspark.sql import functions as F

from foliant.catalogue import query
from foliant.functions import text as T
from foliant.operators import sections as S
from foliant.plans.base import ANCHOR, INVISIBLE, SP, once, once_sql

SECTIONS = once_sql("sections", "section_id", "doc_id", "section_idx", "title", "text")
PARAGRAPHS = f"""(SELECT section_id, n - 1 AS paragraph_no, parts[n] AS paragraph
FROM (SELECT section_id, parts, unnest(range(1, len(parts) + 1)) AS n FROM (SELECT section_id, string_split(text, chr(10) || chr(10)) AS parts FROM {SECTIONS} WHERE text IS NOT NULL))
WHERE trim(regexp_replace(parts[n], '[\\s]', ' ', 'g')) <> '')"""


def paragraphs(spark, folder):
    return S.paragraphs(once(spark, folder, "sections", "section_id", "text")).drop("text")


@query("paragraph_explode", f"SELECT * FROM {PARAGRAPHS}")
def paragraph_explode(spark, folder):
    return paragraphs(spark, folder)


@query("whole_text", f"""
SELECT doc_id, string_agg(text, chr(10) || chr(10) ORDER BY section_idx, section_id) AS text FROM {SECTIONS} WHERE text <> '' GROUP BY doc_id""")
def whole_text(spark, folder):
    return S.whole_text(once(spark, folder, "sections", "section_id", "doc_id", "section_idx", "text"), ["doc_id"], ["section_idx", "section_id"])


@query("flatten_notes", """
SELECT section_id, i - 1 AS note_no, footnotes[i].ref AS ref, footnotes[i].text AS note
FROM (SELECT section_id, footnotes, unnest(range(1, len(footnotes) + 1)) AS i FROM (SELECT DISTINCT section_id, footnotes FROM sections))""")
def flatten_notes(spark, folder):
    rows = once(spark, folder, "sections", "section_id", "footnotes").select("section_id", F.posexplode("footnotes").alias("note_no", "n"))
    return rows.select("section_id", F.col("note_no").cast("bigint").alias("note_no"), F.col("n.ref").alias("ref"), F.col("n.text").alias("note"))


# The look-ahead of the line join is said with a capture in SQL, whose patterns have none.
@query("flatten_whitespace", f"""
SELECT section_id, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '\\x{{ad}}{SP}*', '', 'g'), '[\\x00-\\x08\\x0b-\\x1f\\x7f]', '', 'g'), '-\\n([a-z])', '\\1', 'g'), '{SP}+', ' ', 'g')) AS line
FROM {SECTIONS} WHERE text IS NOT NULL""")
def flatten_whitespace(spark, folder):
    return once(spark, folder, "sections", "section_id", "text").where("text is not null").select("section_id", T.flattened("text").alias("line"))


@query("collapse_text", f"""
SELECT DISTINCT entry_id, trim(regexp_replace(regexp_replace(text, '{INVISIBLE}', '', 'g'), '{SP}+', ' ', 'g')) AS line FROM bibliography""")
def collapse_text(spark, folder):
    return once(spark, folder, "bibliography", "entry_id", "text").select("entry_id", T.collapsed("text").alias("line"))


@query("repetition_key", f"SELECT section_id, lower(regexp_replace(title, '{SP}+|[0-9]+', '', 'g')) AS key FROM {SECTIONS}")
def repetition_key(spark, folder):
    return once(spark, folder, "sections", "section_id", "title").select("section_id", T.repetition_key("title").alias("key"))


@query("slug_stems", f"""
SELECT section_id, printf('%02d_', section_idx) || regexp_replace(left(CASE WHEN s = '' THEN 'document' ELSE s END, 48), '_+$', '') AS stem
FROM (SELECT *, regexp_replace(regexp_replace(lower(title), '[^a-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g') AS s FROM {SECTIONS}) WHERE title IS NOT NULL""")
def slug_stems(spark, folder):
    rows = once(spark, folder, "sections", "section_id", "section_idx", "title").where("title is not null")
    return rows.select("section_id", T.stem("section_idx", "title").alias("stem"))


@query("drop_anchors", f"SELECT section_id, trim(regexp_replace(text, '{SP}*{ANCHOR}', '', 'g')) AS text FROM {SECTIONS}")
def drop_anchors(spark, folder):
    return once(spark, folder, "sections", "section_id", "text").select("section_id", T.without_anchors("text").alias("text"))


@query("clean_pages", f"SELECT DISTINCT entry_id, rtrim(regexp_replace(pages, '{SP}+', '', 'g'), '.') AS pages FROM bibliography WHERE pages IS NOT NULL")
def clean_pages(spark, folder):
    rows = once(spark, folder, "bibliography", "entry_id", "pages").where("pages is not null")
    return rows.select("entry_id", F.regexp_replace(F.regexp_replace("pages", T.SPACE + "+", ""), r"\.+$", "").alias("pages"))


@query("request_text", """
SELECT section_id, title || chr(10) || chr(10) || text || CASE WHEN len(footnotes) > 0 THEN chr(10) || chr(10) || array_to_string(list_transform(footnotes, lambda n: '[^' || n.ref || ']: ' || n.text), chr(10)) ELSE '' END AS request
FROM (SELECT DISTINCT section_id, title, text, footnotes FROM sections) WHERE title IS NOT NULL AND text IS NOT NULL AND footnotes IS NOT NULL""")
def request_text(spark, folder):
    rows = once(spark, folder, "sections", "section_id", "title", "text", "footnotes").where("title is not null and text is not null and footnotes is not null")
    return rows.select("section_id", S.request_text("title", "text", "footnotes").alias("request"))


@query("locator_rendering", """
SELECT pairing_id, array_to_string(list_transform(citations, lambda c: '[^' || c.ref || '] ' || c.locator), '; ') AS cited FROM (SELECT DISTINCT pairing_id, citations FROM pairings) WHERE citations IS NOT NULL""")
def locator_rendering(spark, folder):
    rows = once(spark, folder, "pairings", "pairing_id", "citations").where("citations is not null")
    return rows.select("pairing_id", F.array_join(F.transform("citations", lambda c: F.concat(F.lit("[^"), c["ref"], F.lit("] "), c["locator"])), "; ").alias("cited"))


@query("apparatus_filter", f"""
SELECT section_id, regexp_matches(title, '(?i)bibliography|works cited|\\breferences\\b') AS is_bibliography,
regexp_matches(title, '(?i)front matter|bibliograph|index|contents|acknowledg|abbreviation|list of (figures|tables|illustrations|maps)|copyright|^notes?$') AS is_apparatus
FROM {SECTIONS} WHERE title IS NOT NULL""")
def apparatus_filter(spark, folder):
    rows = once(spark, folder, "sections", "section_id", "title").where("title is not null")
    return rows.select("section_id", T.is_bibliography_heading("title").alias("is_bibliography"), T.is_apparatus("title").alias("is_apparatus"))


@query("line_predicates", f"""
SELECT section_id, i - 1 AS line_no, regexp_matches(line, '(?i)^(?:[0-9]+|[ivxlcdm]+)$') AS is_number, regexp_matches(line, '[.!?…:][)\\]"''”’]*$') AS ends_paragraph,
length(line) <= 80 AND 2 * len(list_filter(regexp_extract_all(line, '\\p{{L}}+'), lambda w: regexp_matches(w, '^\\p{{Lu}}'))) >= len(regexp_extract_all(line, '\\p{{L}}+')) AS heading_like
FROM (SELECT section_id, i, parts[i] AS line FROM (SELECT section_id, parts, unnest(range(1, len(parts) + 1)) AS i FROM (SELECT section_id, string_split(text, chr(10)) AS parts FROM {SECTIONS} WHERE text IS NOT NULL)))
WHERE line <> ''""")
def line_predicates(spark, folder):
    lines = S.lines(once(spark, folder, "sections", "section_id", "text")).where("line <> ''")
    return lines.select("section_id", "line_no", T.is_page_number("line").alias("is_number"), T.ends_paragraph("line").alias("ends_paragraph"), T.heading_like("line").alias("heading_like"))


@query("metadata_escape", """SELECT DISTINCT doc_id, regexp_replace(title, '([\\\\=;#\\n])', '\\\\\\1', 'g') AS title FROM doc_meta""")
def metadata_escape(spark, folder):
    return once(spark, folder, "doc_meta", "doc_id", "title").select("doc_id", T.escaped_metadata("title").alias("title"))


@query("metadata_year", """
SELECT doc_id, author, CASE WHEN regexp_matches(pub_year, '^[0-9]{4}') THEN left(pub_year, 4) END AS year, lower(suffix) IN ('.epub', '.pdf') AS supported
FROM (SELECT DISTINCT doc_id, author, pub_year, suffix FROM doc_meta)""")
def metadata_year(spark, folder):
    rows = once(spark, folder, "doc_meta", "doc_id", "author", "pub_year", "suffix")
    year = F.when(F.col("pub_year").rlike("^[0-9]{4}"), F.substring("pub_year", 1, 4))
    return rows.select("doc_id", "author", year.alias("year"), F.lower("suffix").isin(".epub", ".pdf").alias("supported"))


NUMBER_WORDS = """
WITH ones(n, w) AS (SELECT i - 1, (['zero','one','two','three','four','five','six','seven','eight','nine','ten','eleven','twelve','thirteen','fourteen','fifteen','sixteen','seventeen','eighteen','nineteen'])[i] FROM range(1, 21) t(i)),
tens(n, w) AS (SELECT i + 1, (['twenty','thirty','forty','fifty','sixty','seventy','eighty','ninety'])[i] FROM range(1, 9) t(i)),
hundred(n, w) AS (SELECT n, w FROM ones UNION ALL SELECT t.n * 10 + o.n, t.w || CASE WHEN o.n > 0 THEN '-' || o.w ELSE '' END FROM tens t, ones o WHERE o.n < 10),
thousand(n, w) AS (SELECT n, w FROM hundred UNION ALL SELECT o.n * 100 + h.n, o.w || ' hundred' || CASE WHEN h.n > 0 THEN ' ' || h.w ELSE '' END FROM ones o, hundred h WHERE o.n BETWEEN 1 AND 9),
"""


@query("spell_number", NUMBER_WORDS + """
amounts AS (SELECT DISTINCT input_tokens AS n FROM gloss_usage WHERE input_tokens BETWEEN 0 AND 999999)
SELECT a.n, CASE WHEN a.n < 1000 THEN r.w WHEN a.n % 1000 = 0 THEN q.w || ' thousand' ELSE q.w || ' thousand ' || r.w END AS words
FROM amounts a JOIN thousand r ON r.n = a.n % 1000 JOIN thousand q ON q.n = a.n // 1000""")
def spell_number(spark, folder):
    rows = once(spark, folder, "gloss_usage", "input_tokens").where("input_tokens between 0 and 999999")
    return rows.select(F.col("input_tokens").alias("n"), T.spelled("input_tokens").alias("words"))


@query("locator_words", NUMBER_WORDS + """
cited AS (SELECT DISTINCT unnest(citations).locator AS locator FROM pairings),
parts AS (SELECT locator, generate_subscripts(p, 1) AS i, unnest(p) AS part FROM (SELECT locator, regexp_extract_all(locator, '[0-9]+|[.:]|[-–−]') AS p FROM cited WHERE locator IS NOT NULL))
SELECT locator, string_agg(CASE WHEN regexp_matches(part, '^[0-9]') THEN t.w WHEN part IN ('.', ':') THEN ', ' ELSE ' to ' END, '' ORDER BY i) AS spoken
FROM parts LEFT JOIN thousand t ON t.n = try_cast(part AS BIGINT) GROUP BY locator""")
def locator_words(spark, folder):
    rows = once(spark, folder, "pairings", "citations").select(F.explode("citations.locator").alias("locator")).where("locator is not null").distinct()
    return rows.select("locator", T.locator_words("locator").alias("spoken"))


@query("digit_words", """
SELECT DISTINCT doc_id, array_to_string(list_transform(regexp_extract_all(pub_year, '[0-9]'), lambda d: (['zero','one','two','three','four','five','six','seven','eight','nine'])[d::INT + 1]), '-') AS spoken FROM doc_meta WHERE pub_year IS NOT NULL""")
def digit_words(spark, folder):
    return once(spark, folder, "doc_meta", "doc_id", "pub_year").where("pub_year is not null").select("doc_id", T.spelled_digits("pub_year").alias("spoken"))


@query("bibliography_hints", """
SELECT entry_id, author FROM (SELECT DISTINCT entry_id, unnest(list_distinct(authors)) AS author FROM bibliography) WHERE author IS NOT NULL""")
def bibliography_hints(spark, folder):
    return once(spark, folder, "bibliography", "entry_id", "authors").select("entry_id", F.explode(F.array_distinct("authors")).alias("author")).where("author is not null").distinct()
