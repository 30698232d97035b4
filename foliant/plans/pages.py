"""Pages, furniture, faces, outlines. A section stands for a book's page, its lines for the page's blocks; parts stand for
spans (size, text, block), region, nation and customer for an outline of three levels, orders by date for its starts."""

from __future__ import annotations

from pyspark.sql import functions as F

from foliant.catalogue import query
from foliant.functions.text import ends_paragraph
from foliant.operators import pages as P
from foliant.operators import sections as S
from foliant.plans.base import SP, once, once_sql
from foliant.sources.tables import table

LINES = f"""lines AS (SELECT doc_id, page_no, i - 1 AS block_no, parts[i] AS line FROM
(SELECT doc_id, section_id AS page_no, parts, unnest(range(1, len(parts) + 1)) AS i FROM (SELECT doc_id, section_id, string_split(text, chr(10)) AS parts FROM {once_sql('sections', 'section_id', 'doc_id', 'text')} WHERE text IS NOT NULL)))"""
KEY = f"lower(regexp_replace(line, '{SP}+|[0-9]+', '', 'g'))"
FURNITURE = f"""{LINES},
filled AS (SELECT * FROM lines WHERE trim(line, ' ') <> ''),
pages AS (SELECT doc_id, count(DISTINCT page_no) AS pages FROM lines GROUP BY doc_id),
everywhere AS (SELECT doc_id, {KEY} AS key, count(*) AS n FROM (SELECT DISTINCT doc_id, page_no, line FROM filled WHERE length(line) <= 80) GROUP BY ALL),
bounds AS (SELECT doc_id, page_no, arg_min(line, block_no) AS a, arg_max(line, block_no) AS b FROM filled GROUP BY ALL),
edge AS (SELECT doc_id, {KEY} AS key, count(*) AS n FROM (SELECT doc_id, page_no, a AS line FROM bounds WHERE length(a) <= 80 UNION SELECT doc_id, page_no, b FROM bounds WHERE length(b) <= 80) GROUP BY ALL),
furniture AS (SELECT doc_id, key, 'everywhere' AS scope FROM everywhere JOIN pages USING (doc_id) WHERE key <> '' AND n >= greatest(3, pages // 20)
UNION ALL SELECT doc_id, key, 'edge' FROM edge WHERE key <> '' AND n >= 3)"""


def page_lines(spark, folder):
    return S.lines(once(spark, folder, "sections", "section_id", "doc_id", "text")).select("doc_id", F.col("section_id").alias("page_no"), F.col("line_no").alias("block_no"), "line")


def page_furniture(spark, folder):
    return P.furniture(page_lines(spark, folder), text="line")


@query("furniture_global", f"WITH {FURNITURE} SELECT doc_id, key FROM furniture WHERE scope = 'everywhere'")
def furniture_global(spark, folder):
    return page_furniture(spark, folder).where("scope = 'everywhere'").drop("scope")


# Edges come back in a user's days of events: the day is the page, the event type its block.
EVENTS = "lines AS (SELECT user_id AS doc_id, CAST(ts AS DATE) AS page_no, event_id AS block_no, event_type AS line FROM events)"


@query("furniture_edge", f"WITH {FURNITURE.replace(LINES, EVENTS)} SELECT doc_id, key FROM furniture WHERE scope = 'edge'")
def furniture_edge(spark, folder):
    days = table(spark, folder, "events").select(F.col("user_id").alias("doc_id"), F.to_date("ts").alias("page_no"), F.col("event_id").alias("block_no"), F.col("event_type").alias("line"))
    return P.furniture(days, text="line").where("scope = 'edge'").drop("scope")


@query("furniture_union", f"WITH {FURNITURE} SELECT DISTINCT doc_id, key FROM furniture")
def furniture_union(spark, folder):
    return page_furniture(spark, folder).select("doc_id", "key").distinct()


@query("strip_furniture", f"""WITH {FURNITURE}
SELECT doc_id, page_no, block_no, line FROM lines l WHERE NOT regexp_matches(line, '(?i)^(?:[0-9]+|[ivxlcdm]+)$')
AND NOT (length(line) <= 80 AND EXISTS (SELECT 1 FROM furniture f WHERE f.doc_id = l.doc_id AND f.key = {KEY.replace('line', 'l.line')}))""")
def strip_furniture(spark, folder):
    return P.without_furniture(page_lines(spark, folder), page_furniture(spark, folder), text="line")


# Spans: a brand is a document, a type a block, the size runs from 1.0 to 5.0 in tenths, every seventh part is raised.
SPANS = """spans AS (SELECT p_brand AS doc_id, p_size % 3 AS page_no, p_type AS block_no, p_partkey AS span_no, p_size / 10.0 AS size, p_name AS text, p_partkey % 7 = 0 AS superscript FROM part)"""
PROFILE = f"""{SPANS},
weights AS (SELECT doc_id, size, sum(length(text)) AS weight, min(span_no) AS first FROM spans WHERE NOT superscript GROUP BY ALL),
body AS (SELECT doc_id, size AS body_size, weight AS body_weight FROM weights QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY weight DESC, first) = 1),
notes AS (SELECT doc_id, size AS note_size FROM (SELECT w.*, body_weight FROM weights w JOIN body USING (doc_id) WHERE size < body_size - 0.5 QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY weight DESC, first) = 1) WHERE weight >= body_weight * 0.05),
profile AS (SELECT doc_id, body_size, note_size FROM body LEFT JOIN notes USING (doc_id)),
sizes AS (SELECT doc_id, page_no, block_no, coalesce(size, 0.0) AS size FROM (SELECT doc_id, page_no, block_no, CASE WHEN NOT superscript THEN size END AS size, CASE WHEN superscript THEN -1 ELSE sum(length(text)) END AS weight, min(span_no) AS first FROM spans GROUP BY doc_id, page_no, block_no, superscript, CASE WHEN NOT superscript THEN size END)
QUALIFY row_number() OVER (PARTITION BY doc_id, page_no, block_no ORDER BY weight DESC, first) = 1),
roles AS (SELECT doc_id, page_no, block_no, size, size > body_size + 1.0 AS is_heading, coalesce(abs(size - note_size) < abs(size - body_size), false) AS is_note FROM sizes JOIN profile USING (doc_id))"""


def spans(spark, folder):
    part = table(spark, folder, "part")
    return part.select(F.col("p_brand").alias("doc_id"), (F.col("p_size") % 3).alias("page_no"), F.col("p_type").alias("block_no"), F.col("p_partkey").alias("span_no"), (F.col("p_size") / 10.0).alias("size"), F.col("p_name").alias("text"), (F.col("p_partkey") % 7 == 0).alias("superscript"))


def roles(spark, folder):
    rows = spans(spark, folder)
    return P.block_roles(P.dominant_size(rows, "doc_id", "page_no", "block_no"), P.font_profile(rows))


@query("font_profile", f"WITH {PROFILE} SELECT * FROM profile")
def font_profile(spark, folder):
    return P.font_profile(spans(spark, folder))


@query("dominant_size", f"WITH {PROFILE} SELECT * FROM sizes")
def dominant_size(spark, folder):
    return P.dominant_size(spans(spark, folder), "doc_id", "page_no", "block_no")


@query("note_block_flags", f"WITH {PROFILE} SELECT * FROM roles")
def note_block_flags(spark, folder):
    return roles(spark, folder).drop("is_note_kept")


@query("page_note_guard", f"WITH {PROFILE} SELECT doc_id, page_no, block_no, is_note AND NOT bool_and(is_heading OR is_note) OVER (PARTITION BY doc_id, page_no) AS is_note_kept FROM roles")
def page_note_guard(spark, folder):
    return roles(spark, folder).select("doc_id", "page_no", "block_no", "is_note_kept")


@query("heading_islands", f"""WITH {PROFILE}
SELECT doc_id, page_no, block_no, last_value(CASE WHEN NOT coalesce(goes_on, false) THEN block_no END IGNORE NULLS) OVER (PARTITION BY doc_id, page_no ORDER BY block_no) AS heading_no
FROM (SELECT *, is_heading AND lag(size) OVER (PARTITION BY doc_id, page_no ORDER BY block_no) = size AS goes_on FROM roles)""")
def heading_islands(spark, folder):
    return P.merged_headings(roles(spark, folder)).select("doc_id", "page_no", "block_no", "heading_no")


OUTLINE = """outline AS (SELECT r_regionkey AS doc_id, 1 AS level, r_name AS title, -1 AS nation, CAST(-1 AS BIGINT) AS cust FROM region
UNION ALL SELECT n_regionkey, 2, n_name, n_nationkey, -1 FROM nation UNION ALL SELECT n_regionkey, 3, c_name, c_nationkey, c_custkey FROM customer JOIN nation ON c_nationkey = n_nationkey)"""


@query("outline_leaves", f"""WITH {OUTLINE}
SELECT doc_id, entry_no, level, title FROM (SELECT *, lead(level) OVER (PARTITION BY doc_id ORDER BY entry_no) AS next FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY nation, cust) AS entry_no FROM outline)) WHERE next IS NULL OR next <= level""")
def outline_leaves(spark, folder):
    from pyspark.sql import Window

    nation = table(spark, folder, "nation")
    top = table(spark, folder, "region").select(F.col("r_regionkey").alias("doc_id"), F.lit(1).alias("level"), F.col("r_name").alias("title"), F.lit(-1).alias("nation"), F.lit(-1).cast("bigint").alias("cust"))
    middle = nation.select(F.col("n_regionkey").alias("doc_id"), F.lit(2).alias("level"), F.col("n_name").alias("title"), F.col("n_nationkey").alias("nation"), F.lit(-1).cast("bigint").alias("cust"))
    low = table(spark, folder, "customer").join(nation, F.col("c_nationkey") == F.col("n_nationkey")).select(F.col("n_regionkey").alias("doc_id"), F.lit(3).alias("level"), F.col("c_name").alias("title"), F.col("c_nationkey").alias("nation"), F.col("c_custkey").alias("cust"))
    entries = top.unionByName(middle).unionByName(low).withColumn("entry_no", F.row_number().over(Window.partitionBy("doc_id").orderBy("nation", "cust")))
    return P.outline_leaves(entries).select("doc_id", "entry_no", "level", "title")


STARTS = """starts AS (SELECT o_custkey AS doc_id, o_orderkey AS entry_no, CAST(floor(o_totalprice / 1000) AS BIGINT) AS page FROM orders),
advancing AS (SELECT doc_id, entry_no, page FROM (SELECT *, max(page) OVER (PARTITION BY doc_id ORDER BY entry_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS far FROM starts) WHERE far IS NULL OR page > far),
bounds AS (SELECT doc_id, entry_no, page, greatest(coalesce(lead(page) OVER (PARTITION BY doc_id ORDER BY entry_no) - 1, 1000), page) AS end_page FROM advancing)"""


def advancing(spark, folder):
    starts = table(spark, folder, "orders").select(F.col("o_custkey").alias("doc_id"), F.col("o_orderkey").alias("entry_no"), F.floor(F.col("o_totalprice") / 1000).alias("page"))
    return P.advancing(starts, "doc_id", "entry_no", "page")


@query("advancing_starts", f"WITH {STARTS} SELECT * FROM advancing")
def advancing_starts(spark, folder):
    return advancing(spark, folder)


@query("section_bounds", f"WITH {STARTS} SELECT * FROM bounds")
def section_bounds(spark, folder):
    return P.section_bounds(advancing(spark, folder), "doc_id", "entry_no", "page", F.lit(1000))


@query("section_range_join", f"""WITH {STARTS}
SELECT o_orderkey AS note_id, b.doc_id, entry_no FROM orders o JOIN bounds b ON o.o_custkey = b.doc_id AND CAST(floor(o_totalprice / 1000) AS BIGINT) BETWEEN page AND end_page""")
def section_range_join(spark, folder):
    bounds = P.section_bounds(advancing(spark, folder), "doc_id", "entry_no", "page", F.lit(1000)).withColumnRenamed("page", "start_page")
    notes = table(spark, folder, "orders").select(F.col("o_orderkey").alias("note_id"), F.col("o_custkey").alias("doc_id"), F.floor(F.col("o_totalprice") / 1000).alias("page"))
    return P.in_page_range(notes, bounds, "doc_id", "page", "start_page", "end_page").select("note_id", "doc_id", "entry_no")


@query("front_matter", f"""
SELECT section_id, coalesce(section_idx < min(CASE WHEN regexp_matches(title, '(?i)introduction|preface|chapter') THEN section_idx END) OVER (PARTITION BY doc_id), false) AS is_front FROM {once_sql('sections', 'section_id', 'doc_id', 'section_idx', 'title')}""")
def front_matter(spark, folder):
    from pyspark.sql import Window

    rows = once(spark, folder, "sections", "section_id", "doc_id", "section_idx", "title")
    first = F.min(F.when(F.col("title").rlike("(?i)introduction|preface|chapter"), F.col("section_idx"))).over(Window.partitionBy("doc_id"))
    return rows.select("section_id", F.coalesce(F.col("section_idx") < first, F.lit(False)).alias("is_front"))


@query("hanging_indent_entries", """
SELECT l_suppkey, l_orderkey, l_linenumber, sum(CASE WHEN opens THEN 1 ELSE 0 END) OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_partkey)::BIGINT AS entry_no
FROM (SELECT *, l_quantity <= min(l_quantity) OVER (PARTITION BY l_suppkey, l_orderkey) + 2.0 OR row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_partkey) = 1 AS opens FROM lineitem)""")
def hanging_indent_entries(spark, folder):
    lines = table(spark, folder, "lineitem").select("l_suppkey", "l_orderkey", "l_linenumber", "l_partkey", "l_quantity").withColumn("line", F.struct("l_linenumber", "l_partkey"))
    return P.hanging_entries(lines, "l_suppkey", "l_orderkey", "line", "l_quantity").select("l_suppkey", "l_orderkey", "l_linenumber", "entry_no")


@query("forward_fill_section", """
SELECT event_id, last_value(CASE WHEN event_type = 'click' THEN event_id END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS open_section FROM events""")
def forward_fill_section(spark, folder):
    rows = table(spark, folder, "events").select("event_id", "user_id", "ts", F.when(F.col("event_type") == "click", F.col("event_id")).alias("label"))
    return P.forward_filled(rows, ["user_id"], ["ts", "event_id"], "label", "open_section").select("event_id", "open_section")


@query("continued_bibliography", f"""
SELECT entry_id, doc_id, sum(opens) OVER (PARTITION BY doc_id, section_idx ORDER BY entry_idx, entry_id)::BIGINT AS entry_no
FROM (SELECT *, CASE WHEN coalesce(lag(regexp_matches(text, '[.!?…:][)\\]"''”’]*$')) OVER (PARTITION BY doc_id, section_idx ORDER BY entry_idx, entry_id), true) THEN 1 ELSE 0 END AS opens FROM {once_sql('bibliography', 'entry_id', 'doc_id', 'section_idx', 'entry_idx', 'text')})""")
def continued_bibliography(spark, folder):
    rows = once(spark, folder, "bibliography", "entry_id", "doc_id", "section_idx", "entry_idx", "text")
    return P.continued_entries(rows, ["doc_id", "section_idx"], ["entry_idx", "entry_id"], ends_paragraph("text")).select("entry_id", "doc_id", "entry_no")
