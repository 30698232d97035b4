"""Notes and anchors, links."""

from __future__ import annotations

from pyspark.sql import functions as F

from foliant.catalogue import query
from foliant.operators import notes as N
from foliant.plans.base import ANCHOR, once, once_sql
from foliant.sources.tables import table

ANCHORS = f"""anchors AS (SELECT section_id, doc_id, i - 1 AS anchor_no, refs[i] AS ref FROM
(SELECT section_id, doc_id, refs, unnest(range(1, len(refs) + 1)) AS i FROM (SELECT section_id, doc_id, regexp_extract_all(text, '{ANCHOR}', 1) AS refs FROM {once_sql('sections', 'section_id', 'doc_id', 'text')} WHERE text IS NOT NULL)))"""
NOTES = """notes AS (SELECT section_id, doc_id, ref, arg_max(note, i) AS note FROM (SELECT section_id, doc_id, i, footnotes[i].ref AS ref, footnotes[i].text AS note FROM
(SELECT section_id, doc_id, footnotes, unnest(range(1, len(footnotes) + 1)) AS i FROM (SELECT DISTINCT section_id, doc_id, footnotes FROM sections))) GROUP BY section_id, doc_id, ref)"""


def _both(spark, folder):
    rows = once(spark, folder, "sections", "section_id", "doc_id", "text", "footnotes")
    return N.anchor_rows(rows), N.note_rows(rows), rows.select("section_id", "doc_id")


@query("anchor_scan", f"WITH {ANCHORS} SELECT section_id, anchor_no::INT AS anchor_no, ref FROM anchors")
def anchor_scan(spark, folder):
    return _both(spark, folder)[0]


@query("anchor_note_join", f"WITH {ANCHORS}, {NOTES} SELECT a.section_id, a.anchor_no::INT AS anchor_no, a.ref, n.note FROM anchors a LEFT JOIN notes n USING (section_id, ref)")
def anchor_note_join(spark, folder):
    anchors, notes, _ = _both(spark, folder)
    return N.anchored(anchors, notes).select("section_id", "anchor_no", "ref", "note")


@query("leftover_notes", f"WITH {ANCHORS}, {NOTES} SELECT section_id, ref, note FROM notes n WHERE NOT EXISTS (SELECT 1 FROM anchors a WHERE a.section_id = n.section_id AND a.ref = n.ref)")
def leftover_notes(spark, folder):
    anchors, notes, _ = _both(spark, folder)
    return N.leftover(anchors, notes).select("section_id", "ref", "note")


@query("pairing_gate", f"""WITH {ANCHORS}, {NOTES}
SELECT doc_id, count(*) AS notes, count(CASE WHEN hit THEN 1 END) AS anchored, 2 * count(CASE WHEN hit THEN 1 END) >= count(*) AS kept
FROM (SELECT n.doc_id, EXISTS (SELECT 1 FROM anchors a WHERE a.doc_id = n.doc_id AND a.ref = n.ref) AS hit FROM notes n) GROUP BY doc_id""")
def pairing_gate(spark, folder):
    anchors, notes, of = _both(spark, folder)
    return N.pairing_gate(anchors.join(of, "section_id"), notes.join(of, "section_id"), "doc_id")


@query("contains_note_sections", f"""WITH {NOTES}
SELECT n.section_id, n.ref, s.section_id AS named_in FROM notes n JOIN {once_sql('sections', 'section_id', 'doc_id', 'text')} s ON s.doc_id = n.doc_id AND contains(s.text, '[^' || n.ref || ']')""")
def contains_note_sections(spark, folder):
    anchors, notes, of = _both(spark, folder)
    return N.sections_naming(anchors.join(of, "section_id"), notes.join(of, "section_id"), "doc_id").select("section_id", "ref", "named_in")


@query("note_continuation", """
SELECT l_suppkey, l_orderkey, l_linenumber, CASE WHEN l_orderkey - p <= 500 THEN p END AS note_page
FROM (SELECT *, last_value(CASE WHEN l_quantity <= 10 THEN l_orderkey END IGNORE NULLS) OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_partkey) AS p FROM lineitem)""")
def note_continuation(spark, folder):
    # Orders stand for pages and are thin for one supplier; the gap is 500 order keys.
    rows = table(spark, folder, "lineitem").select("l_suppkey", "l_orderkey", "l_linenumber", "l_partkey", "l_quantity")
    lines = rows.withColumn("line", F.struct("l_linenumber", "l_partkey"))
    out = N.continued_notes(lines, "l_suppkey", "l_orderkey", "line", F.when(F.col("l_quantity") <= 10, F.col("l_quantity")), gap=500)
    return out.select("l_suppkey", "l_orderkey", "l_linenumber", "note_page")


LINKS = "links AS (SELECT DISTINCT l_partkey % 500 AS source, l_suppkey % 500 AS target FROM lineitem)"


@query("reciprocal_links", f"WITH {LINKS} SELECT DISTINCT least(x.source, x.target) AS a, greatest(x.source, x.target) AS b FROM links x JOIN links y ON x.source = y.target AND x.target = y.source WHERE x.source <> x.target")
def reciprocal_links(spark, folder):
    return N.reciprocal_links(table(spark, folder, "lineitem").select((F.col("l_partkey") % 500).alias("source"), (F.col("l_suppkey") % 500).alias("target")))


@query("notes_file", f"""WITH {LINKS}, pairs AS (SELECT DISTINCT least(x.source, x.target) AS a, greatest(x.source, x.target) AS b FROM links x JOIN links y ON x.source = y.target AND x.target = y.source WHERE x.source <> x.target)
SELECT file, count(*) AS n FROM (SELECT a % 20 AS file FROM pairs UNION ALL SELECT b % 20 FROM pairs) GROUP BY file ORDER BY n DESC, file LIMIT 1""")
def notes_file(spark, folder):
    pairs = reciprocal_links(spark, folder)
    ends = pairs.select(F.explode(F.array("a", "b")).alias("end")).select((F.col("end") % 20).alias("file"))
    return ends.groupBy("file").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "file").limit(1)


@query("spine_manifest", """
SELECT o_orderkey, o_custkey, c_name FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderstatus <> 'P' AND c_mktsegment = 'BUILDING'""")
def spine_manifest(spark, folder):
    spine = table(spark, folder, "orders").where("o_orderstatus <> 'P'").select("o_orderkey", "o_custkey")
    manifest = table(spark, folder, "customer").where("c_mktsegment = 'BUILDING'").select("c_custkey", "c_name")
    return spine.join(manifest, F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", "o_custkey", "c_name")


@query("block_after", """
SELECT event_id, (SELECT min(e2.event_id) FROM events e2 WHERE e2.user_id = e1.user_id AND e2.event_type = 'purchase' AND e2.event_id >= e1.event_id) AS block FROM events e1""")
def block_after(spark, folder):
    from pyspark.sql import Window

    rows = table(spark, folder, "events").select("event_id", "user_id", F.when(F.col("event_type") == "purchase", F.col("event_id")).alias("p"))
    ahead = F.min("p").over(Window.partitionBy("user_id").orderBy("event_id").rowsBetween(0, Window.unboundedFollowing))
    return rows.select("event_id", ahead.alias("block"))
