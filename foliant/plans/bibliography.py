"""Bibliographies parsed and classified; tests hold the fields against hand-made entries."""

from __future__ import annotations

from foliant.catalogue import query
from foliant.operators import bibliography as B
from foliant.plans.base import once, once_sql


def _entries(spark, folder):
    return once(spark, folder, "bibliography", "entry_id", "doc_id", "section_idx", "entry_idx", "text")


@query("bibliography_parse")
def bibliography_parse(spark, folder):
    rows = _entries(spark, folder)
    parsed = B.parsed_entries(rows, "entry_id").join(rows, "entry_id")
    named = B.with_carried_names(parsed, ["doc_id", "section_idx"], ["entry_idx", "entry_id"])
    known = B.styles(rows, "doc_id").where("recognised").select("doc_id")
    return B.classified(named.join(known, "doc_id")).drop("carried")


@query("sniff_style", f"""
WITH e AS (SELECT *, coalesce(regexp_matches(text, '^[—–-]+[.,:]'), false) AS marked FROM {once_sql('bibliography', 'entry_id', 'doc_id', 'text')} WHERE text IS NOT NULL),
counted AS (SELECT doc_id, count(*) AS entries, count(CASE WHEN NOT marked AND regexp_matches(text, '\\b[0-9]{{4}}[^0-9]{{0,3}}(?:\\s*[0-9]+ pp?\\.)?$|\\([0-9]{{4}}\\):') THEN 1 END) AS tail,
count(CASE WHEN NOT marked AND regexp_matches(text, '^[^“]{{0,120}}?\\. [0-9]{{4}}\\. ') THEN 1 END) AS head FROM e GROUP BY doc_id),
marks AS (SELECT doc_id, regexp_extract(text, '^([—–-]+)', 1) AS mark, count(*) AS n FROM e WHERE marked GROUP BY ALL),
top AS (SELECT doc_id, mark FROM marks QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, mark) = 1)
SELECT doc_id, entries, tail, head, mark, tail >= 5 AND tail > 2 * head AND tail >= 0.3 * entries AS recognised FROM counted LEFT JOIN top USING (doc_id)""")
def sniff_style(spark, folder):
    return B.styles(_entries(spark, folder).where("text is not null"), "doc_id")
