"""Sigla, caches, scripts, recitation plans, usage and lexicons."""

from __future__ import annotations

from pyspark.sql import functions as F

from foliant.catalogue import query
from foliant.functions import text as T
from foliant.operators import relations as R
from foliant.plans.base import once, once_sql
from foliant.sources.tables import table

PAIRS = once_sql("pairings", "pairing_id", "doc_id", "author", "siglum", "citations")
CITED = f"""cited AS (SELECT author, siglum, pairing_id * 10 + i AS place, citations[i].ref AS ref, citations[i].locator AS locator FROM (SELECT *, unnest(range(1, len(citations) + 1)) AS i FROM {PAIRS}))"""


def pairs(spark, folder):
    return once(spark, folder, "pairings", "pairing_id", "doc_id", "author", "siglum", "citations")


@query("pair_sigla", f"""WITH {CITED}
SELECT author, siglum, count(*) AS n, array_to_string(list(ref || ' ' || locator ORDER BY place)[1:3], '; ') AS sample FROM cited GROUP BY author, siglum""")
def pair_sigla(spark, folder):
    cited = pairs(spark, folder).select("author", "siglum", "pairing_id", F.posexplode("citations").alias("i", "c"))
    cited = cited.select("author", "siglum", (F.col("pairing_id") * 10 + F.col("i") + 1).alias("place"), F.col("c.ref").alias("ref"), F.col("c.locator").alias("locator"))
    out = R.paired_sigla(cited, "place", "ref", "locator")
    return out.select("author", "siglum", "n", F.array_join(F.transform("sample", lambda c: F.concat(c["ref"], F.lit(" "), c["locator"])), "; ").alias("sample"))


COLLISIONS = f"collisions AS (SELECT siglum, list(author ORDER BY author) AS authors FROM (SELECT DISTINCT siglum, author FROM {PAIRS} WHERE siglum IS NOT NULL AND author IS NOT NULL) GROUP BY siglum HAVING count(*) > 1)"


@query("siglum_collisions", f"WITH {COLLISIONS} SELECT siglum, array_to_string(authors, '; ') AS authors FROM collisions")
def siglum_collisions(spark, folder):
    return R.colliding_sigla(pairs(spark, folder)).select("siglum", F.array_join("authors", "; ").alias("authors"))


@query("primary_authors", f"SELECT DISTINCT author, length(author) AS n FROM (SELECT unnest(authors) AS author, is_primary_source FROM {once_sql('bibliography', 'entry_id', 'authors', 'is_primary_source')}) WHERE is_primary_source AND author IS NOT NULL")
def primary_authors(spark, folder):
    rows = once(spark, folder, "bibliography", "entry_id", "authors", "is_primary_source").where("is_primary_source").select(F.explode("authors").alias("author")).where("author is not null")
    return rows.distinct().select("author", F.length("author").cast("bigint").alias("n")).orderBy(F.desc("n"), "author")


# Three tiers of spoken forms: the suppliers' first names, later keys shorter of value, and blanks that do not count.
TIERS = """tiers AS (SELECT 'S' || (s_suppkey % 40) AS siglum, min(s_name) AS spoken, 0 AS tier FROM supplier GROUP BY 1
UNION ALL SELECT 'S' || (p_partkey % 60), min(CASE WHEN p_size > 25 THEN p_name ELSE '' END), 1 FROM part WHERE p_size > 45 GROUP BY 1
UNION ALL SELECT 'S' || (c_custkey % 80), min(c_name), 2 FROM customer WHERE c_nationkey = 3 GROUP BY 1)"""


def tiers(spark, folder):
    key = lambda c, n: F.concat(F.lit("S"), (F.col(c) % n).cast("string")).alias("siglum")
    a = table(spark, folder, "supplier").groupBy(key("s_suppkey", 40)).agg(F.min("s_name").alias("spoken"))
    b = table(spark, folder, "part").where("p_size > 45").groupBy(key("p_partkey", 60)).agg(F.min(F.when(F.col("p_size") > 25, F.col("p_name")).otherwise("")).alias("spoken"))
    c = table(spark, folder, "customer").where("c_nationkey = 3").groupBy(key("c_custkey", 80)).agg(F.min("c_name").alias("spoken"))
    return a, b, c


@query("sigla_overlay", f"WITH {TIERS} SELECT siglum, arg_max(spoken, tier) AS spoken, max(tier) AS tier FROM tiers WHERE spoken <> '' GROUP BY siglum")
def sigla_overlay(spark, folder):
    return R.overlaid(*tiers(spark, folder))


@query("promote_canon", f"WITH {TIERS} SELECT siglum, spoken FROM tiers t WHERE tier = 2 AND spoken <> '' AND NOT EXISTS (SELECT 1 FROM tiers u WHERE u.tier = 1 AND u.siglum = t.siglum)")
def promote_canon(spark, folder):
    _, b, c = tiers(spark, folder)
    return R.promoted(c, b)


KNOWN = "known AS (SELECT DISTINCT siglum FROM pairings WHERE pairing_id % 3 = 0 AND siglum IS NOT NULL)"


@query("draft_candidates", f"WITH {COLLISIONS}, {KNOWN} SELECT DISTINCT siglum FROM {PAIRS} WHERE siglum IS NOT NULL AND siglum NOT IN (SELECT siglum FROM known) AND siglum NOT IN (SELECT siglum FROM collisions)")
def draft_candidates(spark, folder):
    # The known sigla stand in for a vocabulary kept elsewhere: those of every third pairing.
    rows = pairs(spark, folder)
    return R.draft_candidates(rows, rows.where("pairing_id % 3 = 0"), R.colliding_sigla(rows))


@query("answers_requested", f"WITH {KNOWN} SELECT pairing_id, siglum FROM {PAIRS} WHERE siglum IN (SELECT siglum FROM known)")
def answers_requested(spark, folder):
    rows = pairs(spark, folder)
    known = rows.where("pairing_id % 3 = 0").select("siglum").distinct()
    return rows.join(known, "siglum", "left_semi").select("pairing_id", "siglum")


@query("bare_authors", f"SELECT DISTINCT author FROM {PAIRS} WHERE author IS NOT NULL AND author NOT LIKE '%,%' EXCEPT SELECT DISTINCT author FROM doc_meta")
def bare_authors(spark, folder):
    bare = pairs(spark, folder).where("author is not null and not contains(author, ',')").select("author").distinct()
    return bare.join(table(spark, folder, "doc_meta").select("author"), "author", "left_anti")


UTTERANCES = once_sql("utterances", "utt_id", "doc_id", "section_idx", "utt_idx", "text", "manner", "lang")


def utterances(spark, folder):
    return once(spark, folder, "utterances", "utt_id", "doc_id", "section_idx", "utt_idx", "text", "manner", "lang")


@query("tongue_counts", f"SELECT lang, count(*) AS n FROM {UTTERANCES} WHERE lang <> 'en' GROUP BY lang")
def tongue_counts(spark, folder):
    return R.language_counts(utterances(spark, folder))


@query("note_totals", """SELECT doc_id, coalesce(sum(len(footnotes)), 0)::BIGINT AS notes FROM (SELECT DISTINCT section_id, doc_id, footnotes FROM sections) GROUP BY doc_id""")
def note_totals(spark, folder):
    rows = once(spark, folder, "sections", "section_id", "doc_id", "footnotes")
    return rows.groupBy("doc_id").agg(F.coalesce(F.sum(F.when(F.col("footnotes").isNotNull(), F.size("footnotes"))), F.lit(0)).alias("notes"))


SPOKEN = f"spoken AS (SELECT *, lag(manner) OVER (PARTITION BY doc_id, section_idx ORDER BY utt_idx) AS before FROM {UTTERANCES} WHERE trim(text, ' ') <> '')"


@query("pause_plan", f"WITH {SPOKEN} SELECT utt_id, CAST(CASE WHEN before IS NULL THEN 0 WHEN manner = 'digression' OR before = 'digression' THEN 0.35 ELSE 0.6 END AS DOUBLE) AS pause FROM spoken")
def pause_plan(spark, folder):
    return R.pauses(utterances(spark, folder), ["doc_id", "section_idx"], "utt_idx", F.trim("text") != "").select("utt_id", "pause")


@query("chapter_offsets", f"""
SELECT doc_id, section_idx, (sum(n) OVER w - n)::BIGINT AS start_at, (sum(n) OVER w)::BIGINT AS end_at FROM (SELECT doc_id, section_idx, coalesce(sum(length(text)), 0) AS n FROM {UTTERANCES} GROUP BY ALL) WINDOW w AS (PARTITION BY doc_id ORDER BY section_idx)""")
def chapter_offsets(spark, folder):
    chapters = utterances(spark, folder).groupBy("doc_id", "section_idx").agg(F.coalesce(F.sum(F.length("text")), F.lit(0)).alias("n"))
    return R.chapter_offsets(chapters, ["doc_id"], "section_idx", "n").select("doc_id", "section_idx", "start_at", "end_at")


@query("m3u_lines", f"""
SELECT section_id, '#EXTINF:' || CAST(length(text) // 15 AS VARCHAR) || ',' || replace(title, ',', '‚') AS line FROM {once_sql('sections', 'section_id', 'title', 'text')} WHERE title IS NOT NULL AND text IS NOT NULL""")
def m3u_lines(spark, folder):
    # Fifteen characters stand for a second of speech.
    rows = once(spark, folder, "sections", "section_id", "title", "text").where("title is not null and text is not null")
    return rows.select("section_id", F.concat(F.lit("#EXTINF:"), F.expr("length(text) div 15").cast("string"), F.lit(","), T.playlist_title("title")).alias("line"))


@query("utterance_numbers", f"SELECT utt_id, row_number() OVER (PARTITION BY doc_id, section_idx ORDER BY utt_idx) AS n FROM {UTTERANCES}")
def utterance_numbers(spark, folder):
    from pyspark.sql import Window

    n = F.row_number().over(Window.partitionBy("doc_id", "section_idx").orderBy("utt_idx"))
    return utterances(spark, folder).select("utt_id", n.cast("bigint").alias("n"))


@query("faithful_check", f"""
SELECT doc_id, section_idx, regexp_replace(lower(s.text), '[^a-z]', '', 'g') = u.said AS same FROM {once_sql('sections', 'doc_id', 'section_idx', 'text')} s JOIN
(SELECT doc_id, section_idx, string_agg(regexp_replace(lower(text), '[^a-z]', '', 'g'), '' ORDER BY utt_idx) AS said FROM {UTTERANCES} WHERE manner = 'body' AND text IS NOT NULL GROUP BY ALL) u USING (doc_id, section_idx) WHERE s.text IS NOT NULL""")
def faithful_check(spark, folder):
    letters = lambda c: F.regexp_replace(F.lower(c), "[^a-z]", "")
    said = utterances(spark, folder).where("manner = 'body' and text is not null").groupBy("doc_id", "section_idx").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("utt_idx", letters("text").alias("t")))), lambda x: x["t"]), "").alias("said"))
    sections = once(spark, folder, "sections", "doc_id", "section_idx", "text").where("text is not null")
    return sections.join(said, ["doc_id", "section_idx"]).select("doc_id", "section_idx", (letters("text") == F.col("said")).alias("same"))


@query("output_average", f"SELECT CASE WHEN sum(calls) - sum(coalesce(truncated, 0)) > 0 THEN sum(output_tokens) / (sum(calls) - sum(coalesce(truncated, 0))) END AS average FROM {once_sql('gloss_usage', 'usage_id', 'output_tokens', 'calls', 'truncated')}")
def output_average(spark, folder):
    return R.output_average(once(spark, folder, "gloss_usage", "usage_id", "output_tokens", "calls", "truncated"))


@query("usage_by_label", f"SELECT provider_label, sum(input_tokens)::BIGINT AS input_tokens, sum(output_tokens)::BIGINT AS output_tokens, sum(calls)::BIGINT AS calls FROM {once_sql('gloss_usage', 'usage_id', 'provider_label', 'input_tokens', 'output_tokens', 'calls')} WHERE provider_label IS NOT NULL GROUP BY provider_label")
def usage_by_label(spark, folder):
    rows = once(spark, folder, "gloss_usage", "usage_id", "provider_label", "input_tokens", "output_tokens", "calls").where("provider_label is not null")
    return rows.groupBy("provider_label").agg(*[F.sum(c).alias(c) for c in ("input_tokens", "output_tokens", "calls")])


@query("cache_hits", """
SELECT coalesce(a.k, b.k) AS key, CASE WHEN b.k IS NULL THEN 'miss' WHEN a.k IS NULL THEN 'stale' ELSE 'hit' END AS state
FROM (SELECT DISTINCT sha256(text) AS k FROM documents WHERE text IS NOT NULL AND doc_id % 2 = 0) a FULL JOIN (SELECT DISTINCT sha256(text) AS k FROM documents WHERE text IS NOT NULL AND doc_id % 3 = 0) b ON a.k = b.k""")
def cache_hits(spark, folder):
    # The wanted texts and the kept ones are two overlapping halves of one table.
    rows = table(spark, folder, "documents").where("text is not null").select("doc_id", F.sha2("text", 256).alias("key"))
    return R.cache_state(rows.where("doc_id % 2 = 0"), rows.where("doc_id % 3 = 0"), "key")


@query("section_signature", f"""
SELECT doc_id, section_idx, sha256(string_agg(d, '' ORDER BY utt_idx)) AS signature FROM (SELECT doc_id, section_idx, utt_idx, sha256('{{"manner":' || coalesce('"' || manner || '"', 'null') || ',"n":' || coalesce(length(text)::VARCHAR, 'null') || '}}') AS d FROM {UTTERANCES}) GROUP BY ALL""")
def section_signature(spark, folder):
    rows = utterances(spark, folder).withColumn("n", F.length("text"))
    return R.signatures(rows, ["doc_id", "section_idx"], "utt_idx", "manner", "n")


@query("changed_sections", f"""
WITH signed AS (SELECT doc_id, section_idx, sha256(string_agg(sha256('{{"manner":' || coalesce('"' || manner || '"', 'null') || '}}'), '' ORDER BY utt_idx)) AS signature FROM {UTTERANCES} GROUP BY ALL)
SELECT doc_id, section_idx, signature FROM signed WHERE doc_id % 4 <> 0""")
def changed_sections(spark, folder):
    # The kept signatures are those of every fourth book.
    signed = R.signatures(utterances(spark, folder), ["doc_id", "section_idx"], "utt_idx", "manner")
    return R.changed(signed, signed.where("doc_id % 4 = 0"), ["doc_id", "section_idx"])


@query("lexicon_hits", """
WITH words AS (SELECT rowid_ AS t, unnest(regexp_extract_all(text, '[a-zA-Z0-9_]+')) AS term FROM (SELECT row_number() OVER () AS rowid_, regexp_replace(text, '[^\\x00-\\x7f]', ' ', 'g') AS text FROM documents)),
terms AS (SELECT DISTINCT unnest(regexp_extract_all(gloss, '[a-z]+')) AS term FROM subject_areas)
SELECT term, count(*) AS n, count(DISTINCT t) AS texts FROM words JOIN terms USING (term) GROUP BY term""")
def lexicon_hits(spark, folder):
    terms = table(spark, folder, "subject_areas").select(F.explode(F.regexp_extract_all("gloss", F.lit("([a-z]+)"), F.lit(1))).alias("term"))
    texts = table(spark, folder, "documents").select(F.regexp_replace("text", r"[^\x00-\x7f]", " ").alias("text"))
    return R.term_counts(texts, terms)


@query("voice_blend", """
SELECT label, i - 1 AS place, sum(embedding[i]::DOUBLE * (1 + vec_id % 3)) / sum(1 + vec_id % 3) AS value FROM (SELECT label, vec_id, embedding, unnest(range(1, len(embedding) + 1)) AS i FROM embeddings) GROUP BY label, i""")
def voice_blend(spark, folder):
    out = R.blended(table(spark, folder, "embeddings"), "label", "embedding", (1 + F.col("vec_id") % 3))
    return out.select("label", F.posexplode("embedding").alias("place", "value")).withColumn("place", F.col("place").cast("bigint"))


@query("style_counts", f"""
SELECT doc_id, count(*) AS entries, count(CASE WHEN regexp_matches(text, '\\(?[0-9]{{4}}[^0-9]*\\)?[.:,][^.]*\\.?$') THEN 1 END) AS tail, count(CASE WHEN regexp_matches(text, '^[^.]*\\([0-9]{{4}}\\)') THEN 1 END) AS head,
count(CASE WHEN regexp_matches(text, '^[—–-]{{1,3}}') THEN 1 END) AS continued FROM {once_sql('bibliography', 'entry_id', 'doc_id', 'text')} GROUP BY doc_id""")
def style_counts(spark, folder):
    rows = once(spark, folder, "bibliography", "entry_id", "doc_id", "text")
    return rows.groupBy("doc_id").agg(
        F.count("*").alias("entries"),
        F.count_if(F.col("text").rlike(r"\(?[0-9]{4}[^0-9]*\)?[.:,][^.]*\.?$")).alias("tail"),
        F.count_if(F.col("text").rlike(r"^[^.]*\([0-9]{4}\)")).alias("head"),
        F.count_if(F.col("text").rlike("^[—–-]{1,3}")).alias("continued"),
    )


@query("carried_names", f"""
SELECT entry_id, CASE WHEN NOT dash THEN first ELSE last_value(CASE WHEN NOT dash THEN first END IGNORE NULLS) OVER (PARTITION BY doc_id, section_idx ORDER BY entry_idx, entry_id) END AS name
FROM (SELECT *, authors[1] AS first, regexp_matches(text, '^[—–-]{{1,3}}') AS dash FROM {once_sql('bibliography', 'entry_id', 'doc_id', 'section_idx', 'entry_idx', 'text', 'authors')})""")
def carried_names(spark, folder):
    from pyspark.sql import Window

    rows = once(spark, folder, "bibliography", "entry_id", "doc_id", "section_idx", "entry_idx", "text", "authors")
    dash, first = F.col("text").rlike("^[—–-]{1,3}"), F.get("authors", F.lit(0))
    carried = F.last(F.when(~dash, first), ignorenulls=True).over(Window.partitionBy("doc_id", "section_idx").orderBy("entry_idx", "entry_id"))
    return rows.select("entry_id", F.when(~dash, first).otherwise(carried).alias("name"))


@query("primary_source_rule", f"""
SELECT entry_id, coalesce(author_role = 'trans', false) OR (authors[1] IS NOT NULL AND NOT contains(authors[1], ',') AND regexp_matches(text, 'Translated by|Edited by')) AS is_primary FROM {once_sql('bibliography', 'entry_id', 'text', 'authors', 'author_role')}""")
def primary_source_rule(spark, folder):
    rows = once(spark, folder, "bibliography", "entry_id", "text", "authors", "author_role")
    first = F.get("authors", F.lit(0))
    bare = first.isNotNull() & ~F.contains(first, F.lit(",")) & F.col("text").rlike("Translated by|Edited by")
    return rows.select("entry_id", (F.coalesce(F.col("author_role") == "trans", F.lit(False)) | F.coalesce(bare, F.lit(False))).alias("is_primary"))


@query("reciter_route", f"""
SELECT utt_id, CASE WHEN lang IN ('en', 'it', 'fr', 'es', 'pt', 'hi', 'ja', 'zh') THEN lang WHEN lang = 'la' THEN 'it' WHEN lang = 'grc' AND NOT regexp_matches(text, '[\\x{{370}}-\\x{{3ff}}\\x{{1f00}}-\\x{{1fff}}]') THEN 'it' END AS route FROM {UTTERANCES}""")
def reciter_route(spark, folder):
    greek = F.col("text").rlike("[\\u0370-\\u03ff\\u1f00-\\u1fff]")
    route = F.when(F.col("lang").isin(*"en it fr es pt hi ja zh".split()), F.col("lang")).when(F.col("lang") == "la", "it").when((F.col("lang") == "grc") & ~greek, "it")
    return utterances(spark, folder).select("utt_id", route.alias("route"))


@query("switch_range", f"""
SELECT DISTINCT s.switch_id, s.stretch BETWEEN 0 AND u.utt_idx AS in_range, contains(u.text, s.text) AS verbatim FROM (SELECT DISTINCT switch_id, utt_id, stretch, text FROM switches) s JOIN {UTTERANCES} u USING (utt_id)""")
def switch_range(spark, folder):
    switches = once(spark, folder, "switches", "switch_id", "utt_id", "stretch", "text").withColumnRenamed("text", "said")
    both = switches.join(utterances(spark, folder), "utt_id")
    return both.select("switch_id", F.col("stretch").between(0, F.col("utt_idx")).alias("in_range"), F.contains("text", "said").alias("verbatim")).distinct()


@query("emitted_sections", """SELECT DISTINCT section_id, coalesce(text <> '', false) OR coalesce(len(bibliography), 0) > 0 OR coalesce(len(footnotes), 0) > 0 AS emitted FROM sections""")
def emitted_sections(spark, folder):
    rows = table(spark, folder, "sections")
    some = lambda c: F.coalesce(F.size(c) > 0, F.lit(False)) & F.col(c).isNotNull()
    return rows.select("section_id", (F.coalesce(F.col("text") != "", F.lit(False)) | some("bibliography") | some("footnotes")).alias("emitted")).distinct()
