"""Sigla, caches, scripts, recitation plans, usage and lexicons: the relational part."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Fixed values.
SAMPLE = 3
PARAGRAPH_PAUSE, DIGRESSION_PAUSE = 0.6, 0.35


def paired_sigla(citations: DataFrame, order: str, *kept: str) -> DataFrame:
    """author, siglum, n, sample: A5, O6. The count of citations and the first three of them by `order`, as an array of
    the columns `kept`. The sample is cut on the map side: a group never holds more than three a partition."""
    fields = F.struct(*kept)
    w = Window.partitionBy("author", "siglum").orderBy(order)
    n = citations.groupBy("author", "siglum").agg(F.count("*").alias("n"))
    first = citations.withColumn("__k", F.row_number().over(w)).where(f"__k <= {SAMPLE}")
    sample = first.groupBy("author", "siglum").agg(F.transform(F.array_sort(F.collect_list(F.struct("__k", fields.alias("f")))), lambda x: x["f"]).alias("sample"))
    return n.join(sample, (n["author"].eqNullSafe(sample["author"])) & (n["siglum"].eqNullSafe(sample["siglum"]))).select(n["author"], n["siglum"], "n", "sample")


def colliding_sigla(pairs: DataFrame) -> DataFrame:
    """siglum, authors (sorted): A6. Sigla that stand for several authors; null sigla are none."""
    named = pairs.where("siglum is not null and author is not null").select("siglum", "author").distinct()
    return named.groupBy("siglum").agg(F.sort_array(F.collect_list("author")).alias("authors")).where(F.size("authors") > 1)


def overlaid(*tiers: DataFrame, key: str = "siglum", value: str = "spoken") -> DataFrame:
    """`key`, `value`, tier: J12. Of several tiers (first to last) the last that has a value holds; one aggregation."""
    rows = None
    for n, t in enumerate(tiers):
        part = t.where(F.col(value).isNotNull() & (F.col(value) != "")).select(key, value, F.lit(n).alias("tier"))
        rows = part if rows is None else rows.unionByName(part)
    return rows.groupBy(key).agg(F.max_by(value, F.struct("tier", value)).alias(value), F.max("tier").alias("tier"))


def promoted(upper: DataFrame, lower: DataFrame, key: str = "siglum", value: str = "spoken") -> DataFrame:
    """SK7: the resolved entries of the upper tier, without keys that begin with an underscore, that the lower one lacks."""
    ready = upper.where(F.col(value).isNotNull() & (F.col(value) != "") & ~F.col(key).startswith("_"))
    return ready.join(lower.select(key), key, "left_anti").select(key, value)


def draft_candidates(pairs: DataFrame, known: DataFrame, ambiguous: DataFrame) -> DataFrame:
    """sigla that are neither known nor ambiguous, once each."""
    return pairs.where("siglum is not null").select("siglum").distinct().join(known.select("siglum"), "siglum", "left_anti").join(ambiguous.select("siglum"), "siglum", "left_anti")


def language_counts(utterances: DataFrame) -> DataFrame:
    """lang, n of the utterances in another language than English, the most common first."""
    return utterances.where("lang is not null and lang <> 'en'").groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang")


def pauses(utterances: DataFrame, by: list[str], order: str, spoken: Column) -> DataFrame:
    """Adds pause, in seconds before the utterance: W13. Of the spoken ones; short next to a digression; the first has 0."""
    w = Window.partitionBy(*by).orderBy(order)
    aside = (F.col("manner") == "digression") | (F.lag("manner").over(w) == "digression")
    first = F.row_number().over(w) == 1
    return utterances.where(spoken).withColumn("pause", F.when(first, 0.0).when(aside, DIGRESSION_PAUSE).otherwise(PARAGRAPH_PAUSE))


def chapter_offsets(chapters: DataFrame, by: list[str], order: str, length: str) -> DataFrame:
    """Adds start_at, end_at, running sums of `length`: W14, SK12."""
    total = F.sum(length).over(Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, 0))
    return chapters.withColumn("end_at", total).withColumn("start_at", F.col("end_at") - F.col(length))


def output_average(usage: DataFrame) -> DataFrame:
    """average: A14. Output tokens a call that was not cut short; null without such calls."""
    calls = F.sum("calls") - F.sum(F.coalesce("truncated", F.lit(0)))
    return usage.agg(F.when(calls > 0, F.sum("output_tokens") / calls).alias("average"))


def cache_state(wanted: DataFrame, cache: DataFrame, key: str) -> DataFrame:
    """`key`, state (`hit`, `miss`, `stale`): J11, A17, by one full join of the distinct keys."""
    a = wanted.select(key).where(F.col(key).isNotNull()).distinct().withColumn("__w", F.lit(1))
    b = cache.select(key).where(F.col(key).isNotNull()).distinct().withColumn("__c", F.lit(1))
    state = F.when(F.col("__c").isNull(), "miss").when(F.col("__w").isNull(), "stale").otherwise("hit")
    return a.join(b, key, "full").select(key, state.alias("state"))


def signatures(utterances: DataFrame, by: list[str], order: str, *fields: str) -> DataFrame:
    """`by`, signature: T17, the hash of a section's utterances in order. Each utterance is hashed first, so a group
    gathers digests, not texts."""
    digest = F.sha2(F.to_json(F.struct(*fields), {"ignoreNullFields": "false"}), 256)
    rows = utterances.select(*by, F.struct(F.col(order).alias("o"), digest.alias("d")).alias("x"))
    return rows.groupBy(*by).agg(F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["d"]), ""), 256).alias("signature"))


def changed(signature: DataFrame, kept: DataFrame, by: list[str]) -> DataFrame:
    """the sections whose signature is not kept yet."""
    return signature.join(kept.select(*by, "signature"), [*by, "signature"], "left_anti")


def term_counts(texts: DataFrame, terms: DataFrame, text: str = "text", term: str = "term") -> DataFrame:
    """`term`, n, texts: A15, O4, J15. Occurrences of the terms as whole words: words are counted by text and term
    first, and joined with the terms; no text is compared with a list."""
    numbered = texts.select(F.monotonically_increasing_id().alias("__t"), F.regexp_extract_all(F.col(text), F.lit(r"(\w+)"), F.lit(1)).alias("__words"))
    words = numbered.select("__t", F.explode("__words").alias(term))
    counted = words.groupBy("__t", term).agg(F.count("*").alias("__n")).groupBy(term).agg(F.sum("__n").alias("n"), F.count("*").alias("texts"))
    return terms.select(term).distinct().join(counted, term).orderBy(F.desc("n"), term)


def blended(vectors: DataFrame, by: str, vector: str, weight: Column) -> DataFrame:
    """`by`, vector: T21, the weighted mean of the vectors by place; computed by place, so no vector list is gathered."""
    rows = vectors.select(by, weight.alias("__w"), F.posexplode(vector).alias("__i", "__x"))
    means = rows.groupBy(by, "__i").agg((F.sum(F.col("__x").cast("double") * F.col("__w")) / F.sum("__w")).alias("__m"))
    return means.groupBy(by).agg(F.transform(F.array_sort(F.collect_list(F.struct("__i", "__m"))), lambda x: x["__m"]).alias(vector))
