"""Script files, usage logs, lexicons and canon tiers as rows, and the sinks that write them."""

from __future__ import annotations

import tomllib

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from foliant.functions.text import playlist_title, stem

USAGE = "timestamp string, provider_label string, input_tokens bigint, output_tokens bigint, calls bigint, truncated bigint, cache_write_tokens bigint, cache_read_tokens bigint"


def read_scripts(spark: SparkSession, folder: str) -> DataFrame:
    """file, title, utt_idx, text, manner, lang: SC12. One file a section; files of unwoven notes are left out; a file
    without header is titled by its stem; a piece with a bad tag or without text is passed over; lang is en by default."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.txt").load(folder).where(~F.col("path").endswith(".unwoven.txt"))
    blocks = files.select(F.regexp_extract("path", r"([^/]+)\.txt$", 1).alias("file"), F.split(F.decode("content", "UTF-8"), "\n\n", -1).alias("b"))
    header = F.get("b", F.lit(0))
    title = F.when(header.startswith("[section]"), F.trim(F.regexp_replace(header, r"^\[section\]|\n", " "))).otherwise(F.col("file"))
    rows = blocks.select("file", title.alias("title"), F.posexplode("b").alias("utt_idx", "x")).where("utt_idx > 0")
    tag = F.trim(F.substring_index("x", "\n", 1))
    text = F.when(F.contains("x", F.lit("\n")), F.regexp_replace(F.expr("substring(x, locate('\n', x) + 1)"), r"^\s+|\s+$", "")).otherwise("")
    pattern = r"^\[(\w+)(?: lang=([\w-]+))?\]$"
    lang = F.regexp_extract(tag, pattern, 2)
    return rows.select("file", "title", "utt_idx", text.alias("text"), F.regexp_extract(tag, pattern, 1).alias("manner"), F.when(lang == "", "en").otherwise(lang).alias("lang"), tag.rlike(pattern).alias("ok")).where("ok and text <> ''").drop("ok")


def script_text(title: Column, utterances: Column) -> Column:
    """SK2: a section's file: header, then each utterance under its tag; the tag names the language unless it is en."""
    tag = lambda u: F.concat(F.lit("["), u["manner"], F.when(u["lang"] == "en", "").otherwise(F.concat(F.lit(" lang="), u["lang"])), F.lit("]\n"), u["text"])
    return F.concat(F.lit("[section] "), title, F.lit("\n\n"), F.array_join(F.transform(utterances, tag), "\n\n"), F.lit("\n"))


def scripts(utterances: DataFrame, titles: DataFrame, by: list[str], order: str) -> DataFrame:
    """`by`, file, content of each section's script (SK2); numbers from 1 by section within a document."""
    rows = F.array_sort(F.collect_list(F.struct(order, "text", "manner", F.coalesce("lang", F.lit("en")).alias("lang"))))
    sections = utterances.where("text is not null").groupBy(*by).agg(rows.alias("u")).join(titles, by)
    number = F.row_number().over(Window.partitionBy(by[0]).orderBy(*by[1:]))
    return sections.select(*by, stem(number, F.col("title")).alias("file"), script_text(F.col("title"), F.col("u")).alias("content"))


def write_texts(rows: DataFrame, folder: str, by: str) -> None:
    """SK1, SK2 at scale: `content` by `by` as text partitions; the committer makes the folder whole or not at all."""
    rows.select(by, "content").write.mode("overwrite").partitionBy(by).option("lineSep", "\n\n").text(folder)


def read_usage(spark: SparkSession, folder: str) -> DataFrame:
    """SC13: the usage log; lines that are blank, broken or hold other fields are passed over."""
    lines = spark.read.text(folder)
    names = [c.split()[0] for c in USAGE.split(", ")]
    keys = F.json_object_keys("value")
    parsed = lines.where(F.size(F.array_except(keys, F.array(*[F.lit(n) for n in names]))) == 0).select(F.from_json("value", USAGE, {"mode": "PERMISSIVE"}).alias("u"))
    return parsed.select("u.*").where("timestamp is not null and input_tokens is not null and output_tokens is not null")


def append_usage(rows: DataFrame, folder: str) -> None:
    """SK4."""
    rows.write.mode("append").json(folder)


def read_lexicon(spark: SparkSession, path: str) -> DataFrame:
    """term, mechanism, value: SC14. Keys with an underscore first and entries that are no object or name no mechanism go."""
    raw = spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", "map<string, map<string, string>>")).alias("term", "entry"))
    rows = raw.where(~F.col("term").startswith("_") & F.col("entry").isNotNull()).select("term", F.explode("entry").alias("mechanism", "value"))
    return rows.where(F.col("mechanism").isin("phonemes", "respelling", "lang"))


def canon_tier(spark: SparkSession, toml: str, system: str) -> DataFrame:
    """siglum, spoken: SC15, the entries of one system of a tier file's text; plain values or tables with `spoken`."""
    found = tomllib.loads(toml).get(system, {})
    rows = [(k, v if isinstance(v, str) else v.get("spoken") if isinstance(v, dict) else None) for k, v in found.items()]
    return spark.createDataFrame(rows, "siglum string, spoken string")


def digests(spark: SparkSession, folder: str) -> DataFrame:
    """path, digest: SC18."""
    return spark.read.format("binaryFile").load(folder).select("path", F.sha2("content", 256).alias("digest"))


def playlist(tracks: DataFrame, by: str) -> DataFrame:
    """`by`, content: SK11. Tracks hold section_idx, title, seconds, reciter, file; the header, the reciters once each, then
    each track's length (rounded half to even) and title."""
    line = F.concat(F.lit("#EXTINF:"), F.bround("seconds", 0).cast("bigint").cast("string"), F.lit(","), playlist_title("title"), F.lit("\n"), F.col("file"))
    grouped = tracks.groupBy(by).agg(F.sort_array(F.collect_set("reciter")).alias("r"), F.array_sort(F.collect_list(F.struct("section_idx", line.alias("line")))).alias("t"))
    reciters = F.transform("r", lambda r: F.concat(F.lit("# reciter: "), r))
    return grouped.select(by, F.concat(F.array_join(F.concat(F.array(F.lit("#EXTM3U")), reciters, F.transform("t", lambda t: t["line"])), "\n"), F.lit("\n")).alias("content"))
