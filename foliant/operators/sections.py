"""Sections as paragraphs, lines and whole texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliant.functions.text import col


def paragraphs(df: DataFrame, text: str = "text", position: str = "paragraph_no", out: str = "paragraph") -> DataFrame:
    """One row per non-blank paragraph (PJ1): the text is cut at empty lines and not stripped; null gives no row.
    `position` counts the pieces from 0, blank ones too. Narrow; columns of these names are replaced."""
    kept = [F.col(c) for c in df.columns if c not in (position, out)]
    rows = df.select(*kept, F.posexplode(F.split(text, "\n\n", -1)).alias(position, out)).where(F.trim(F.regexp_replace(out, r"\s", " ")) != "")
    return rows.withColumn(position, F.col(position).cast("bigint"))


def lines(df: DataFrame, text: str = "text") -> DataFrame:
    """The columns of `df` but the text, line_no from 0, line. Narrow; null gives no row."""
    kept = [F.col(c) for c in df.columns if c not in (text, "line_no", "line")]
    return df.select(*kept, F.posexplode(F.split(text, "\n", -1)).alias("line_no", "line")).withColumn("line_no", F.col("line_no").cast("bigint"))


def whole_text(df: DataFrame, by: list[str], order: list[str], text: str = "text") -> DataFrame:
    """`by`, text: PJ2, the texts that are not empty, in order, with an empty line between."""
    rows = F.array_sort(F.collect_list(F.struct(*order, F.col(text).alias("__text"))))
    return df.where(F.col(text) != "").groupBy(*by).agg(F.array_join(F.transform(rows, lambda r: r["__text"]), "\n\n").alias(text))


def request_text(title: str | Column, text: str | Column, notes: str | Column) -> Column:
    """PJ12, PJ13: title, text and notes of a section as one request; no notes, no list."""
    listed = F.array_join(F.transform(col(notes), lambda n: F.concat(F.lit("[^"), n["ref"], F.lit("]: "), n["text"])), "\n")
    return F.concat(col(title), F.lit("\n\n"), col(text), F.when(F.size(col(notes)) > 0, F.concat(F.lit("\n\n"), listed)).otherwise(F.lit("")))
