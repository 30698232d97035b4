"""Readers of the Parquet tables and the rule for repeated rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """One Parquet table of `folder`; columns are pruned by the plan that reads it."""
    return spark.read.parquet(f"{folder}/{name}.parquet")


def latest(df: DataFrame, key: str, at: str = "loaded_at") -> DataFrame:
    """One row per key, the one loaded last.

    Repeated rows carry the same content, so only the newest load is kept. Rows whose key is null are no repeats of
    each other and all pass; a null load time sorts first. The choice is a partial aggregation (max_by), not a window sort.
    """
    rest = [c for c in df.columns if c != key]
    never = F.lit("0001-01-01 00:00:00").cast("timestamp_ntz")
    own = F.when(F.col(key).isNull(), F.monotonically_increasing_id())
    one = df.withColumn("__own", own).groupBy(key, "__own").agg(F.max_by(F.struct(*rest), F.coalesce(F.col(at).cast("timestamp_ntz"), never)).alias("__row"))
    return one.select(key, *[F.col("__row")[c].alias(c) for c in rest]).select(*df.columns)
