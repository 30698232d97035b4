"""Values carried along an order - the last label, the largest page, running counts - without one task for a whole group.

A plain window sorts each group in one task, so one book that holds a third of all rows makes one task of it. Here rows
are dealt out by ranges of (group, order), so a large group lies in many ranges; each range is scanned by itself, and what
the ranges before a group's rows hand over is worked out from one row a range. Only groups that cross a range's end have
such rows: at most one a range, which is the proven bound of what is broadcast.

Kinds: `last` (last value that is not null), `max`, `sum`. Rows whose order is equal are in no defined order; give an order
that is unique in the group. Nulls: `last` and `max` pass over them, `sum` adds nothing; before a first value the result is null.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliant.session import checkpoint_dir


def _over(kind: str, value: Column, window) -> Column:
    return F.last(value, ignorenulls=True).over(window) if kind == "last" else (F.max if kind == "max" else F.sum)(value).over(window)


def _joined(kind: str, before: Column, own: Column) -> Column:
    if kind == "last":
        return F.coalesce(own, before)
    if kind == "max":
        return F.greatest(before, own)
    return F.when(before.isNull() & own.isNull(), F.lit(None)).otherwise(F.coalesce(before, F.lit(0)) + F.coalesce(own, F.lit(0)))


def carried(rows: DataFrame, by: list[str], order: list[str], values: dict[str, tuple[str, Column]], ranges: int | None = None, before: bool = False) -> DataFrame:
    """`rows` with a column for each of `values` (name: (kind, value)), of all rows of the group up to this one; with
    `before`, without this one. `ranges` is the number of ranges, the session's shuffle partitions by default."""
    spark = rows.sparkSession
    checkpoint_dir(spark)
    n = ranges or int(spark.conf.get("spark.sql.shuffle.partitions"))
    own = {f"__v{i}": v for i, (_, v) in enumerate(values.values())}
    kinds = [k for k, _ in values.values()]
    # The ranges come from a sample, so they are fixed by a checkpoint: the two reads below must see the same ones.
    dealt = rows.withColumns(own).repartitionByRange(n, *by, *order).withColumn("__range", F.spark_partition_id()).checkpoint()
    group = F.struct(*by)
    within = Window.partitionBy("__range", *by).orderBy(*order)
    frame = within.rowsBetween(Window.unboundedPreceding, -1 if before else 0)
    # One row a range and group that begins or ends there with the range's own first or last group.
    ends = dealt.groupBy("__range").agg(F.min(group).alias("lo"), F.max(group).alias("hi"))
    crossing = ends.select(F.explode(F.array("lo", "hi")).alias("g")).groupBy("g").agg(F.count("*").alias("k")).where("k > 1").select(*[F.col(f"g.{c}").alias(c) for c in by])
    last = {k: F.max_by(F.col(k), F.when(F.col(k).isNotNull(), F.struct(*order))).alias(k) if kind == "last" else (F.max if kind == "max" else F.sum)(k).alias(k) for k, kind in zip(own, kinds)}
    same = lambda a, b: [a[c].eqNullSafe(b[c]) for c in by]
    summary = dealt.join(F.broadcast(crossing), same(dealt, crossing), "left_semi").groupBy("__range", *by).agg(*last.values())
    along = Window.partitionBy(*by).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    handed = summary.select(F.col("__range").alias("__r"), *[F.col(c).alias(f"__g{i}") for i, c in enumerate(by)], *[_over(kind, F.col(k), along).alias(f"__h{i}") for i, (k, kind) in enumerate(zip(own, kinds))])
    scanned = dealt.withColumns({f"__s{i}": _over(kind, F.col(k), frame) for i, (k, kind) in enumerate(zip(own, kinds))})
    at = [scanned["__range"] == handed["__r"], *[scanned[c].eqNullSafe(handed[f"__g{i}"]) for i, c in enumerate(by)]]
    out = scanned.join(F.broadcast(handed), at, "left")
    columns = [F.col(c) for c in rows.columns if c not in values]
    return out.select(*columns, *[_joined(kind, F.col(f"__h{i}"), F.col(f"__s{i}")).alias(name) for i, (name, kind) in enumerate(zip(values, kinds))])
