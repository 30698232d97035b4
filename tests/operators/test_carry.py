from __future__ import annotations

import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from foliant.operators.carry import carried


@pytest.mark.parametrize("before", [False, True])
@pytest.mark.parametrize("ranges", [1, 3, 8])
def test_same_as_a_window(spark, ranges, before):
    rng = random.Random(ranges)
    data = [(rng.choice([1, 1, 1, 1, 2, 3, None]), i, rng.choice([None, None, i * 7 % 50])) for i in range(300)]
    df = spark.createDataFrame(data, "g int, i int, v int")
    kinds = {"l": ("last", F.col("v")), "m": ("max", F.col("v")), "s": ("sum", F.col("v"))}
    w = Window.partitionBy("g").orderBy("i").rowsBetween(Window.unboundedPreceding, -1 if before else 0)
    want = df.select("g", "i", "v", F.last("v", True).over(w).alias("l"), F.max("v").over(w).alias("m"), F.sum("v").over(w).alias("s"))
    got = carried(df, ["g"], ["i"], kinds, ranges, before)
    assert got.columns == want.columns
    key = lambda rows: sorted(map(tuple, rows), key=str)
    assert key(got.collect()) == key(want.collect())


def test_empty_and_clashing_names(spark):
    df = spark.createDataFrame([], "g int, i int, l int")
    assert carried(df, ["g"], ["i"], {"l": ("last", F.col("l"))}, 2).count() == 0
    one = spark.createDataFrame([(1, 1, 5), (1, 2, None)], "g int, i int, l int")
    assert sorted(tuple(r) for r in carried(one, ["g"], ["i"], {"l": ("last", F.col("l"))}, 2).collect()) == [(1, 1, 5), (1, 2, 5)]
