from __future__ import annotations

from datetime import datetime

from foliant.sources.tables import latest


def test_latest_keeps_the_newest_row_and_every_row_without_key(spark):
    day = datetime(2025, 5, 29)
    rows = [(1, "old", None), (1, "new", day), (2, "only", None), (None, "a", day), (None, "b", day)]
    df = spark.createDataFrame(rows, "id bigint, text string, loaded_at timestamp_ntz")
    got = sorted((r.id or 0, r.text) for r in latest(df, "id").collect())
    assert got == [(0, "a"), (0, "b"), (1, "new"), (2, "only")]
