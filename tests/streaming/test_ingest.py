from __future__ import annotations

from pyspark.sql import functions as F

from foliant.streaming.ingest import arrivals, ingest


def test_each_content_is_read_once(spark, tmp_path):
    inbox, out = tmp_path / "in", str(tmp_path / "out")
    inbox.mkdir()
    read = lambda df: df.select("digest", F.decode("content", "UTF-8").alias("text"))

    def run(n):
        ingest(arrivals(spark, str(inbox), "*.txt"), out, str(tmp_path / f"check{n}"), read, once=True).awaitTermination(60)
        return sorted(r.text for r in spark.read.parquet(out).collect())

    (inbox / "a.txt").write_text("one")
    (inbox / "b.txt").write_text("one")
    (inbox / "c.bin").write_text("other")
    assert run(0) == ["one"]
    (inbox / "d.txt").write_text("two")
    assert run(0) == ["one", "two"]
    assert run(1) == ["one", "two"]  # another checkpoint sees all files again and writes none twice
