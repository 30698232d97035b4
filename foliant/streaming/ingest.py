"""Books that arrive in a folder, each read once: an extension beyond the reference, which has no streams.

Structured Streaming lists the files; every micro-batch is read by the batch reader, and files whose digest is already in
the target are left out by an anti join, so a batch that is run again after a failure writes nothing twice."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

FILES = "path string, modificationTime timestamp, length bigint, content binary"


def arrivals(spark: SparkSession, folder: str, pattern: str = "*") -> DataFrame:
    """path, digest, content of the files of a folder as they arrive."""
    files = spark.readStream.format("binaryFile").option("pathGlobFilter", pattern).schema(FILES).load(folder)
    return files.select("path", F.sha2("content", 256).alias("digest"), "content")


def ingest(files: DataFrame, target: str, checkpoint: str, read: Callable[[DataFrame], DataFrame], once: bool = False) -> StreamingQuery:
    """Appends `read(files)` of every new digest to the Parquet folder `target`; `read` keeps the column digest."""

    def batch(df: DataFrame, _: int) -> None:
        new = df.dropDuplicates(["digest"])
        try:
            new = new.join(df.sparkSession.read.parquet(target).select("digest").distinct(), "digest", "left_anti")
        except Exception as e:  # the first batch finds no target
            if "PATH_NOT_FOUND" not in str(e):
                raise
        read(new).write.mode("append").parquet(target)

    writer = files.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
