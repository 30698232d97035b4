"""Session settings the operators rely on."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

#: Set on every session that is built here; a session handed in from outside is used as it is.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def build(master: str = "local[*]", shuffle_partitions: int = 8, memory: str = "8g", **more: str) -> SparkSession:
    """A local session; on a cluster the caller's own session is passed to the operators instead."""
    conf = {**SETTINGS, "spark.sql.shuffle.partitions": str(shuffle_partitions), "spark.driver.memory": memory, **more}
    return SparkSession.builder.master(master).appName("foliant").config(map=conf).getOrCreate()


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder for cut lineage, as the session names it. A local session without one gets a temporary
    folder; on a cluster a folder that executors cannot share is refused."""
    context = spark.sparkContext
    if context.getCheckpointDir():
        return context.getCheckpointDir()
    folder = context.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not context.master.startswith("local[") and context.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="foliant-checkpoint-")
    context.setCheckpointDir(folder)
    return folder


def ship(spark: SparkSession) -> None:
    """Gives this package's code to the executors, once per session (they fetch it from the driver)."""
    context = spark.sparkContext
    if getattr(context, "_foliant_shipped", False):
        return
    root = Path(__file__).resolve().parent
    handle, path = tempfile.mkstemp(prefix="foliant-", suffix=".zip")
    os.close(handle)
    with zipfile.ZipFile(path, "w") as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, p.relative_to(root.parent))
    context.addPyFile(path)
    context._foliant_shipped = True
