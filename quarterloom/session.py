"""Session settings shared by queries, tests and the bench."""

from __future__ import annotations

import atexit
import os
import re
import tempfile
import zipfile

from pyspark.sql import DataFrame, SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # Small files are split over the cores by the size of the splits, not by a shuffle.
    "spark.sql.files.openCostInBytes": "65536",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def local_session(cores: int | str = 8, shuffle_partitions: int = 8, memory: str = "8g", **extra: str) -> SparkSession:
    """A local session for tests and the bench; a cluster brings its own."""
    builder = SparkSession.builder.master(f"local[{cores}]").appName("quarterloom").config("spark.driver.memory", memory)
    for key, value in (SETTINGS | {"spark.sql.shuffle.partitions": str(shuffle_partitions)} | extra).items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_folder(spark: SparkSession) -> str:
    """The shared folder the cluster names. Only a local session without one gets one of our own; a cluster without one is refused."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        if not folder and not re.fullmatch(r"local(\[[^\]]*\])?", context.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        context.setCheckpointDir(folder or os.path.join(tempfile.gettempdir(), "quarterloom-checkpoint"))
    return folder or context._jsc.sc().getCheckpointDir().get()


def ship(spark: SparkSession) -> None:
    """Sends this package to the Python workers, once per context, so that they need no path of their own to it."""
    context = spark.sparkContext
    if getattr(context, "_quarterloom_shipped", False):
        return
    root = os.path.dirname(os.path.abspath(__file__))
    # Served from the driver; the executors fetch it. It goes when the driver ends.
    aside = tempfile.TemporaryDirectory()
    atexit.register(aside.cleanup)
    path = os.path.join(aside.name, "quarterloom.zip")
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as archive:
        for folder, _, files in os.walk(root):
            for name in sorted(files):
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    archive.write(full, os.path.relpath(full, os.path.dirname(root)))
    context.addPyFile(path)
    context._quarterloom_shipped = True


def cut_lineage(df: DataFrame) -> DataFrame:
    """A reliable checkpoint in the shared folder, which outlives any executor."""
    checkpoint_folder(df.sparkSession)
    return df.checkpoint(eager=True)
