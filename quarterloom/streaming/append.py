"""Appending newer quarters to a panel as they arrive.

Each micro-batch keeps one row per key, drops quarters the panel already has for the ticker, and is written as new files; a
batch that is run again writes the same folder anew, so a restart leaves no double rows.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from quarterloom.operators.panel import keep_best, strictly_newer

KEYS = ["ticker", "year", "quarter"]


def append_newer(stream: DataFrame, panel: DataFrame, target: str, checkpoint: str, tiebreak: str) -> StreamingQuery:
    """Starts the query. stream: rows with ticker, year, quarter; panel: what is there already; target: folder of the new rows."""

    def batch(rows: DataFrame, number: int) -> None:
        newer = strictly_newer(keep_best(rows, KEYS, [-F.col(tiebreak)]), panel)
        newer.write.mode("overwrite").parquet(os.path.join(target, f"batch={number}"))

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_counts(stream: DataFrame, stamp: str, kind: str, late: str = "10 minutes", width: str = "1 hour") -> DataFrame:
    """Counts per kind and window of event time; rows later than the watermark are left out."""
    return stream.withWatermark(stamp, late).groupBy(F.window(stamp, width), kind).agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), kind, "n")
