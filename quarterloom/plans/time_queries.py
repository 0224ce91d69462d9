"""Queries of the time-normalisation operator."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarterloom.operators.timestamps import dirty_time_values
from quarterloom.sources import table


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    tables = {
        "recent_corpus": (table(spark, folder, "recent_corpus"), "recent_id", ["call_date"]),
        "tech_uncertainty_features": (table(spark, folder, "tech_uncertainty_features"), "feature_id", ["earnings_date", "datacqtr", "datafqtr"]),
    }
    return dirty_time_values(tables, table(spark, folder, "call_feeds"))


def p1_forms(spark: SparkSession, folder: str) -> DataFrame:
    """How many values of each field had to be brought to which form."""
    form = F.when(F.col("norm").contains("Q"), "quarter").when(F.col("norm").contains("T"), "moment").otherwise("date")
    return p1_found(spark, folder).groupBy("rec_table", "field", form.alias("form")).agg(F.count("*").alias("n_values"))


QUERIES = {"p1_found": p1_found, "p1_forms": p1_forms}
ORACLE: dict[str, str] = {}
