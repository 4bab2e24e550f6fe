"""Status summary of the stores."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F

from tripweave.operators.analytics import list_dates
from tripweave.operators.labels import label_count
from tripweave.sources.raw import raw_counts


def health(raw: DataFrame, ledger: DataFrame, labels: DataFrame, pts: DataFrame) -> DataFrame:
    """(metric, value) rows: message, unexported and label counts, and one row per stored date."""
    counts = raw_counts(raw, ledger).unpivot([], ["total_records", "unsynced_records"], "metric", "value")
    parts = [
        counts.select("metric", F.col("value").cast("string").alias("value")),
        label_count(labels).select(F.lit("label_count").alias("metric"), F.col("label_count").cast("string").alias("value")),
        list_dates(pts).select(F.lit("derived_date").alias("metric"), F.col("local_date").cast("string").alias("value")),
    ]
    return reduce(DataFrame.unionByName, parts)
