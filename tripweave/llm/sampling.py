"""Label split and bounded training samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def held_out(parts: int, remainder: int, doc_id: str = "doc_id") -> Column:
    """Rows whose crc32 of the id as text leaves ``remainder``; rows without id are never learned from either."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % parts == remainder, F.lit(True))


def labelled_sample(labels: DataFrame, label: str, held: Column, rows: int) -> DataFrame:
    """(train_id, label): up to ``rows`` labelled ids that are not held out, spread by a hash of the id."""
    known = labels.filter(~held & F.col(label).isNotNull()).select(F.col("doc_id").alias("train_id"), F.col(label).alias("label"))
    return known.dropDuplicates(["train_id"]).orderBy(F.xxhash64("train_id"), "train_id").limit(rows)
