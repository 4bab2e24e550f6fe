"""The stored label log: append-only Parquet, read through ``labels.latest_labels``."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tripweave.config import ENTITY
from tripweave.operators.labels import latest_labels
from tripweave.schema import LABELS


def labels_table(spark: SparkSession, path: str) -> DataFrame:
    """Every label ever written; empty when there is none."""
    try:
        return spark.read.schema(LABELS).parquet(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], LABELS)


def append_labels(new: DataFrame, path: str, now: Column | None = None) -> None:
    """Add one or many labels; optional notes, stamped with the current time unless given."""
    defaults = {"notes": F.lit(""), "labeled_at": F.current_timestamp() if now is None else now}
    new = new.withColumns({c: v for c, v in defaults.items() if c not in new.columns})
    new.select(*[F.col(f.name).cast(f.dataType) for f in LABELS]).write.mode("append").parquet(path)


def compact_labels(spark: SparkSession, path: str, to: str, entity: Sequence[str] = ENTITY) -> None:
    """Write the live labels alone to a new location, once superseded entries dominate."""
    latest_labels(labels_table(spark, path), entity).write.parquet(to)
