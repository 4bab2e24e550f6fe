"""The derived point store: Parquet partitioned by local date and entity bucket, in snapshots.

Every write publishes a new version by one rename (see ``snapshots``): a job that fails changes nothing, and a frame that was read before keeps its
rows. A folder without manifest, as older stores and folders of several stores are, is read as it lies and rewritten at the first write.
"""

from __future__ import annotations

import datetime
from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tripweave.config import ENTITY
from tripweave.schema import POINTS
from tripweave.sources import snapshots
from tripweave.sources.storage import drop_partition, partition_values

PARTITIONS = ("local_date", "entity_bucket")


def with_bucket(pts: DataFrame, buckets: int, entity: Sequence[str] = ENTITY) -> DataFrame:
    return pts.withColumn("entity_bucket", F.pmod(F.xxhash64(*entity), F.lit(buckets)).cast("int"))


def stored_buckets(spark: SparkSession, path: str) -> int | None:
    """The bucket count that the store was written with; None where there is no data, 0 where it does not say."""
    snap = snapshots.snapshot(spark, path)
    if snap:
        return snap.buckets if snap.parts else None
    return 0 if partition_values(spark, path, "local_date") else None


def settle_buckets(spark: SparkSession, path: str, buckets: int | None, entity: Sequence[str] = ENTITY) -> int:
    """The bucket count to write with: the store's own unless another is asked for, to which the store is then rewritten."""
    have = stored_buckets(spark, path)
    if have is None:
        return buckets or 1
    if have and buckets in (None, have):
        return have
    rebucket(spark, path, buckets or 1, entity)
    return buckets or 1


def rebucket(spark: SparkSession, path: str, buckets: int, entity: Sequence[str] = ENTITY) -> None:
    """The whole store with another bucket count; no row is lost or doubled."""
    whole = points_table(spark, path).drop("entity_bucket")
    old = [] if snapshots.snapshot(spark, path) else partition_values(spark, path, "local_date")
    _write(whole, path, buckets, "static", entity)
    for date in old:  # files from before the first manifest, which names all their rows now
        drop_partition(spark, path, "local_date", date)


def _write(pts: DataFrame, path: str, buckets: int, replaces: str, entity: Sequence[str], dates: Sequence[str] = ()) -> None:
    """A new version. It replaces the whole store (``static``), the ``days`` that have rows, or the ``partitions`` that have; and all ``dates``.

    ``rebalance`` lets AQE split an oversized (date, bucket) over several files and join
    small ones, so a crowded day is not written by one task."""
    spark = pts.sparkSession
    before = snapshots.snapshot(spark, path)
    folder = snapshots.new_folder(before)
    with_bucket(pts, buckets, entity).hint("rebalance", *PARTITIONS).write.partitionBy(*PARTITIONS).parquet(f"{path}/{folder}")
    new = snapshots.written(spark, path, folder)
    kept = {} if replaces == "static" or before is None else {d: dict(by) for d, by in before.parts.items() if d not in set(dates)}
    for date, by_bucket in new.items():
        kept[date] = {**kept.get(date, {}), **by_bucket} if replaces == "partitions" else by_bucket
    snapshots.commit(spark, path, before, buckets, kept, {folder: sum(map(len, new.values()))})


def write_partitions(pts: DataFrame, path: str, buckets: int, entity: Sequence[str] = ENTITY) -> None:
    """Replace the (date, bucket) partitions present in ``pts``, which hold all that should be left in them."""
    _write(pts, path, buckets, "partitions", entity)


def write_points(
    pts: DataFrame, path: str, buckets: int | None = None, overwrite: str = "dynamic", entity: Sequence[str] = ENTITY
) -> None:
    """Replace the days present in ``pts``, all their buckets; other days stay."""
    if overwrite == "static":
        _write(pts, path, buckets or 1, "static", entity)
        return
    _write(pts, path, settle_buckets(pts.sparkSession, path, buckets, entity), "days", entity)


def replace_rows(
    spark: SparkSession, new: DataFrame, replaced: Column, dates: Sequence[str], path: str, buckets: int, entity: Sequence[str] = ENTITY,
) -> None:
    """On ``dates``, stored rows that are ``replaced`` give way to ``new``; all others are carried over. A day without rows is gone."""
    days = F.col("local_date").isin([datetime.date.fromisoformat(d) for d in dates])
    carried = points_table(spark, path).filter(days & ~F.coalesce(replaced, F.lit(False))).drop("entity_bucket")
    rows = new if carried.isEmpty() else new.unionByName(carried, allowMissingColumns=True)
    _write(rows, path, buckets, "days", entity, dates)


def points_table(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """All derived points, columns united by name; a declared empty frame when none exist. ``version`` reads an earlier state."""
    snap = snapshots.snapshot(spark, path, version)
    if snap or version is not None:
        if snap is None:
            raise ValueError(f"no version {version} of {path}; there are {snapshots.versions(spark, path)}")
        rows = snapshots.files_of(spark, path, snap)
        return spark.createDataFrame([], POINTS) if rows is None else rows
    try:
        return spark.read.option("mergeSchema", "true").parquet(path)
    except AnalysisException as error:
        if error.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise
        return spark.createDataFrame([], POINTS)


def stored_dates(spark: SparkSession, path: str) -> list[str]:
    """Local dates with derived data, from the manifest or the directory listing alone."""
    snap = snapshots.snapshot(spark, path)
    return snap.dates() if snap else partition_values(spark, path, "local_date")


def clean_range(spark: SparkSession, path: str, since: str | None = None, until: str | None = None) -> list[str]:
    """Drop derived days inside the (inclusive) range, all at once; returns the dropped dates."""
    settle_buckets(spark, path, None)
    snap = snapshots.snapshot(spark, path)
    doomed = [d for d in stored_dates(spark, path) if (not since or d >= since) and (not until or d <= until)]
    if doomed:
        snapshots.commit(spark, path, snap, snap.buckets, {d: by for d, by in snap.parts.items() if d not in set(doomed)}, {})
    return doomed
