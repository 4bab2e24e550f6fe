"""Human corrections: an append-only label log and the views derived from it."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from tripweave.config import ENTITY

_KEY = ("commute_id", "segment_id")


def latest_labels(log: DataFrame, entity: Sequence[str] = ENTITY) -> DataFrame:
    """One live label per (trip, segment): the newest entry of the log.

    Map-side ``max_by`` keeps one row per key before anything is shuffled, so a key
    relabelled many times does not gather its history anywhere.
    """
    keys = [*entity, *_KEY]
    rest = [c for c in log.columns if c not in keys]
    newest = F.struct(F.col("labeled_at"), *[F.col(c) for c in rest if c != "labeled_at"])
    live = log.groupBy(*keys).agg(F.max(newest).alias("_live"))
    return live.select(*[F.col(f"_live.{c}").alias(c) if c in rest else F.col(c) for c in log.columns])


def upsert_labels(log: DataFrame, new: DataFrame) -> DataFrame:
    """Label log after adding one or many labels; read it through ``latest_labels``."""
    return log.unionByName(new.select(*log.columns))


def list_labels(log: DataFrame, commute_id: str | None = None, entity: Sequence[str] = ENTITY) -> DataFrame:
    live = latest_labels(log, entity)
    if commute_id:
        live = live.filter(F.col("commute_id") == commute_id)
    return live.orderBy(*entity, *_KEY)


def corrections_map(log: DataFrame, entity: Sequence[str] = ENTITY) -> DataFrame:
    """``"<trip>:<segment>"`` -> corrected mode."""
    return latest_labels(log, entity).select(
        *entity, F.concat_ws(":", "commute_id", F.col("segment_id").cast("string")).alias("key"), "corrected_mode"
    )


def export_json(log: DataFrame, entity: Sequence[str] = ENTITY) -> DataFrame:
    """One JSON document per live label."""
    return latest_labels(log, entity).select(F.to_json(F.struct(*log.columns)).alias("value"))


def label_count(log: DataFrame, entity: Sequence[str] = ENTITY) -> DataFrame:
    return log.select(*entity, *_KEY).distinct().agg(F.count("*").alias("label_count"))


def _correction(points: DataFrame, log: DataFrame, entity: Sequence[str]) -> DataFrame:
    """Points with ``_corrected``. Points outside trips get a spread-out join key that no
    label carries, so they do not pile up under one null key if the join shuffles."""
    labels = latest_labels(log, entity).select(
        *entity,
        F.col("commute_id").alias("_trip"),
        F.col("segment_id").alias("_segment"),
        F.col("corrected_mode").alias("_corrected"),
    )
    spread = F.concat(F.lit("#"), F.pmod(F.xxhash64("record_id"), F.lit(1 << 16)).cast("string"))
    keyed = points.withColumns(
        {
            "_trip": F.coalesce("commute_id", spread),
            "_segment": F.coalesce(F.col("segment_id"), F.lit(-1).cast("long")),
        }
    )
    return keyed.join(labels, [*entity, "_trip", "_segment"], "left").drop("_trip", "_segment")


def apply_corrections(points: DataFrame, log: DataFrame | None, entity: Sequence[str] = ENTITY) -> DataFrame:
    """Override the mode of labelled segments; ``predicted_mode`` keeps the classifier's."""
    points = points.withColumn("predicted_mode", F.col("transport_mode"))
    if log is None:
        return points
    points = _correction(points, log, entity)
    corrected = F.when(F.col("_corrected") != "", F.col("_corrected"))
    return points.withColumn("transport_mode", F.coalesce(corrected, F.col("transport_mode"))).drop("_corrected")


def labelled_points(points: DataFrame, log: DataFrame, entity: Sequence[str] = ENTITY) -> DataFrame:
    """Inner join of points with the label of their segment."""
    return (
        _correction(points.filter("commute_id is not null"), log, entity)
        .filter("_corrected is not null")
        .withColumnRenamed("_corrected", "corrected_mode")
    )


def restrict_to_labelled(
    frame: DataFrame, log: DataFrame, commute_ids: Sequence[str] | None = None, entity: Sequence[str] = ENTITY
) -> DataFrame:
    """Rows of labelled trips, optionally only the given trip ids."""
    trips = log.select(*entity, "commute_id").distinct()
    if commute_ids is not None:
        trips = trips.filter(F.col("commute_id").isin(list(commute_ids)))
    return frame.join(trips, [*entity, "commute_id"], "left_semi")


def orphaned_labels(log: DataFrame, trips: DataFrame, entity: Sequence[str] = ENTITY) -> DataFrame:
    """Live labels whose trip no longer exists."""
    key = [*entity, "commute_id"]
    return latest_labels(log, entity).join(trips.select(*key).distinct(), key, "left_anti")


def migration_map(log: DataFrame, trips: DataFrame, entity: Sequence[str] = ENTITY) -> DataFrame:
    """Orphaned trip id -> existing id one day earlier or, failing that, one day later."""
    key = [*entity, "commute_id"]
    # Fixed value: shape of a trip id.
    shape = r"^(\d{4}-\d{2}-\d{2})-(morning|evening)"
    orphans = orphaned_labels(log, trips, entity).select(*key).distinct().filter(F.col("commute_id").rlike(shape))
    day = F.to_date(F.regexp_extract("commute_id", shape, 1))
    candidates = orphans.select(
        *entity,
        F.col("commute_id").alias("old_id"),
        F.explode(F.array(F.lit(-1), F.lit(1))).alias("shift"),
        day.alias("day"),
        F.regexp_extract("commute_id", shape, 2).alias("direction"),
    ).withColumn("commute_id", F.concat_ws("-", F.date_add("day", F.col("shift")).cast("string"), "direction"))
    known = candidates.join(trips.select(*key).distinct(), key, "left_semi")
    return known.groupBy(*entity, "old_id").agg(F.min_by("commute_id", "shift").alias("new_id"))


def migrate_labels(log: DataFrame, trips: DataFrame, entity: Sequence[str] = ENTITY) -> DataFrame:
    """Label log with orphaned trip ids renamed."""
    moves = migration_map(log, trips, entity).withColumnRenamed("old_id", "commute_id")
    moved = log.join(moves, [*entity, "commute_id"], "left")
    return moved.withColumn("commute_id", F.coalesce("new_id", "commute_id")).select(*log.columns)


def confirm_segments(segments: DataFrame, log: DataFrame, now: Column, entity: Sequence[str] = ENTITY) -> DataFrame:
    """New labels that confirm the mode of every segment without one."""
    keys = [*entity, *_KEY]
    open_segments = segments.join(log.select(*keys).distinct(), keys, "left_anti")
    return open_segments.select(
        *keys,
        F.col("transport_mode").alias("original_mode"),
        F.col("transport_mode").alias("corrected_mode"),
        F.lit("confirmed correct").alias("notes"),
        now.cast("timestamp").alias("labeled_at"),
    )


def label_summary(log: DataFrame, entity: Sequence[str] = ENTITY) -> DataFrame:
    """Live labels with a changed / confirmed verdict."""
    return latest_labels(log, entity).select(
        *entity, *_KEY, "original_mode", "corrected_mode",
        F.when(F.col("original_mode") != F.col("corrected_mode"), "yes").otherwise("confirmed").alias("changed"),
        "notes",
        F.date_format("labeled_at", "yyyy-MM-dd'T'HH:mm:ss").alias("labeled"),
    )
