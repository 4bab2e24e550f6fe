"""Classification review: find segments whose speed contradicts their mode."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from tripweave.config import ENTITY
from tripweave.functions.modes import mode_mismatch
from tripweave.functions.numeric import stable_round
from tripweave.functions.timing import minutes_between
from tripweave.functions.windows import ordered
from tripweave.operators.analytics import commutes, on_trips
from tripweave.operators.labels import latest_labels, upsert_labels


def review(
    pts: DataFrame, log: DataFrame | None = None, detail: bool = False, entity: Sequence[str] = ENTITY
) -> DataFrame:
    """Every segment of every trip with its speed profile, neighbours and verdict.

    ``detail`` adds exact median and minimum speed.
    """
    keys = [*entity, "commute_id", "segment_id"]
    extra = (
        [
            stable_round(F.median("speed_kmh"), 1).alias("speed_median_kmh"),
            stable_round(F.min("speed_kmh"), 1).alias("speed_min_kmh"),
        ]
        if detail
        else []
    )
    span = minutes_between(F.min("timestamp"), F.max("timestamp"))
    profile = on_trips(pts).groupBy(*keys, F.col("transport_mode").alias("classified_mode")).agg(
        F.count("*").alias("point_count"),
        stable_round(span, 1).alias("duration_min"),
        stable_round(F.sum("distance_m"), 0).alias("distance_m"),
        stable_round(F.avg("speed_kmh"), 1).alias("avg_speed_kmh"),
        stable_round(F.max("speed_kmh"), 1).alias("max_speed_kmh"),
        F.coalesce(stable_round(F.stddev_samp("speed_kmh"), 1), F.lit(0.0)).alias("speed_std_kmh"),
        *extra,
    )
    profile = with_neighbours(profile, entity)
    verdict = mode_mismatch(
        "classified_mode", "avg_speed_kmh", "max_speed_kmh", "speed_std_kmh", "prev_segment_mode", "next_segment_mode"
    )
    profile = profile.withColumn("_v", verdict).select("*", "_v.*").drop("_v")
    if log is None:
        return profile.withColumn("existing_correction", F.lit(None).cast("string"))
    labels = latest_labels(log, entity).select(*keys, F.col("corrected_mode").alias("existing_correction"))
    return profile.join(labels, keys, "left")


def with_neighbours(
    segs: DataFrame, entity: Sequence[str] = ENTITY, mode: str = "classified_mode"
) -> DataFrame:
    """Mode of the previous and next segment of the trip."""
    w = ordered([*entity, "commute_id"], ["segment_id", mode])
    return segs.withColumns({"prev_segment_mode": F.lag(mode).over(w), "next_segment_mode": F.lead(mode).over(w)})


def analyze_segment(reviewed: DataFrame, commute_id: str, segment_id: int) -> DataFrame:
    """One segment's review; empty when it does not exist."""
    return reviewed.filter((F.col("commute_id") == commute_id) & (F.col("segment_id") == segment_id))


def flagged(reviewed: DataFrame, commute_id: str | None = None) -> DataFrame:
    """Suspicious segments, most certain first."""
    if commute_id:
        reviewed = reviewed.filter(F.col("commute_id") == commute_id)
    return reviewed.filter("mismatch").orderBy(F.desc("confidence"), "commute_id", "segment_id")


def suggestions(reviewed: DataFrame, entity: Sequence[str] = ENTITY) -> DataFrame:
    """Proposed labels for flagged segments nobody has labelled yet."""
    return reviewed.filter("mismatch and suggested_mode is not null and existing_correction is null").select(
        *entity, "commute_id", "segment_id",
        F.col("classified_mode").alias("original_mode"),
        F.col("suggested_mode").alias("corrected_mode"),
        "confidence",
        F.concat(F.lit("auto-flagged: "), F.col("reason")).alias("notes"),
    )


def latest_trips(trips: DataFrame, n: int = 5, direction: str | None = None, entity: Sequence[str] = ENTITY) -> DataFrame:
    """The newest ``n`` trips of each entity."""
    if direction:
        trips = trips.filter(F.col("commute_direction") == direction)
    newest = Window.partitionBy(*entity).orderBy(F.desc("start_time"), "commute_id")
    return trips.withColumn("_rank", F.row_number().over(newest)).filter(F.col("_rank") <= n).drop("_rank")


def review_recent(
    pts: DataFrame,
    log: DataFrame | None = None,
    n: int = 5,
    direction: str | None = None,
    entity: Sequence[str] = ENTITY,
) -> DataFrame:
    """Review of the newest ``n`` trips per entity. A verdict looks no further than its trip, so other trips' points go first."""
    key = [*entity, "commute_id"]
    recent = latest_trips(commutes(pts, entity=entity), n, direction, entity).select(*key)
    return review(pts.join(recent, key, "left_semi"), log, entity=entity)


def trip_counts(reviewed: DataFrame, entity: Sequence[str] = ENTITY) -> DataFrame:
    return reviewed.groupBy(*entity, "commute_id").agg(
        F.count("*").alias("total_segments"), F.count_if("mismatch").alias("flagged_count")
    )


def patterns(reviewed: DataFrame, entity: Sequence[str] = ENTITY) -> DataFrame:
    """Systematic confusions ``from -> to`` among flagged segments, per entity.

    The id list of a group holds at most the reviewed trips of one entity.
    """
    pattern = F.concat_ws(" -> ", "classified_mode", "suggested_mode")
    return (
        reviewed.filter("mismatch and suggested_mode is not null")
        .groupBy(*entity, pattern.alias("pattern"))
        .agg(
            F.count("*").alias("count"),
            stable_round(F.avg("avg_speed_kmh"), 1).alias("avg_speed_kmh"),
            stable_round(F.avg("confidence"), 2).alias("avg_confidence"),
            F.array_sort(F.collect_set("commute_id")).alias("commute_ids"),
        )
    )


def apply_suggestions(
    log: DataFrame, proposed: DataFrame, now: Column, min_confidence: float = 0.7
) -> tuple[DataFrame, DataFrame]:
    """(label log with the confident suggestions added, suggestions left out and why)."""
    sure = F.col("confidence") >= min_confidence
    applied = proposed.filter(sure).withColumn("labeled_at", now.cast("timestamp"))
    left_out = proposed.filter(~sure).withColumn(
        "skip_reason",
        F.concat(F.lit("confidence "), F.col("confidence").cast("string"), F.lit(f" < {min_confidence}")),
    )
    return upsert_labels(log, applied), left_out

