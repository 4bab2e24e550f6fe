"""Summaries over processed points: trips, segments, departure times and trends.

Everything is a grouped aggregate with map-side combine; windows run only on frames
that are already aggregated (trips, or a handful of calendar buckets).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from tripweave.config import ENTITY, MODES
from tripweave.functions.numeric import stable_round
from tripweave.functions.timing import day_name, departure_decimal, display_time, minutes_between
from tripweave.functions.windows import ORDER, ordered
from tripweave.operators.labels import latest_labels

def _span() -> Column:
    return minutes_between(F.min("timestamp"), F.max("timestamp"))


def on_trips(pts: DataFrame) -> DataFrame:
    return pts.filter(F.col("commute_id").isNotNull())


# ------------------------------------------------------------- trips and segments


def commutes(pts: DataFrame, direction: str | None = None, entity: Sequence[str] = ENTITY) -> DataFrame:
    """One row per trip."""
    pts = on_trips(pts)
    if direction:
        pts = pts.filter(F.col("commute_direction") == direction)
    return pts.groupBy(*entity, "commute_id", "commute_direction").agg(
        F.min("timestamp").alias("start_time"),
        F.max("timestamp").alias("end_time"),
        F.count("*").alias("point_count"),
        F.sum("distance_m").alias("total_distance_m"),
        stable_round(_span(), 1).alias("duration_min"),
    )


def segments(
    pts: DataFrame,
    commute_id: str | None = None,
    direction: str | None = None,
    entity: Sequence[str] = ENTITY,
) -> DataFrame:
    """One row per segment, of one trip, one direction or all trips."""
    pts = on_trips(pts)
    if commute_id:
        pts = pts.filter(F.col("commute_id") == commute_id)
    if direction:
        pts = pts.filter(F.col("commute_direction") == direction)
    return pts.groupBy(*entity, "commute_id", "commute_direction", "segment_id", "transport_mode").agg(
        F.min("timestamp").alias("start_time"),
        F.max("timestamp").alias("end_time"),
        F.count("*").alias("point_count"),
        stable_round(F.sum("distance_m"), 0).alias("distance_m"),
        stable_round(_span(), 1).alias("duration_min"),
        stable_round(F.avg("speed_kmh"), 1).alias("avg_speed_kmh"),
        stable_round(F.max("speed_kmh"), 1).alias("max_speed_kmh"),
    )


def commute_stats(pts: DataFrame, entity: Sequence[str] = ENTITY) -> DataFrame:
    """Trip count and duration statistics per direction, from unrounded durations."""
    per_trip = (
        on_trips(pts).groupBy(*entity, "commute_id", "commute_direction").agg(_span().alias("minutes"))
    )
    # a trip id implies its direction, so rows are already distinct trips
    return per_trip.groupBy("commute_direction").agg(
        F.count("*").alias("num_commutes"),
        stable_round(F.avg("minutes"), 1).alias("avg_duration_min"),
        stable_round(F.min("minutes"), 1).alias("min_duration_min"),
        stable_round(F.max("minutes"), 1).alias("max_duration_min"),
        stable_round(F.stddev_samp("minutes"), 1).alias("stddev_duration_min"),
    )


def commute_points(pts: DataFrame, commute_id: str) -> DataFrame:
    return pts.filter(F.col("commute_id") == commute_id).orderBy("timestamp")


def daily_points(pts: DataFrame, day: str) -> DataFrame:
    """All points of a local date; the date is the storage partition, so the scan prunes."""
    return pts.filter(F.col("local_date") == F.lit(day).cast("date")).orderBy("timestamp")


def list_dates(pts: DataFrame) -> DataFrame:
    return pts.select("local_date").distinct().orderBy("local_date")


def daily_overview(pts: DataFrame, entity: Sequence[str] = ENTITY) -> DataFrame:
    """Points, trips, time on trips and modes per local day."""
    on_trip = F.col("commute_id").isNotNull()
    at = F.when(on_trip, F.col("timestamp"))
    return pts.groupBy(*entity, "local_date").agg(
        F.count("*").alias("total_points"),
        # at most a few trip ids and five modes per day: the sets stay tiny
        F.size(F.collect_set("commute_id")).cast("long").alias("commutes"),
        stable_round(minutes_between(F.min(at), F.max(at)), 0).alias("trip_minutes"),
        F.array_join(F.array_sort(F.collect_set("transport_mode")), ", ").alias("modes"),
    )


# ------------------------------------------------------------- segment variability


def with_id_parts(frame: DataFrame) -> DataFrame:
    """Date and direction taken back out of the trip id."""
    # Fixed value: date prefix of a trip id.
    return frame.withColumns(
        {
            "date": F.substring("commute_id", 1, 10),
            "direction": F.regexp_replace("commute_id", r"^\d{4}-\d{2}-\d{2}-", ""),
        }
    )


def segment_label() -> Column:
    return F.concat(F.lit("Seg "), F.col("segment_id").cast("string"), F.lit(" ("), F.col("transport_mode"), F.lit(")"))


def segment_duration_series(segs: DataFrame, entity: Sequence[str] = ENTITY) -> DataFrame:
    return with_id_parts(segs).select(
        *entity, "date", "direction", "commute_id", "segment_id", "transport_mode", "duration_min", "avg_speed_kmh",
        segment_label().alias("segment_label"),
    )


def segment_variability(segs: DataFrame) -> DataFrame:
    """Which modes take predictable time: spread of segment durations per mode."""
    stats = segs.groupBy("transport_mode").agg(
        stable_round(F.avg("duration_min"), 1).alias("avg_duration_min"),
        stable_round(F.stddev_samp("duration_min"), 1).alias("stddev_min"),
        stable_round(F.min("duration_min"), 1).alias("min_duration_min"),
        stable_round(F.max("duration_min"), 1).alias("max_duration_min"),
        F.count("duration_min").alias("occurrences"),
        stable_round(F.avg("distance_m"), 0).alias("avg_distance_m"),
        stable_round(F.avg("avg_speed_kmh"), 1).alias("avg_speed_kmh"),
    )
    ratio = F.when(F.col("avg_duration_min") != 0, F.col("stddev_min") / F.col("avg_duration_min") * 100)
    return stats.withColumn("cv_pct", stable_round(ratio, 1)).orderBy(F.desc("avg_duration_min"), "transport_mode")


def duration_distribution(segs: DataFrame) -> DataFrame:
    """Exact five-number summary per mode.

    Durations are multiples of 0.1 minutes, so the exact percentile's value counts stay
    small however many segments there are.
    """
    quartiles = F.percentile("duration_min", F.array(*[F.lit(q) for q in (0.0, 0.25, 0.5, 0.75, 1.0)]))
    names = ("min_min", "q1_min", "median_min", "q3_min", "max_min")
    return (
        segs.groupBy("transport_mode")
        .agg(quartiles.alias("_q"))
        .select("transport_mode", *[stable_round(F.col("_q")[i], 3).alias(n) for i, n in enumerate(names)])
    )


# ------------------------------------------------------------- departure times


def with_departure(trips: DataFrame, display_tz: str) -> DataFrame:
    """Departure hour, weekday (Monday = 0) and date in the viewer's zone."""
    local = trips.withColumn("start_time_local", display_time("start_time", display_tz))
    at = F.col("start_time_local")
    return local.withColumns(
        {
            "departure_hour": F.hour(at),
            "departure_minute": F.minute(at),
            "departure_time_decimal": departure_decimal(at),
            "day_of_week": F.weekday(at),
            "day_name": day_name(at),
            "date": at.cast("date"),
        }
    )


def trip_metrics(trips: DataFrame) -> DataFrame:
    return trips.agg(
        F.count("*").alias("total_commutes"),
        stable_round(F.avg("duration_min"), 1).alias("avg_duration_min"),
        stable_round(F.min("duration_min"), 1).alias("best_duration_min"),
        stable_round(F.max("duration_min"), 1).alias("worst_duration_min"),
    )


def _duration_by(trips: DataFrame, *keys: str) -> DataFrame:
    return trips.groupBy(*keys).agg(
        stable_round(F.avg("duration_min"), 1).alias("avg_duration_min"),
        stable_round(F.stddev_samp("duration_min"), 1).alias("stddev_min"),
        F.count("duration_min").alias("count"),
    )


def duration_by_hour(departures: DataFrame) -> DataFrame:
    return _duration_by(departures, "departure_hour")


def departure_heatmap(departures: DataFrame, min_trips: int = 3) -> DataFrame:
    """Mean duration per weekday and hour, empty when there are too few trips overall."""
    cells = departures.groupBy("day_of_week", "day_name", "departure_hour").agg(
        stable_round(F.avg("duration_min"), 1).alias("avg_duration_min"), F.count("*").alias("_n")
    )
    # at most 7 x 24 cells reach this window
    total = F.sum("_n").over(Window.partitionBy(F.lit(0)))
    return cells.withColumn("_total", total).filter(F.col("_total") >= min_trips).drop("_n", "_total")


def best_worst_hour(departures: DataFrame) -> DataFrame:
    """Hour with the lowest and highest mean duration; needs at least two hours."""
    hours = duration_by_hour(departures)
    rank = F.struct("avg_duration_min", "departure_hour")
    worst_rank = F.struct(F.col("avg_duration_min"), -F.col("departure_hour"))
    picked = hours.agg(
        F.count("*").alias("n"),
        F.min_by(F.struct("*"), rank).alias("best"),
        F.max_by(F.struct("*"), worst_rank).alias("worst"),
    ).filter("n >= 2")
    return picked.select(
        F.explode(
            F.array(
                F.struct(F.lit("best").alias("kind"), F.col("best").alias("h")),
                F.struct(F.lit("worst").alias("kind"), F.col("worst").alias("h")),
            )
        ).alias("r")
    ).select("r.kind", "r.h.departure_hour", "r.h.avg_duration_min", "r.h.count")


# ------------------------------------------------------------- trends


def rolling_duration(departures: DataFrame, window: int = 7, entity: Sequence[str] = ENTITY) -> DataFrame:
    """Mean duration of the latest ``window`` (3..20) trips per entity and direction."""
    if not 3 <= window <= 20:
        raise ValueError("window must be between 3 and 20")
    frame = ordered([*entity, "commute_direction"], ["start_time", "commute_id"]).rowsBetween(1 - window, 0)
    return departures.withColumn("rolling_avg", F.avg("duration_min").over(frame))


def weekly_summary(departures: DataFrame) -> DataFrame:
    """Weeks start on Monday."""
    week = F.date_trunc("week", F.col("start_time_local")).cast("date")
    return departures.groupBy(week.alias("week_start")).agg(
        stable_round(F.avg("duration_min"), 1).alias("avg_duration_min"),
        stable_round(F.min("duration_min"), 1).alias("min_duration_min"),
        stable_round(F.max("duration_min"), 1).alias("max_duration_min"),
        F.count("commute_id").alias("num_commutes"),
        stable_round(F.avg("total_distance_m"), 0).alias("avg_distance_m"),
    )


def mode_split(segs: DataFrame) -> DataFrame:
    """Minutes per date and mode, absolute and as a share of the date."""
    totals = with_id_parts(segs).groupBy("date", "transport_mode").agg(
        stable_round(F.sum("duration_min"), 1).alias("total_min")
    )
    day_total = F.sum("total_min").over(Window.partitionBy("date"))  # five modes at most
    return totals.withColumn("share", stable_round(F.when(day_total > 0, F.col("total_min") / day_total), 4))


def day_of_week_pattern(departures: DataFrame) -> DataFrame:
    return _duration_by(departures, "day_of_week", "day_name")


def speed_by_mode(pts: DataFrame) -> DataFrame:
    return on_trips(pts).groupBy("transport_mode").agg(stable_round(F.avg("speed_kmh"), 3).alias("avg_speed_kmh"))


def duration_by_direction(trips: DataFrame) -> DataFrame:
    return trips.groupBy("commute_direction").agg(stable_round(F.avg("duration_min"), 3).alias("avg_duration_min"))


def weekly_report(trips: DataFrame, segs: DataFrame, as_of: str, entity: Sequence[str] = ENTITY) -> DataFrame:
    """Per entity: the last seven days against all time, best and worst trip, time per mode."""
    recent = F.col("start_time").cast("date") >= F.date_sub(F.lit(as_of).cast("date"), 7)
    recent = recent & (F.col("start_time").cast("date") <= F.lit(as_of).cast("date"))
    this_week = F.when(recent, F.col("duration_min"))
    overall = trips.groupBy(*entity).agg(
        F.count(this_week).alias("trips_this_week"),
        stable_round(F.avg(this_week), 1).alias("avg_duration_min"),
        stable_round(F.avg("duration_min"), 1).alias("all_time_avg_min"),
        F.min(F.when(recent, F.struct("duration_min", "commute_id"))).alias("_best"),
        F.max(F.when(recent, F.struct("duration_min", "commute_id"))).alias("_worst"),
    )
    per_mode = (
        segs.filter(recent)
        .groupBy(*entity)
        .agg(
            *[
                stable_round(
                    F.sum(F.when(F.col("transport_mode") == m, F.col("duration_min")).otherwise(0.0)), 1
                ).alias(f"{m}_min")
                for m in MODES
            ]
        )
    )
    return overall.join(per_mode, list(entity), "left").select(
        *entity, "trips_this_week", "avg_duration_min", "all_time_avg_min",
        F.col("_best.commute_id").alias("best_commute"), F.col("_best.duration_min").alias("best_duration_min"),
        F.col("_worst.commute_id").alias("worst_commute"), F.col("_worst.duration_min").alias("worst_duration_min"),
        *[F.coalesce(f"{m}_min", F.lit(0.0)).alias(f"{m}_min") for m in MODES],
    )


# ------------------------------------------------------------- maps and timelines


def segment_boundaries(pts: DataFrame, entity: Sequence[str] = ENTITY) -> DataFrame:
    """Time of the first point of every segment but the trip's first; ids rise along a trip, so no point needs its neighbour."""
    track = [*entity, "commute_id"]
    heads = on_trips(pts).groupBy(*track, "segment_id").agg(F.min(F.struct(*ORDER, "timestamp")).alias("_head"))
    heads = heads.withColumn("_before", F.lag("segment_id").over(Window.partitionBy(*track).orderBy("segment_id")))
    return heads.filter("_before is not null").select(*track, "segment_id", F.col("_head.timestamp").alias("boundary_time"))


def polyline_vertices(pts: DataFrame, entity: Sequence[str] = ENTITY) -> DataFrame:
    """Ordered vertices of each segment's line; segments of one point draw no line."""
    w = ordered([*entity, "commute_id", "segment_id"])
    numbered = on_trips(pts).withColumns(
        {"vertex": F.row_number().over(w), "_more": F.lead("tst").over(w).isNotNull()}
    )
    return numbered.filter((F.col("vertex") > 1) | F.col("_more")).select(
        *entity, "commute_id", "segment_id", "transport_mode", "vertex", "lat", "lon"
    )


def trip_markers(pts: DataFrame, entity: Sequence[str] = ENTITY) -> DataFrame:
    """Start and end position of each trip."""
    at = F.struct("tst", "record_id")
    here = F.struct("lat", "lon")
    ends = on_trips(pts).groupBy(*entity, "commute_id").agg(
        F.min_by(here, at).alias("_first"), F.max_by(here, at).alias("_last")
    )
    return ends.select(
        *entity, "commute_id",
        F.col("_first.lat").alias("start_lat"), F.col("_first.lon").alias("start_lon"),
        F.col("_last.lat").alias("end_lat"), F.col("_last.lon").alias("end_lon"),
    )


def segment_bands(pts: DataFrame, log: DataFrame, entity: Sequence[str] = ENTITY) -> DataFrame:
    """Start, end and (corrected) mode per segment. Labels meet segments, not points."""
    keys = [*entity, "commute_id", "segment_id"]
    labels = latest_labels(log, entity).select(*keys, "corrected_mode")
    bands = segments(pts, entity=entity).join(labels, keys, "left")
    return bands.select(
        *keys, "start_time", "end_time",
        F.coalesce(F.when(F.col("corrected_mode") != "", F.col("corrected_mode")), "transport_mode").alias("mode"),
    )


def speed_timeline(pts: DataFrame, display_tz: str, entity: Sequence[str] = ENTITY) -> DataFrame:
    return pts.select(
        *entity, "record_id", display_time("timestamp", display_tz).alias("display_time"), "speed_kmh",
        "transport_mode", "commute_id", F.col("commute_id").isNotNull().alias("in_commute"),
    )


def trip_detail(pts: DataFrame, log: DataFrame, commute_id: str | None = None, entity: Sequence[str] = ENTITY) -> DataFrame:
    """Points of trips, each beside its segment's summary and label."""
    keys = [*entity, "commute_id", "segment_id"]
    pts = on_trips(pts)
    if commute_id:
        pts = pts.filter(F.col("commute_id") == commute_id)
        log = log.filter(F.col("commute_id") == commute_id)
    summary = segments(pts, entity=entity).select(
        *keys, F.col("duration_min").alias("segment_duration_min"), F.col("point_count").alias("segment_points")
    )
    labels = latest_labels(log, entity).select(*keys, F.col("corrected_mode").alias("label"))
    return pts.join(summary.join(labels, keys, "left"), keys)


def file_summary(pts: DataFrame) -> DataFrame:
    """One row describing a batch of enriched points."""
    optional = []
    if "batt" in pts.columns:
        optional += [F.max("batt").alias("battery_start"), F.min("batt").alias("battery_end")]
    if "acc" in pts.columns:
        optional += [stable_round(F.avg("acc"), 0).alias("avg_accuracy_m")]
    return pts.agg(
        F.count("*").alias("total_points"),
        F.min("timestamp").alias("time_start"),
        F.max("timestamp").alias("time_end"),
        stable_round(_span(), 1).alias("duration_min"),
        stable_round(F.sum("distance_m"), 0).alias("total_distance_m"),
        stable_round(F.max("speed_kmh"), 1).alias("max_speed_kmh"),
        stable_round(F.avg("speed_kmh"), 1).alias("avg_speed_kmh"),
        *optional,
    )


def first_and_last(pts: DataFrame, n: int = 5) -> DataFrame:
    """The first and last ``n`` points by time, the report's head and tail."""
    cols = ["record_id", "timestamp", "lat", "lon", "speed_kmh", "distance_m"]
    head = pts.orderBy("tst", "record_id").limit(n).select(F.lit("first").alias("part"), *cols)
    tail = pts.orderBy(F.desc("tst"), F.desc("record_id")).limit(n).select(F.lit("last").alias("part"), *cols)
    return head.unionByName(tail)
