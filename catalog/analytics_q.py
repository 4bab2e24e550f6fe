"""Summaries, departure-time and trend analytics, map and timeline frames."""

from __future__ import annotations

from pyspark.sql import functions as F


from catalog.base import (
    AS_OF, chain, label_log, ledger, messages, plain, points, rnd, ts, with_labels, with_summaries,
)
from catalog.registry import register
from tripweave.config import MODES
from tripweave.functions import timing
from tripweave.operators import analytics as A, labels as L
from tripweave.plans.health import health

TZ = "America/New_York"
_E = '"user", device'
_ENT = ["user", "device"]


def _trips(spark, sf):
    return A.commutes(points(spark, sf))


def _segs(spark, sf):
    return A.segments(points(spark, sf))


def _departures(spark, sf):
    """Trips with departure columns; the view starts every day at eleven, so trips are
    moved by a few hours to give the hour of day something to tell apart."""
    later = F.make_interval(hours=(F.col("point_count") % 5).cast("int"))
    return A.with_departure(_trips(spark, sf).withColumn("start_time", F.col("start_time") + later), TZ)


_DEPARTURES_SQL = """
SELECT *, start_local AS start_time_local, hour(start_local) AS departure_hour, minute(start_local) AS departure_minute,
       isodow(start_local) - 1 AS day_of_week, strftime(start_local, '%a') AS day_name, CAST(start_local AS DATE) AS "date"
FROM (SELECT *, (start_time + to_hours(CAST(point_count % 5 AS INT))) AT TIME ZONE 'UTC' AT TIME ZONE 'America/New_York' AS start_local
      FROM commutes)
"""


def _dep_sql(body: str) -> str:
    return with_summaries(body, departures=_DEPARTURES_SQL)


_COMMUTE_OUT = (
    f"SELECT {_E}, commute_id, commute_direction, {ts('start_time')} AS start_time, {ts('end_time')} AS end_time, point_count, "
    f"{rnd('total_distance_m', 3)} AS total_distance_m, duration_min FROM commutes"
)
_SEGMENT_OUT = (
    f"SELECT {_E}, commute_id, commute_direction, segment_id, transport_mode, {ts('start_time')} AS start_time, "
    f"{ts('end_time')} AS end_time, point_count, distance_m, duration_min, avg_speed_kmh, max_speed_kmh FROM segments"
)


@register("commutes_a1", with_summaries(_COMMUTE_OUT))
def commutes_a1(spark, sf):
    return plain(_trips(spark, sf))


@register("segments_of_commute_a2", with_summaries(_SEGMENT_OUT + " WHERE commute_id = '2024-01-10-morning'"))
def segments_of_commute_a2(spark, sf):
    return plain(A.segments(points(spark, sf), commute_id="2024-01-10-morning"))


@register("all_segments_a3", with_summaries(_SEGMENT_OUT))
def all_segments_a3(spark, sf):
    return plain(_segs(spark, sf))


@register("segments_by_direction_a3", with_summaries(_SEGMENT_OUT + " WHERE commute_direction = 'evening'"))
def segments_by_direction_a3(spark, sf):
    return plain(A.segments(points(spark, sf), direction="evening"))


@register(
    "commute_stats_a4",
    with_summaries(
        f"SELECT commute_direction, count(*) AS num_commutes, {rnd('avg(raw_min)', 1)} AS avg_duration_min, "
        f"{rnd('min(raw_min)', 1)} AS min_duration_min, {rnd('max(raw_min)', 1)} AS max_duration_min, "
        f"{rnd('stddev_samp(raw_min)', 1)} AS stddev_duration_min FROM commutes GROUP BY ALL"
    ),
)
def commute_stats_a4(spark, sf):
    return plain(A.commute_stats(points(spark, sf)))


_ALL_POINTS = "SELECT t.*, s.transport_mode, s.segment_id FROM trips t LEFT JOIN segmented s USING (record_id)"


@register(
    "daily_overview_a5",
    chain(
        "segmented",
        f"SELECT {_E}, CAST(local_date AS VARCHAR) AS local_date, count(*) AS total_points, count(DISTINCT commute_id) AS commutes, "
        f"{rnd('(max(CASE WHEN commute_id IS NOT NULL THEN tst END) - min(CASE WHEN commute_id IS NOT NULL THEN tst END)) / 60.0', 0)} AS trip_minutes, "
        "coalesce(array_to_string(list_sort(list(DISTINCT transport_mode) FILTER (transport_mode IS NOT NULL)), ', '), '') AS modes "
        f"FROM allp GROUP BY {_E}, local_date",
        allp=_ALL_POINTS,
    ),
)
def daily_overview_a5(spark, sf):
    return plain(A.daily_overview(points(spark, sf)))


@register(
    "segment_variability_a6",
    with_summaries(
        f"SELECT *, {rnd('CASE WHEN avg_duration_min <> 0 THEN stddev_min / avg_duration_min * 100 END', 1)} AS cv_pct FROM ("
        f"SELECT transport_mode, {rnd('avg(duration_min)', 1)} AS avg_duration_min, {rnd('stddev_samp(duration_min)', 1)} AS stddev_min, "
        f"{rnd('min(duration_min)', 1)} AS min_duration_min, {rnd('max(duration_min)', 1)} AS max_duration_min, count(*) AS occurrences, "
        f"{rnd('avg(distance_m)', 0)} AS avg_distance_m, {rnd('avg(avg_speed_kmh)', 1)} AS avg_speed_kmh FROM segments GROUP BY transport_mode)"
    ),
)
def segment_variability_a6(spark, sf):
    return plain(A.segment_variability(_segs(spark, sf)))


@register(
    "duration_distribution_a7",
    with_summaries(
        "SELECT transport_mode, "
        + ", ".join(
            f"{rnd(f'quantile_cont(duration_min, {q})', 3)} AS {n}"
            for q, n in ((0.0, "min_min"), (0.25, "q1_min"), (0.5, "median_min"), (0.75, "q3_min"), (1.0, "max_min"))
        )
        + " FROM segments GROUP BY transport_mode"
    ),
)
def duration_distribution_a7(spark, sf):
    return plain(A.duration_distribution(_segs(spark, sf)))


@register(
    "trip_metrics_a8",
    with_summaries(
        f"SELECT count(*) AS total_commutes, {rnd('avg(duration_min)', 1)} AS avg_duration_min, "
        f"{rnd('min(duration_min)', 1)} AS best_duration_min, {rnd('max(duration_min)', 1)} AS worst_duration_min FROM commutes"
    ),
)
def trip_metrics_a8(spark, sf):
    return plain(A.trip_metrics(_trips(spark, sf)))


_BY = f"{rnd('avg(duration_min)', 1)} AS avg_duration_min, {rnd('stddev_samp(duration_min)', 1)} AS stddev_min, count(*) AS count"
_HOURS = f"SELECT CAST(departure_hour AS BIGINT) AS departure_hour, {_BY} FROM departures GROUP BY departure_hour"


@register("duration_by_hour_a9", _dep_sql(_HOURS))
def duration_by_hour_a9(spark, sf):
    return plain(A.duration_by_hour(_departures(spark, sf)))


@register(
    "departure_heatmap_a10",
    _dep_sql(
        "SELECT CAST(day_of_week AS BIGINT) AS day_of_week, day_name, CAST(departure_hour AS BIGINT) AS departure_hour, "
        f"{rnd('avg(duration_min)', 1)} AS avg_duration_min FROM departures WHERE (SELECT count(*) FROM departures) >= 3 "
        "GROUP BY day_of_week, day_name, departure_hour"
    ),
)
def departure_heatmap_a10(spark, sf):
    return plain(A.departure_heatmap(_departures(spark, sf)))


@register(
    "best_worst_hour_a11",
    _dep_sql(
        f"""SELECT * FROM (
        (SELECT 'best' AS kind, departure_hour, avg_duration_min, count FROM ({_HOURS}) ORDER BY avg_duration_min, departure_hour LIMIT 1)
        UNION ALL
        (SELECT 'worst' AS kind, departure_hour, avg_duration_min, count FROM ({_HOURS}) ORDER BY avg_duration_min DESC, departure_hour LIMIT 1))
        WHERE (SELECT count(DISTINCT departure_hour) FROM departures) >= 2"""
    ),
)
def best_worst_hour_a11(spark, sf):
    return plain(A.best_worst_hour(_departures(spark, sf)))


@register(
    "weekly_summary_a12",
    _dep_sql(
        "SELECT CAST(CAST(date_trunc('week', start_local) AS DATE) AS VARCHAR) AS week_start, "
        f"{rnd('avg(duration_min)', 1)} AS avg_duration_min, {rnd('min(duration_min)', 1)} AS min_duration_min, "
        f"{rnd('max(duration_min)', 1)} AS max_duration_min, count(*) AS num_commutes, {rnd('avg(total_distance_m)', 0)} AS avg_distance_m "
        "FROM departures GROUP BY 1"
    ),
)
def weekly_summary_a12(spark, sf):
    return plain(A.weekly_summary(_departures(spark, sf)))


@register(
    "mode_split_a13",
    with_summaries(
        f"SELECT *, {rnd('total_min / nullif(sum(total_min) OVER (PARTITION BY \"date\"), 0)', 4)} AS share FROM ("
        f"SELECT substr(commute_id, 1, 10) AS \"date\", transport_mode, {rnd('sum(duration_min)', 1)} AS total_min FROM segments GROUP BY 1, 2)"
    ),
)
def mode_split_a13(spark, sf):
    return plain(A.mode_split(_segs(spark, sf)), 4)


@register(
    "day_of_week_pattern_a14",
    _dep_sql(f"SELECT CAST(day_of_week AS BIGINT) AS day_of_week, day_name, {_BY} FROM departures GROUP BY day_of_week, day_name"),
)
def day_of_week_pattern_a14(spark, sf):
    return plain(A.day_of_week_pattern(_departures(spark, sf)))


_LABEL = "'Seg ' || CAST(segment_id AS VARCHAR) || ' (' || transport_mode || ')'"


@register(
    "segment_duration_series_a15",
    with_summaries(
        f"SELECT {_E}, substr(commute_id, 1, 10) AS \"date\", regexp_replace(commute_id, '^\\d{{4}}-\\d{{2}}-\\d{{2}}-', '') AS direction, "
        f"commute_id, segment_id, transport_mode, duration_min, avg_speed_kmh, {_LABEL} AS segment_label FROM segments"
    ),
)
def segment_duration_series_a15(spark, sf):
    return plain(A.segment_duration_series(_segs(spark, sf)))


@register(
    "segment_bands_a16",
    with_labels(
        f"SELECT s.\"user\", s.device, s.commute_id, s.segment_id, {ts('s.start_time')} AS start_time, {ts('s.end_time')} AS end_time, "
        "coalesce(nullif(l.corrected_mode, ''), s.transport_mode) AS mode FROM segments s "
        "LEFT JOIN live l ON s.\"user\" = l.\"user\" AND s.device = l.device AND s.commute_id = l.commute_id AND s.segment_id = l.segment_id"
    ),
)
def segment_bands_a16(spark, sf):
    pts = points(spark, sf)
    return plain(A.segment_bands(pts, label_log(A.segments(pts))))


_RECENT = f"CAST(start_time AS DATE) BETWEEN DATE '{AS_OF}' - 7 AND DATE '{AS_OF}'"


@register(
    "weekly_report_a17",
    with_summaries(
        f"""SELECT {_E}, trips_this_week, avg_duration_min, all_time_avg_min, b.commute_id AS best_commute, b.duration_min AS best_duration_min,
        w.commute_id AS worst_commute, w.duration_min AS worst_duration_min, {', '.join(f'coalesce({m}_min, 0) AS {m}_min' for m in MODES)} FROM (
        SELECT {_E}, count(*) FILTER ({_RECENT}) AS trips_this_week, {rnd(f'avg(duration_min) FILTER ({_RECENT})', 1)} AS avg_duration_min,
          {rnd('avg(duration_min)', 1)} AS all_time_avg_min,
          min({{'duration_min': duration_min, 'commute_id': commute_id}}) FILTER ({_RECENT}) AS b,
          max({{'duration_min': duration_min, 'commute_id': commute_id}}) FILTER ({_RECENT}) AS w
        FROM commutes GROUP BY {_E}) LEFT JOIN (
        SELECT {_E}, {', '.join(f"{rnd(f'''coalesce(sum(duration_min) FILTER (transport_mode = '{m}'), 0)''', 1)} AS {m}_min" for m in MODES)}
        FROM segments WHERE {_RECENT} GROUP BY {_E}) USING ({_E})"""
    ),
)
def weekly_report_a17(spark, sf):
    pts = points(spark, sf)
    return plain(A.weekly_report(A.commutes(pts), A.segments(pts), AS_OF))


@register("speed_by_mode_a18", chain("segmented", f"SELECT transport_mode, {rnd('avg(speed_kmh)', 3)} AS avg_speed_kmh FROM segmented GROUP BY 1"))
def speed_by_mode_a18(spark, sf):
    return plain(A.speed_by_mode(points(spark, sf)))


@register("duration_by_direction_a18", with_summaries(f"SELECT commute_direction, {rnd('avg(duration_min)', 3)} AS avg_duration_min FROM commutes GROUP BY 1"))
def duration_by_direction_a18(spark, sf):
    return plain(A.duration_by_direction(_trips(spark, sf)))


@register(
    "health_a19",
    with_labels(
        "SELECT 'total_records' AS metric, CAST(count(*) AS VARCHAR) AS value FROM events UNION ALL "
        "SELECT 'unsynced_records', CAST(count(*) AS VARCHAR) FROM events WHERE event_type <> 'signup' UNION ALL "
        "SELECT 'label_count', CAST(count(*) AS VARCHAR) FROM live UNION ALL "
        "SELECT DISTINCT 'derived_date', CAST(local_date AS VARCHAR) FROM trips"
    ),
)
def health_a19(spark, sf):
    pts = points(spark, sf)
    return health(messages(spark, sf), ledger(spark, sf), label_log(A.segments(pts)), pts)


# ------------------------------------------------------------- projections and filters of the views


@register(
    "points_of_trip_f5",
    chain("segmented", f"SELECT record_id, {_E}, transport_mode, segment_id FROM segmented WHERE commute_id = '2024-01-10-morning'"),
)
def points_of_trip_f5(spark, sf):
    return A.commute_points(points(spark, sf), "2024-01-10-morning").select("record_id", *_ENT, "transport_mode", "segment_id")


@register(
    "points_of_day_f5",
    chain("segmented", f"SELECT record_id, {_E}, commute_id, transport_mode FROM allp WHERE local_date = DATE '2024-01-10'", allp=_ALL_POINTS),
)
def points_of_day_f5(spark, sf):
    return A.daily_points(points(spark, sf), "2024-01-10").select("record_id", *_ENT, "commute_id", "transport_mode")


@register(
    "timeline_f7_f8",
    chain(
        "segmented",
        f"SELECT {_E}, record_id, {ts('timestamp_local')} AS display_time, {rnd('speed_kmh', 3)} AS speed_kmh, transport_mode, commute_id, "
        "commute_id IS NOT NULL AS in_commute FROM allp",
        allp=_ALL_POINTS,
    ),
)
def timeline_f7_f8(spark, sf):
    return plain(A.speed_timeline(points(spark, sf), TZ))


@register("id_parts_f7", with_summaries("SELECT DISTINCT commute_id, substr(commute_id, 1, 10) AS \"date\", substr(commute_id, 12) AS direction FROM segments"))
def id_parts_f7(spark, sf):
    return A.with_id_parts(_segs(spark, sf)).select("commute_id", "date", "direction").distinct()


@register(
    "display_time_f8",
    with_summaries(f"SELECT {_E}, commute_id, {ts('start_time AT TIME ZONE ' + chr(39) + 'UTC' + chr(39) + ' AT TIME ZONE ' + chr(39) + 'Asia/Tokyo' + chr(39))} AS seen_at FROM commutes"),
)
def display_time_f8(spark, sf):
    return plain(_trips(spark, sf).select(*_ENT, "commute_id", timing.display_time("start_time", "Asia/Tokyo").alias("seen_at")))


# ------------------------------------------------------------- trend and map sequences


@register(
    "rolling_duration_w11",
    with_summaries(
        f"SELECT {_E}, commute_id, {rnd('avg(duration_min) OVER (PARTITION BY \"user\", device, commute_direction ORDER BY start_time, commute_id ROWS 6 PRECEDING)', 3)} AS rolling_avg FROM commutes"
    ),
)
def rolling_duration_w11(spark, sf):
    return plain(A.rolling_duration(_trips(spark, sf)).select(*_ENT, "commute_id", "rolling_avg"))


@register(
    "segment_boundaries_w12",
    chain(
        "segmented",
        f"SELECT {_E}, commute_id, segment_id, {ts('\"timestamp\"')} AS boundary_time FROM segmented "
        f"QUALIFY segment_id <> lag(segment_id) OVER (PARTITION BY {_E}, commute_id ORDER BY tst, record_id)",
    ),
)
def segment_boundaries_w12(spark, sf):
    return plain(A.segment_boundaries(points(spark, sf)))


@register(
    "polyline_vertices_w13",
    chain(
        "segmented",
        f"SELECT {_E}, commute_id, segment_id, transport_mode, vertex, {rnd('lat', 6)} AS lat, {rnd('lon', 6)} AS lon FROM ("
        f"SELECT *, row_number() OVER (PARTITION BY {_E}, commute_id, segment_id ORDER BY tst, record_id) AS vertex, "
        f"count(*) OVER (PARTITION BY {_E}, commute_id, segment_id) AS vertices FROM segmented) WHERE vertices > 1",
    ),
)
def polyline_vertices_w13(spark, sf):
    return plain(A.polyline_vertices(points(spark, sf)), 6)


@register(
    "trip_markers_w13",
    chain(
        "trips",
        f"SELECT {_E}, commute_id, {rnd('first(lat ORDER BY tst, record_id)', 6)} AS start_lat, {rnd('first(lon ORDER BY tst, record_id)', 6)} AS start_lon, "
        f"{rnd('last(lat ORDER BY tst, record_id)', 6)} AS end_lat, {rnd('last(lon ORDER BY tst, record_id)', 6)} AS end_lon "
        f"FROM trips WHERE commute_id IS NOT NULL GROUP BY {_E}, commute_id",
    ),
)
def trip_markers_w13(spark, sf):
    return plain(A.trip_markers(points(spark, sf)), 6)


@register(
    "trip_detail_j8",
    with_labels(
        "SELECT p.record_id, p.\"user\", p.device, p.commute_id, p.segment_id, p.transport_mode, s.duration_min AS segment_duration_min, "
        "s.point_count AS segment_points, l.corrected_mode AS label FROM segmented p "
        "JOIN segments s USING (\"user\", device, commute_id, segment_id) LEFT JOIN live l USING (\"user\", device, commute_id, segment_id)"
    ),
)
def trip_detail_j8(spark, sf):
    pts = points(spark, sf)
    detail = A.trip_detail(pts, label_log(A.segments(pts)))
    return plain(
        detail.select(
            "record_id", *_ENT, "commute_id", "segment_id", "transport_mode", "segment_duration_min", "segment_points", "label"
        )
    )


@register(
    "neighbour_segments_j7",
    with_summaries(
        f"SELECT {_E}, commute_id, segment_id, lag(transport_mode) OVER w AS prev_segment_mode, lead(transport_mode) OVER w AS next_segment_mode "
        f"FROM segments WINDOW w AS (PARTITION BY {_E}, commute_id ORDER BY segment_id)"
    ),
)
def neighbour_segments_j7(spark, sf):
    from tripweave.operators.review import with_neighbours

    rows = with_neighbours(_segs(spark, sf), mode="transport_mode")
    return rows.select(*_ENT, "commute_id", "segment_id", "prev_segment_mode", "next_segment_mode")


# ------------------------------------------------------------- corrections on points


@register(
    "apply_corrections_j1",
    with_labels(
        "SELECT p.record_id, p.commute_id, p.segment_id, p.transport_mode AS predicted_mode, "
        "coalesce(nullif(l.corrected_mode, ''), p.transport_mode) AS transport_mode FROM allp p LEFT JOIN live l "
        "ON p.\"user\" = l.\"user\" AND p.device = l.device AND p.commute_id = l.commute_id AND p.segment_id = l.segment_id",
        allp=_ALL_POINTS,
    ),
)
def apply_corrections_j1(spark, sf):
    pts = points(spark, sf)
    fixed = L.apply_corrections(pts, label_log(A.segments(pts)))
    return fixed.select("record_id", "commute_id", "segment_id", "predicted_mode", "transport_mode")


@register(
    "labelled_points_j2",
    with_labels("SELECT record_id, transport_mode, corrected_mode FROM segmented JOIN live USING (\"user\", device, commute_id, segment_id)"),
)
def labelled_points_j2(spark, sf):
    pts = points(spark, sf)
    return L.labelled_points(pts, label_log(A.segments(pts))).select("record_id", "transport_mode", "corrected_mode")


