"""Scalar functions, sequence operators and classification over the ping view."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F

from catalog.base import (
    CFG, PINGS_SQL, TZ_REGIONS, ZONES, chain, corridor_dist, enriched, events, haversine, pings, plain, points,
    rnd, trip_points, ts, waypoint_in,
)
from catalog.registry import register
from tripweave.config import MODES
from tripweave.functions import geo, modes, timing
from tripweave.operators import classify as C, segment as S, sequence, zones as Z
from tripweave.operators.analytics import on_trips
from tripweave.operators.features import point_features
from tripweave.operators.long_trips import point_features_in_shards, polyline_vertices_in_shards, segment_in_shards
from tripweave.operators.polygons import edges_of, polygons, resolve_polygon

_ENT = '"user", device'
_WT = f"PARTITION BY {_ENT}, commute_id ORDER BY tst, record_id"
HOME = (CFG.home_lat, CFG.home_lon)

# ------------------------------------------------------------- scalar functions


@register("haversine_g1", chain("pings", f"SELECT record_id, {rnd(haversine('lat', 'lon', '40.75e0', '-74.0e0'), 3)} AS home_m FROM pings"))
def haversine_g1(spark, sf):
    return plain(pings(spark, sf).select("record_id", geo.haversine_m("lat", "lon", *HOME).alias("home_m")))


@register(
    "speed_kmh_g2",
    chain("enriched", f"SELECT record_id, {rnd('CASE WHEN time_delta_s > 0 THEN distance_m / time_delta_s * 3.6 ELSE 0.0 END', 3)} AS speed FROM enriched"),
)
def speed_kmh_g2(spark, sf):
    return plain(enriched(spark, sf).select("record_id", geo.speed_kmh("distance_m", "time_delta_s").alias("speed")))


@register("in_geofence_g3", chain("pings", f"SELECT record_id, {haversine('lat', 'lon', '40.75e0', '-74.0e0')} <= 200.0 AS at_home FROM pings"))
def in_geofence_g3(spark, sf):
    return pings(spark, sf).select("record_id", geo.in_geofence("lat", "lon", *HOME, 200.0).alias("at_home"))


def bearing_sql(lat1: str, lon1: str, lat2: str, lon2: str) -> str:
    east = f"sin(radians({lon2})-radians({lon1}))*cos(radians({lat2}))"
    north = (
        f"cos(radians({lat1}))*sin(radians({lat2}))-sin(radians({lat1}))*cos(radians({lat2}))"
        f"*cos(radians({lon2})-radians({lon1}))"
    )
    return f"fmod(degrees(atan2({east}, {north})) + 360.0, 360.0)"


@register("bearing_g4", chain("pings", f"SELECT record_id, {rnd(bearing_sql('40.75e0', '-74.0e0', 'lat', 'lon'), 3)} AS bearing FROM pings"))
def bearing_g4(spark, sf):
    return plain(pings(spark, sf).select("record_id", geo.bearing_deg(*HOME, "lat", "lon").alias("bearing")))


@register(
    "angle_diff_g5",
    "SELECT event_id, "
    + rnd("CASE WHEN abs(fmod(value, 360) - user_id * 2) > 180 THEN 360 - abs(fmod(value, 360) - user_id * 2) ELSE abs(fmod(value, 360) - user_id * 2) END", 3)
    + " AS gap FROM events",
)
def angle_diff_g5(spark, sf):
    ev = events(spark, sf)
    return plain(ev.select("event_id", geo.angle_diff(F.col("value") % 360, F.col("user_id") * F.lit(2.0)).alias("gap")))


@register("epoch_to_utc_g6", chain("pings", f"SELECT record_id, {ts('to_timestamp(tst) AT TIME ZONE ' + chr(39) + 'UTC' + chr(39))} AS utc FROM pings"))
def epoch_to_utc_g6(spark, sf):
    return plain(pings(spark, sf).select("record_id", timing.epoch_to_timestamp("tst").alias("utc")))


_TZ = "CASE user WHEN 'u0' THEN 'America/New_York' WHEN 'u1' THEN 'Europe/London' WHEN 'u2' THEN 'Asia/Kolkata' ELSE 'Australia/Sydney' END"


@register(
    "utc_to_local_g7",
    chain("pings", f"SELECT record_id, {ts('(to_timestamp(tst - 36000) AT TIME ZONE tz)')} AS local_time FROM (SELECT *, {_TZ.replace('user', chr(34) + 'user' + chr(34), 1)} AS tz FROM pings)"),
)
def utc_to_local_g7(spark, sf):
    rows = pings(spark, sf).withColumn("tz", F.expr(_TZ))
    at = F.timestamp_seconds(F.col("tst") - 36000)
    return plain(rows.select("record_id", timing.to_local(at, "tz").alias("local_time")))


def _tz_sql() -> str:
    arms = " ".join(
        f"WHEN lat BETWEEN {r.lat_min!r} AND {r.lat_max!r} AND lon BETWEEN {r.lon_min!r} AND {r.lon_max!r} THEN '{r.tz}'"
        for r in sorted(TZ_REGIONS, key=lambda r: r.area)
    )
    return f"CASE {arms} ELSE 'America/Denver' END"


@register("resolve_timezone_g8", chain("pings", f"SELECT record_id, {_tz_sql()} AS timezone FROM pings"))
def resolve_timezone_g8(spark, sf):
    return Z.resolve_timezone(pings(spark, sf), TZ_REGIONS, "America/Denver").select("record_id", "timezone")


@register("resolve_timezone_grid_g8", chain("pings", f"SELECT record_id, {_tz_sql()} AS timezone FROM pings"))
def resolve_timezone_grid_g8(spark, sf):
    boxes = Z.tz_boxes(spark, TZ_REGIONS)
    return Z.resolve_timezone(pings(spark, sf), boxes, "America/Denver").select("record_id", "timezone")


@register(
    "cyclical_time_g9",
    "SELECT event_id, " + rnd("sin(2 * pi() * hour(ts) / 24)", 3) + " AS hour_sin, " + rnd("cos(2 * pi() * hour(ts) / 24)", 3)
    + " AS hour_cos, CAST(isodow(ts) - 1 AS BIGINT) AS day_of_week FROM events",
)
def cyclical_time_g9(spark, sf):
    hour_sin, hour_cos = timing.cyclical_hour("ts")
    ev = events(spark, sf)
    return plain(ev.select("event_id", hour_sin.alias("hour_sin"), hour_cos.alias("hour_cos"), F.weekday("ts").alias("day_of_week")))


@register(
    "speed_band_g10",
    chain("enriched", "SELECT record_id, CASE WHEN speed_kmh < 1 THEN 'stationary' WHEN speed_kmh < 7 THEN 'walking' WHEN speed_kmh < 30 THEN 'slow vehicle' WHEN speed_kmh < 80 THEN 'driving' ELSE 'train' END AS band FROM enriched"),
)
def speed_band_g10(spark, sf):
    return enriched(spark, sf).select("record_id", modes.speed_band("speed_kmh").alias("band"))


@register("departure_decimal_g11", "SELECT event_id, " + rnd("hour(ts) + minute(ts) / 60.0", 2) + " AS departure FROM events")
def departure_decimal_g11(spark, sf):
    return events(spark, sf).select("event_id", timing.departure_decimal("ts").alias("departure"))


@register("day_name_g12", "SELECT event_id, strftime(ts, '%a') AS day_name FROM events")
def day_name_g12(spark, sf):
    return events(spark, sf).select("event_id", timing.day_name("ts").alias("day_name"))


@register("corridor_distance_g13", chain("pings", f"SELECT record_id, {rnd(corridor_dist(ZONES.corridors[1]), 3)} AS road_m FROM pings"))
def corridor_distance_g13(spark, sf):
    samples = ZONES.corridors[1].sample_points()
    return plain(pings(spark, sf).select("record_id", geo.corridor_distance("lat", "lon", samples).alias("road_m")))


# ------------------------------------------------------------- sequence operators


@register(
    "enrich_w1",
    chain(
        "enriched",
        f"SELECT record_id, {ts('timestamp_local')} AS timestamp_local, timezone, {rnd('distance_m', 3)} AS distance_m, "
        f"time_delta_s, {rnd('speed_kmh', 3)} AS speed_kmh, is_stationary FROM enriched",
    ),
)
def enrich_w1(spark, sf):
    return plain(
        enriched(spark, sf).select(
            "record_id", "timestamp_local", "timezone", "distance_m", "time_delta_s", "speed_kmh", "is_stationary"
        )
    )


@register("detect_commutes_w2", chain("trips", "SELECT record_id, at_home, at_work, commute_id, commute_direction FROM trips"))
def detect_commutes_w2(spark, sf):
    pts = sequence.detect_commutes(enriched(spark, sf), CFG)
    return pts.select("record_id", "at_home", "at_work", "commute_id", "commute_direction")


def _track(spark, sf):
    """Trip points with the speed rule's mode: the input of the single steps."""
    pts = on_trips(trip_points(spark, sf))
    return pts.withColumn("mode", modes.mode_by_speed("speed_kmh", CFG)), ["user", "device", "commute_id"]


_RULE = "CASE WHEN speed_kmh < 1 THEN 'stationary' WHEN speed_kmh < 7 THEN 'walking' WHEN speed_kmh < 30 THEN 'driving' ELSE 'train' END"
_RULED = f"SELECT *, {_RULE} AS m FROM trips WHERE commute_id IS NOT NULL"
_N5 = ("l2", "l1", "m", "r1", "r2")


def _n(this: str) -> str:
    return "(" + "+".join(f"CAST({o} = {this} AS INT)" for o in _N5) + ")"


_SMOOTH = (
    "CASE WHEN n > 5 AND rn > 2 AND rn <= n - 2 THEN CASE "
    + " ".join(f"WHEN {_n(x)} = greatest({', '.join(_n(y) for y in _N5)}) THEN {x}" for x in _N5)
    + " END ELSE m END"
)


@register(
    "smooth_modes_w3",
    chain(
        "trips",
        f"SELECT record_id, {_SMOOTH} AS mode FROM (SELECT *, lag(m, 2) OVER w AS l2, lag(m) OVER w AS l1, lead(m) OVER w AS r1, "
        f"lead(m, 2) OVER w AS r2, row_number() OVER w AS rn, count(*) OVER (PARTITION BY {_ENT}, commute_id) AS n "
        f"FROM ruled WINDOW w AS ({_WT}))",
        ruled=_RULED,
    ),
)
def smooth_modes_w3(spark, sf):
    pts, by = _track(spark, sf)
    return S.smooth_modes(pts, by).select("record_id", "mode")


_SIDS = f"""SELECT *, sum(cut) OVER ({_WT} ROWS UNBOUNDED PRECEDING) AS sid FROM (
  SELECT *, CAST(m <> lag(m, 1, m) OVER ({_WT}) AS INT) AS cut FROM ruled)"""


@register("assign_segment_ids_w4", chain("trips", "SELECT record_id, CAST(sid AS BIGINT) AS segment_id FROM sids", ruled=_RULED, sids=_SIDS))
def assign_segment_ids_w4(spark, sf):
    pts, by = _track(spark, sf)
    return S.assign_segment_ids(pts, by).select("record_id", "segment_id")


@register(
    "merge_short_segments_w5",
    chain(
        "trips",
        f"SELECT record_id, last_value(CASE WHEN sid = 0 OR dur >= 30 THEN m END IGNORE NULLS) OVER ({_WT} ROWS UNBOUNDED PRECEDING) AS mode "
        f"FROM (SELECT *, sum(time_delta_s) OVER (PARTITION BY {_ENT}, commute_id, sid) AS dur FROM sids)",
        ruled=_RULED,
        sids=_SIDS,
    ),
)
def merge_short_segments_w5(spark, sf):
    pts, by = _track(spark, sf)
    return S.merge_short_segments(pts, by, CFG).select("record_id", "mode")


@register(
    "detect_waiting_w6",
    chain(
        "trips",
        f"""SELECT record_id, CASE WHEN m = 'stationary' AND pm IS DISTINCT FROM nm THEN 'waiting' ELSE m END AS mode FROM (
          SELECT *, last_value(mv IGNORE NULLS) OVER ({_WT} ROWS UNBOUNDED PRECEDING) AS pm,
                 first_value(mv IGNORE NULLS) OVER ({_WT} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS nm
          FROM (SELECT *, CASE WHEN m IN ('walking', 'driving', 'train') THEN m END AS mv FROM ruled))""",
        ruled=_RULED,
    ),
)
def detect_waiting_w6(spark, sf):
    pts, by = _track(spark, sf)
    return S.detect_waiting(pts, by).select("record_id", "mode")


_SEG_OUT = "SELECT record_id, commute_id, transport_mode, segment_id FROM segmented"


@register("segment_w7", chain("segmented", _SEG_OUT))
def segment_w7(spark, sf):
    return on_trips(points(spark, sf)).select("record_id", "commute_id", "transport_mode", "segment_id")


@register("segment_with_zones_w7", chain("segmented", _SEG_OUT, zones=ZONES))
def segment_with_zones_w7(spark, sf):
    return on_trips(points(spark, sf, ZONES)).select("record_id", "commute_id", "transport_mode", "segment_id")


@register("segment_keep_boundaries_w7", chain("segmented", _SEG_OUT, zones=ZONES, keep_boundaries=True))
def segment_keep_boundaries_w7(spark, sf):
    pts = points(spark, sf, ZONES, CFG.with_(keep_forced_boundaries=True))
    return on_trips(pts).select("record_id", "commute_id", "transport_mode", "segment_id")


@register("waypoint_boundaries_w8", chain("classified", "SELECT record_id, bnd AS boundary FROM classified", zones=ZONES))
def waypoint_boundaries_w8(spark, sf):
    pts, by = _track(spark, sf)
    return C.WaypointClassifier(ZONES.waypoints).with_boundaries(pts, by, "boundary").select("record_id", "boundary")


_FEATURES_SQL = f"""
SELECT record_id, commute_id, "user", device, tst, speed_kmh, acceleration, bearing, bearing_change,
       avg(speed_kmh) OVER w AS speed_mean_w10, coalesce(stddev_samp(speed_kmh) OVER w, 0) AS speed_std_w10,
       coalesce(stddev_samp(acceleration) OVER w, 0) AS accel_std_w10, avg(bearing_change) OVER w AS bearing_change_mean_w10,
       sum(distance_m) OVER w AS distance_sum_w10, is_stopped, transport_mode,
       hour("timestamp") AS hour, minute("timestamp") AS minute, isodow("timestamp") - 1 AS day_of_week,
       CASE WHEN is_stopped = 1 THEN sum(time_delta_s) OVER
         (PARTITION BY {_ENT}, commute_id, island, is_stopped ORDER BY tst, record_id ROWS UNBOUNDED PRECEDING) ELSE 0 END AS stop_duration_s
FROM (
  SELECT *, CASE WHEN bearing_before IS NULL THEN 0 WHEN abs(bearing - bearing_before) > 180 THEN 360 - abs(bearing - bearing_before)
            ELSE abs(bearing - bearing_before) END AS bearing_change,
         sum(1 - is_stopped) OVER ({_WT} ROWS UNBOUNDED PRECEDING) AS island
  FROM (SELECT *, lag(bearing) OVER ({_WT}) AS bearing_before FROM (
    SELECT *, CAST(speed_kmh < 1 AS INT) AS is_stopped,
           CASE WHEN lag(tst) OVER ({_WT}) IS NULL OR time_delta_s <= 0 THEN 0
                ELSE (speed_kmh - lag(speed_kmh) OVER ({_WT})) / time_delta_s END AS acceleration,
           CASE WHEN lag(tst) OVER ({_WT}) IS NULL THEN 0
                ELSE {bearing_sql(f"lag(lat) OVER ({_WT})", f"lag(lon) OVER ({_WT})", "lat", "lon")} END AS bearing
    FROM segmented)))
WINDOW w AS ({_WT} ROWS BETWEEN 5 PRECEDING AND 5 FOLLOWING)
"""
_CV10 = "CASE WHEN speed_mean_w10 > 0 THEN speed_std_w10 / speed_mean_w10 ELSE 0 END"
FEATURE_OUT_SQL = ", ".join(
    f"{rnd(e, 3)} AS {n}"
    for n, e in {
        "acceleration": "acceleration", "bearing": "bearing", "bearing_change": "bearing_change",
        "speed_mean_w10": "speed_mean_w10", "speed_std_w10": "speed_std_w10", "speed_cv_w10": _CV10,
        "accel_std_w10": "accel_std_w10", "bearing_change_mean_w10": "bearing_change_mean_w10",
        "distance_sum_w10": "distance_sum_w10", "stop_duration_s": "stop_duration_s",
        "hour_sin": "sin(2 * pi() * hour / 24)", "hour_cos": "cos(2 * pi() * hour / 24)",
    }.items()
)
FEATURE_NAMES = (
    "acceleration", "bearing", "bearing_change", "speed_mean_w10", "speed_std_w10", "speed_cv_w10", "accel_std_w10",
    "bearing_change_mean_w10", "distance_sum_w10", "stop_duration_s", "hour_sin", "hour_cos",
)
FEATURES_SQL = _FEATURES_SQL


@register(
    "point_features_w9",
    chain(
        "segmented",
        f"SELECT record_id, {FEATURE_OUT_SQL}, CAST(hour AS BIGINT) AS hour, CAST(minute AS BIGINT) AS minute, "
        "CAST(day_of_week AS BIGINT) AS day_of_week, CAST(is_stopped AS BIGINT) AS is_stopped FROM feats",
        feats=_FEATURES_SQL,
    ),
)
def point_features_w9(spark, sf):
    feats = point_features(on_trips(trip_points(spark, sf)), CFG)
    return plain(feats.select("record_id", *FEATURE_NAMES, "hour", "minute", "day_of_week", "is_stopped"))


@register("stop_duration_w10", chain("segmented", f"SELECT record_id, {rnd('stop_duration_s', 3)} AS stop_duration_s FROM feats", feats=_FEATURES_SQL))
def stop_duration_w10(spark, sf):
    feats = point_features(on_trips(trip_points(spark, sf)), CFG)
    return plain(feats.select("record_id", "stop_duration_s"))


# ------------------------------------------------------------- classification


def _scored(spark, sf, classifier, zones=False):
    pts, by = _track(spark, sf)
    pts = classifier.score(pts, by, "s")
    return plain(pts.select("record_id", *[F.col("s")[i].alias(m) for i, m in enumerate(MODES)]))


def _scores_sql(**by_mode: str) -> str:
    return "SELECT record_id, " + ", ".join(f"{rnd(by_mode.get(m, '0.0'), 3)} AS {m}" for m in MODES) + " FROM variance"


@register(
    "speed_classifier_c1",
    chain("variance", _scores_sql(**{m: f"CASE WHEN {_RULE} = '{m}' THEN 1.0 ELSE 0.0 END" for m in MODES})),
)
def speed_classifier_c1(spark, sf):
    return _scored(spark, sf, C.SpeedClassifier(CFG))


@register(
    "variance_classifier_c2",
    chain(
        "variance",
        _scores_sql(
            train="CASE WHEN cv < 0.25 THEN 1.0 - cv / 0.25 ELSE 0.0 END",
            driving="CASE WHEN cv >= 0.25 THEN least(1.0, (cv - 0.25) / 0.25) ELSE 0.0 END",
        ),
    ),
)
def variance_classifier_c2(spark, sf):
    return _scored(spark, sf, C.SpeedVarianceClassifier(CFG))


def _hint_sql(mode: str) -> str:
    hits = [waypoint_in(w) for w in ZONES.waypoints if w.mode_hint == mode]
    return f"CASE WHEN {' OR '.join(hits)} THEN 1.0 ELSE 0.0 END" if hits else "0.0"


@register("waypoint_classifier_c3", chain("variance", _scores_sql(**{m: _hint_sql(m) for m in MODES})))
def waypoint_classifier_c3(spark, sf):
    return _scored(spark, sf, C.WaypointClassifier(ZONES.waypoints))


def _near_sql(mode: str) -> str:
    near = [
        f"CASE WHEN {corridor_dist(c)} <= {c.buffer_m!r} THEN 1.0 - {corridor_dist(c)} / {c.buffer_m!r} ELSE 0.0 END"
        for c in ZONES.corridors
        if c.mode == mode
    ]
    return f"greatest({', '.join(near)})" if near else "0.0"


@register("corridor_classifier_c4", chain("variance", _scores_sql(**{m: _near_sql(m) for m in MODES})))
def corridor_classifier_c4(spark, sf):
    return _scored(spark, sf, C.CorridorClassifier(ZONES.corridors))


@register("ensemble_vote_c5", chain("classified", "SELECT record_id, mode0 AS mode FROM classified", zones=ZONES))
def ensemble_vote_c5(spark, sf):
    pts, by = _track(spark, sf)
    return C.build_ensemble(ZONES, CFG).classify(pts, by).select("record_id", "mode")


@register(
    "classify_with_confidence_c6",
    chain(
        "classified",
        "SELECT record_id, mode0 AS mode, " + ", ".join(f"{rnd(f'v_{m}', 3)} AS {m}" for m in MODES) + " FROM classified",
        zones=ZONES,
    ),
)
def classify_with_confidence_c6(spark, sf):
    pts, by = _track(spark, sf)
    rows = C.build_ensemble(ZONES, CFG).classify_with_confidence(pts, by)
    return plain(rows.select("record_id", "mode", *[F.col("mode_scores")[i].alias(m) for i, m in enumerate(MODES)]))


@register("default_ensemble_c7", chain("classified", "SELECT record_id, mode0 AS mode FROM classified"))
def default_ensemble_c7(spark, sf):
    pts, by = _track(spark, sf)
    return C.build_ensemble(cfg=CFG).classify(pts, by).select("record_id", "mode")


@register(
    "plugin_classifier_c8",
    chain("variance", f"SELECT record_id, CASE WHEN speed_kmh < 1 THEN 'stationary' WHEN speed_kmh < 7 AND lat < 40.8004 THEN 'driving' ELSE {_RULE} END AS mode FROM variance"),
)
def plugin_classifier_c8(spark, sf):
    """A third-party pandas model that outvotes the speed rule for slow points in the south."""
    def slow_in_the_south(speed: pd.Series, lat: pd.Series) -> pd.Series:
        hit = (speed >= 1) & (speed < 7) & (lat < 40.8004)
        return hit.map(lambda h: [0.0, 0.0, 0.0, 1.0 if h else 0.0, 0.0])

    pts, by = _track(spark, sf)
    plugin = C.PandasClassifier("south", slow_in_the_south, ("speed_kmh", "lat"))
    ensemble = C.Ensemble(((C.SpeedClassifier(CFG), 1.0), (plugin, 3.0)))
    return ensemble.classify(pts, by).select("record_id", "mode")


@register("mode_by_speed_c9", chain("enriched", f"SELECT record_id, {_RULE} AS mode FROM enriched"))
def mode_by_speed_c9(spark, sf):
    return enriched(spark, sf).select("record_id", modes.mode_by_speed("speed_kmh").alias("mode"))


# ------------------------------------------------------------- zone joins


@register(
    "points_in_waypoints_j3",
    chain(
        "pings",
        " UNION ALL ".join(
            f"SELECT record_id, '{w.name}' AS zone, {rnd(haversine('lat', 'lon', repr(w.lat), repr(w.lon)), 3)} AS zone_distance_m FROM pings WHERE {waypoint_in(w)}"
            for w in ZONES.waypoints
        ),
    ),
)
def points_in_waypoints_j3(spark, sf):
    hits = Z.points_in_waypoints(pings(spark, sf), ZONES.waypoints)
    return plain(hits.select("record_id", "zone", "zone_distance_m"))


@register(
    "points_in_corridors_j4",
    chain(
        "pings",
        " UNION ALL ".join(
            f"SELECT record_id, '{c.name}' AS zone, '{c.mode}' AS mode, {rnd(corridor_dist(c), 3)} AS zone_distance_m, "
            f"{rnd(f'1.0 - {corridor_dist(c)} / {c.buffer_m!r}', 3)} AS confidence FROM pings WHERE {corridor_dist(c)} <= {c.buffer_m!r}"
            for c in ZONES.corridors
        ),
    ),
)
def points_in_corridors_j4(spark, sf):
    hits = Z.points_in_corridors(pings(spark, sf), ZONES.corridors)
    return plain(hits.select("record_id", "zone", "mode", "zone_distance_m", "confidence"))




# ------------------------------------------------------------- one trip of three months

# every ping on the way, days three days apart, with one point at home before and one at work after all others
_WAY = "CASE WHEN lat IN (40.75e0, 40.85e0) THEN 40.8003e0 ELSE lat END"
_STRETCH = "({floor} * 3 * 86400 + tst % 86400)"
_LONG_SPARK = f"""
SELECT record_id, 'u' AS user, 'd' AS device, {_STRETCH.format(floor="(tst div 86400)")} AS tst, {_WAY} AS lat, -73.98e0 AS lon FROM _long_pings
UNION ALL SELECT -1L, 'u', 'd', {_STRETCH.format(floor="(min(tst) div 86400)").replace("tst %", "min(tst) %")} - 60, 40.75e0, -74.0e0 FROM _long_pings
UNION ALL SELECT -2L, 'u', 'd', {_STRETCH.format(floor="(max(tst) div 86400)").replace("tst %", "max(tst) %")} + 60, 40.85e0, -73.95e0 FROM _long_pings
"""
_LONG_SQL = (
    _LONG_SPARK.replace("_long_pings", f"({PINGS_SQL})").replace(" div ", " // ").replace("AS user", 'AS "user"').replace("-1L", "-1").replace("-2L", "-2")
)


def _long_trip(spark, sf):
    pings(spark, sf).createOrReplaceTempView("_long_pings")
    return sequence.enrich_and_detect(spark.sql(_LONG_SPARK), CFG)


@register("segment_long_trip_w7", chain("segmented", _SEG_OUT, source=_LONG_SQL))
def segment_long_trip_w7(spark, sf):
    pts = segment_in_shards(_long_trip(spark, sf), cfg=CFG, shard_seconds=7200)
    return on_trips(pts).select("record_id", "commute_id", "transport_mode", "segment_id")


@register("segment_long_trip_zones_w7", chain("segmented", _SEG_OUT, zones=ZONES, keep_boundaries=True, source=_LONG_SQL))
def segment_long_trip_zones_w7(spark, sf):
    cfg = CFG.with_(keep_forced_boundaries=True)
    pts = segment_in_shards(_long_trip(spark, sf), C.build_ensemble(ZONES, cfg), cfg, shard_seconds=900)
    return on_trips(pts).select("record_id", "commute_id", "transport_mode", "segment_id")


@register(
    "point_features_long_trip_w9",
    chain("segmented", f"SELECT record_id, {FEATURE_OUT_SQL} FROM feats", source=_LONG_SQL, feats=_FEATURES_SQL),
)
def point_features_long_trip_w9(spark, sf):
    feats = point_features_in_shards(on_trips(_long_trip(spark, sf)), shard_seconds=3600)
    return plain(feats.select("record_id", *FEATURE_NAMES))


@register(
    "polyline_long_trip_w13",
    chain(
        "segmented",
        f"SELECT commute_id, segment_id, transport_mode, vertex, lat, lon FROM (SELECT *, row_number() OVER (PARTITION BY {_ENT}, commute_id, segment_id "
        f"ORDER BY tst, record_id) AS vertex, count(*) OVER (PARTITION BY {_ENT}, commute_id, segment_id) AS of_line FROM segmented) WHERE of_line > 1",
        source=_LONG_SQL,
    ),
)
def polyline_long_trip_w13(spark, sf):
    pts = segment_in_shards(_long_trip(spark, sf), cfg=CFG, shard_seconds=7200)
    lines = polyline_vertices_in_shards(pts, shard_seconds=7200)
    return lines.select("commute_id", "segment_id", "transport_mode", F.col("vertex").cast("bigint").alias("vertex"), "lat", "lon")


# ------------------------------------------------------------- polygons

# concave, with a hole, across the antimeridian, and one inside another
_POLYGONS = (
    ("Zone/Concave", (((10.3, 10.7), (10.3, 60.2), (50.9, 60.2), (20.4, 35.6), (50.9, 10.7)),)),
    ("Zone/Holed", (((-60.2, -120.3), (-60.2, -40.8), (5.7, -40.8), (5.7, -120.3)), ((-40.1, -100.6), (-40.1, -60.9), (-10.3, -60.9), (-10.3, -100.6)))),
    ("Zone/Dateline", (((-30.3, 150.6), (-30.3, -140.2), (30.8, -150.7), (10.1, 179.3), (30.8, 160.9)),)),
    ("Zone/Small", (((20.2, 15.1), (20.2, 25.3), (30.4, 20.6)),)),
)
_GLOBE = "SELECT event_id AS record_id, (event_id * 7919 % 170000) / 1000.0e0 - 85 AS lat, (event_id * 104729 % 360000) / 1000.0e0 - 179.99951e0 AS lon FROM {events}"


def _polygon_sql() -> str:
    """Rays to the east over all edges of a polygon, in three turns; the smallest area wins."""
    found = []
    for name, rings in sorted(_POLYGONS, key=lambda z: edges_of(z[1])[1]):
        edges, _ = edges_of(rings)
        turns = []
        for turn in (-360.0, 0.0, 360.0):
            hits = [
                f"CAST(({y1!r} > lat) <> ({y2!r} > lat) AND lon < {x1 + turn!r} + (lat - {y1!r}) * {x2 - x1!r} / nullif({y2 - y1!r}, 0) AS INT)"
                for x1, y1, x2, y2 in edges.tolist()
            ]
            turns.append("(" + " + ".join(f"coalesce({h}, 0)" for h in hits) + ") % 2 = 1")
        found.append(f"WHEN {' OR '.join(turns)} THEN '{name}'")
    return f"SELECT record_id, CASE {' '.join(found)} ELSE 'UTC' END AS timezone FROM ({_GLOBE.format(events='events')})"


@register("resolve_polygon_g8", _polygon_sql())
def resolve_polygon_g8(spark, sf):
    events(spark, sf).createOrReplaceTempView("_events_of_globe")
    pts = spark.sql(_GLOBE.format(events="_events_of_globe"))
    return resolve_polygon(pts, polygons(spark, _POLYGONS), "UTC").select("record_id", "timezone")
