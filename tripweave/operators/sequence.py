"""Ordered per-entity operators: motion between consecutive points and trip detection.

An entity may own a large share of all rows, so no window here is partitioned by the
entity alone. Rows are hashed by (entity, time shard); what crosses a shard edge (the
previous point, an open departure, the next zone arrival) is computed on a frame with
one row per shard and joined back on the same key the rows are already hashed by.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window, functions as F
from pyspark.sql.types import StringType

from tripweave.config import ENTITY, TripConfig
from tripweave.functions.geo import haversine_m, in_geofence, speed_kmh
from tripweave.functions.timing import epoch_to_timestamp, to_local
from tripweave.functions.windows import ORDER, next_non_null, ordered, running
from tripweave.operators.polygons import resolve_polygon
from tripweave.operators.zones import resolve_timezone

_HOME, _WORK = 1, 2  # bits of the zone code


def _localised(pts: DataFrame, cfg: TripConfig, tz_regions, entity: Sequence[str]) -> DataFrame:
    known = {f.name: f.dataType for f in pts.schema}
    # a null key would vanish in the shard join; the receiver's default name is "unknown"
    named = {e: F.coalesce(F.col(e), F.lit("unknown")) for e in entity if isinstance(known[e], StringType)}
    pts = pts.withColumns(named) if named else pts
    if "timestamp" not in known:
        pts = pts.withColumn("timestamp", epoch_to_timestamp("tst"))
    outlines = isinstance(tz_regions, DataFrame) and "rings" in tz_regions.columns
    pts = (resolve_polygon if outlines else resolve_timezone)(pts, tz_regions, cfg.default_tz)
    pts = pts.withColumn("timestamp_local", to_local(epoch_to_timestamp("tst"), "timezone"))
    return pts.withColumn("local_date", F.col("timestamp_local").cast("date"))


def _sharded(pts: DataFrame, cfg: TripConfig) -> DataFrame:
    return pts.withColumn("_shard", F.floor(F.col("tst") / F.lit(cfg.shard_seconds)))


def _with_geofences(pts: DataFrame, cfg: TripConfig) -> DataFrame:
    return pts.withColumns(
        {
            "at_home": in_geofence("lat", "lon", cfg.home_lat, cfg.home_lon, cfg.home_radius_m),
            "at_work": in_geofence("lat", "lon", cfg.work_lat, cfg.work_lon, cfg.work_radius_m),
        }
    ).withColumn("_zone", F.col("at_home").cast("int") * _HOME + F.col("at_work").cast("int") * _WORK)


def locate(pts: DataFrame, cfg: TripConfig, tz_regions=None, entity: Sequence[str] = ENTITY) -> DataFrame:
    """Everything about a point that needs no neighbour: UTC and local time, date, geofences."""
    return _with_geofences(_localised(pts, cfg, tz_regions, entity), cfg).drop("_zone")


def _shard_edges(pts: DataFrame, entity: Sequence[str]) -> DataFrame:
    """Per shard: the last point of the shard before it. Needs no ordering of rows."""
    by = [*entity, "_shard"]
    tails = pts.groupBy(*by).agg(F.max(F.struct(*ORDER, "lat", "lon")).alias("tail"))
    before = F.lag("tail").over(Window.partitionBy(*entity).orderBy("_shard"))
    return tails.select(*by, F.struct(*[before[c].alias(c) for c in ("lat", "lon", "tst")]).alias("_edge"))


def _trip_edges(pts: DataFrame, entity: Sequence[str]) -> DataFrame:
    """Per shard: previous point, departure still open on entry, first zone reached after it."""
    by = [*entity, "_shard"]
    zone, zone_before = F.col("_zone"), F.col("_zone_before")
    narrow = pts.select(*by, *ORDER, "lat", "lon", "_zone", "local_date").withColumn(
        "_zone_before", F.lag("_zone").over(ordered(by))
    )
    shards = narrow.groupBy(*by).agg(
        F.max(F.struct(*ORDER, "lat", "lon", "_zone")).alias("tail"),
        F.min(F.struct(*ORDER, "_zone", "local_date")).alias("head"),
        F.max(
            F.when((zone == 0) & (zone_before > 0), F.struct(*ORDER, zone_before.alias("origin"), "local_date"))
        ).alias("left"),
        F.min(F.when(zone > 0, F.struct(*ORDER, "_zone"))).alias("reached"),
    )
    over_shards = Window.partitionBy(*entity).orderBy("_shard")
    shards = shards.withColumns(
        {
            "before": F.lag("tail").over(over_shards),
            "reached_zone": F.col("reached._zone"),
        }
    )
    left = F.struct(F.col("left.origin").alias("origin"), F.col("left.local_date").alias("local_date"))
    shards = shards.withColumns(
        {
            # the shard's first row leaves a zone that the previous shard ended in
            "left_at_head": F.when(
                (F.col("head._zone") == 0) & (F.col("before._zone") > 0),
                F.struct(F.col("before._zone").alias("origin"), F.col("head.local_date").alias("local_date")),
            ),
            "left_inside": F.when(F.col("left").isNotNull(), left),
        }
    ).withColumn("left_last", F.coalesce("left_inside", "left_at_head"))
    earlier = over_shards.rowsBetween(Window.unboundedPreceding, -1)
    return shards.select(
        *by,
        F.struct(*[F.col(f"before.{c}").alias(c) for c in ("lat", "lon", "tst", "_zone")]).alias("_edge"),
        F.coalesce("left_at_head", F.last("left_last", ignorenulls=True).over(earlier)).alias("_edge_left"),
        next_non_null("reached_zone", entity, ["_shard"]).alias("_edge_next"),
    )


def _motion(previous: str) -> dict:
    has_previous = F.col(f"{previous}.tst").isNotNull()
    dt = (F.col("tst") - F.col(f"{previous}.tst")).cast("double")
    return {
        "distance_m": F.when(
            has_previous, haversine_m(F.col(f"{previous}.lat"), F.col(f"{previous}.lon"), "lat", "lon")
        ).otherwise(F.lit(0.0)),
        "time_delta_s": F.coalesce(dt, F.lit(0.0)),
    }


def _with_motion(pts: DataFrame, previous: str) -> DataFrame:
    pts = pts.withColumns(_motion(previous)).withColumn("speed_kmh", speed_kmh("distance_m", "time_delta_s"))
    return pts.withColumn("is_stationary", F.col("speed_kmh") < 1.0)


def _previous(fields: Sequence[str]) -> "F.Column":
    """Previous row in the shard, else the edge carried in; null fields when there is none."""
    return F.struct(*[F.coalesce(F.col(f"_lag.{c}"), F.col(f"_edge.{c}")).alias(c) for c in fields])


def enrich(pts: DataFrame, cfg: TripConfig = TripConfig(), tz_regions=None, entity: Sequence[str] = ENTITY) -> DataFrame:
    """UTC and local time, and distance, time and speed since the previous point."""
    by = [*entity, "_shard"]
    pts = _sharded(_localised(pts, cfg, tz_regions, entity), cfg)
    edges = _shard_edges(pts, entity)
    fields = ["lat", "lon", "tst"]
    rows = pts.withColumn("_lag", F.lag(F.struct(*fields)).over(ordered(by))).join(edges, by)
    rows = rows.withColumn("_previous", _previous(fields))
    return _with_motion(rows, "_previous").drop("_shard", "_lag", "_edge", "_previous")


def _label_trips(rows: DataFrame) -> DataFrame:
    """Trip id and direction from the open departure and the next zone reached."""
    home_origin = F.col("_departure.origin").bitwiseAND(_HOME) > 0
    direction = F.when(home_origin & (F.col("_arrival").bitwiseAND(_WORK) > 0), "morning").when(
        ~home_origin & (F.col("_arrival").bitwiseAND(_HOME) > 0), "evening"
    )
    # zone points belong to a trip only as its arrival: the point before must be outside
    on_the_way = (F.col("_zone") == 0) | (F.col("_previous._zone") == 0)
    rows = rows.withColumn("commute_direction", F.when(on_the_way, direction))
    return rows.withColumn(
        "commute_id",
        F.when(
            F.col("commute_direction").isNotNull(),
            F.concat_ws("-", F.col("_departure.local_date").cast("string"), "commute_direction"),
        ),
    )


def _trip_rows(pts: DataFrame, entity: Sequence[str]) -> DataFrame:
    by = [*entity, "_shard"]
    edges = _trip_edges(pts, entity)
    fields = ["lat", "lon", "tst", "_zone"]
    rows = pts.withColumns(
        {
            "_lag": F.lag(F.struct(*fields)).over(ordered(by)),
            "_zone_here": F.when(F.col("_zone") > 0, F.col("_zone")),
        }
    )
    rows = rows.withColumn(
        "_leaving",
        F.when(
            (F.col("_zone") == 0) & (F.col("_lag._zone") > 0),
            F.struct(F.col("_lag._zone").alias("origin"), "local_date"),
        ),
    )
    # every window runs before the join, on one sort of one exchange
    rows = rows.withColumns(
        {
            "_left": F.last("_leaving", ignorenulls=True).over(running(by)),
            "_next": next_non_null("_zone_here", by),
        }
    ).join(edges, by)
    rows = rows.withColumns(
        {
            "_previous": _previous(fields),
            "_departure": F.coalesce("_left", "_edge_left"),
            "_arrival": F.coalesce("_zone_here", "_next", "_edge_next"),
        }
    )
    return _label_trips(rows)


_SCRATCH = (
    "_shard", "_zone", "_zone_here", "_lag", "_leaving", "_left", "_next", "_edge", "_edge_left", "_edge_next",
    "_previous", "_departure", "_arrival",
)


def detect_commutes(pts: DataFrame, cfg: TripConfig, entity: Sequence[str] = ENTITY) -> DataFrame:
    """Geofence flags, and id and direction of the trip each point belongs to.

    Expects ``timestamp_local``. A trip runs from the first point outside a zone to the
    first point inside the opposite zone; coming back to the origin cancels it.
    """
    if "local_date" not in pts.columns:
        pts = pts.withColumn("local_date", F.col("timestamp_local").cast("date"))
    return _trip_rows(_sharded(_with_geofences(pts, cfg), cfg), entity).drop(*_SCRATCH)


def enrich_and_detect(
    pts: DataFrame, cfg: TripConfig, tz_regions=None, entity: Sequence[str] = ENTITY
) -> DataFrame:
    """``enrich`` and ``detect_commutes`` over one shared exchange and one edge frame."""
    pts = _sharded(_with_geofences(_localised(pts, cfg, tz_regions, entity), cfg), cfg)
    return _with_motion(_trip_rows(pts, entity), "_previous").drop(*_SCRATCH)
