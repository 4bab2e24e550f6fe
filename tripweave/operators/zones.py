"""Point-in-zone lookups: waypoints, corridors and time-zone boxes.

Small zone sets (the normal case: a person's own stops and routes) become plain
expressions. Larger ones become a grid index, one row per cell with the zones that
can reach it, joined on the cell key; a point never meets zones from other cells.
Every zone lies in the grid whose cells are about its own size, so one country-sized box
does not put a thousand stops into one cell; a point looks into each grid in use, of
which there are LEVELS at most.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tripweave.config import ENTITY, Corridor, TzRegion, Waypoint
from tripweave.functions.geo import degree_margin, haversine_m
from tripweave.schema import _D, _S, _struct

UNROLL_LIMIT = 96
BROADCAST_ROWS = 200_000
#: Cell sizes in degrees are FINEST times a power of two; the last one is larger than the globe.
FINEST, LEVELS = 0.005, 17

_CIRCLE = _struct(
    ("zone", _S), ("mode", _S), ("zone_lat", _D), ("zone_lon", _D), ("radius_m", _D), ("dlat", _D), ("dlon", _D)
)
_BOX = _struct(("zone", _S), ("lat_min", _D), ("lat_max", _D), ("lon_min", _D), ("lon_max", _D))


def broadcast_if_small(df: DataFrame, entries: DataFrame, max_rows: int = BROADCAST_ROWS) -> DataFrame:
    """Broadcast hint only after counting the (zone, cell) entries that ``df`` holds; larger frames are left to a shuffle join."""
    return F.broadcast(df) if entries.limit(max_rows + 1).count() <= max_rows else df


def waypoint_circles(spark: SparkSession, waypoints: Sequence[Waypoint]) -> DataFrame:
    rows = [(w.name, w.mode_hint, w.lat, w.lon, w.radius_m, *degree_margin(w.lat, w.radius_m)) for w in waypoints]
    return spark.createDataFrame(rows, _CIRCLE)


def corridor_circles(spark: SparkSession, corridors: Sequence[Corridor]) -> DataFrame:
    rows = [
        (c.name, c.mode, lat, lon, c.buffer_m, *degree_margin(lat, c.buffer_m))
        for c in corridors
        for lat, lon in c.sample_points()
    ]
    return spark.createDataFrame(rows, _CIRCLE)


def tz_boxes(spark: SparkSession, regions: Sequence[TzRegion]) -> DataFrame:
    return spark.createDataFrame([(r.tz, r.lat_min, r.lat_max, r.lon_min, r.lon_max) for r in regions], _BOX)


def _step(level: Column) -> Column:
    return F.lit(FINEST) * F.pow(F.lit(2.0), level)


def _cells(boxes: DataFrame) -> tuple[DataFrame, list[int]]:
    """Boxes exploded over the cells of their own grid, and the grids in use. A cell is at least as wide as its boxes, so a
    box touches a handful of cells. Longitudes wrap at the antimeridian."""
    extent = F.greatest(F.col("lat_max") - F.col("lat_min"), F.col("lon_max") - F.col("lon_min"), F.lit(FINEST))
    level = F.least(F.greatest(F.ceil(F.log2(extent / FINEST)), F.lit(0)), F.lit(LEVELS - 1)).cast("int")
    wrapped = boxes.withColumn("cell_level", level).withColumn("_turn", F.explode(F.array(*[F.lit(t) for t in (-360.0, 0.0, 360.0)]))).withColumns(
        {
            "_lon0": F.greatest(F.col("lon_min") + F.col("_turn"), F.lit(-180.0)),
            "_lon1": F.least(F.col("lon_max") + F.col("_turn"), F.lit(180.0)),
        }
    )
    step = _step(F.col("cell_level"))
    cells = (
        wrapped.filter("_lon0 <= _lon1")
        .withColumn("cell_lat", F.explode(F.sequence(F.floor(F.col("lat_min") / step), F.floor(F.col("lat_max") / step))))
        .withColumn("cell_lon", F.explode(F.sequence(F.floor(F.col("_lon0") / step), F.floor(F.col("_lon1") / step))))
        .drop("_turn", "_lon0", "_lon1")
        .distinct()
    )
    used = boxes.select(level.alias("level")).distinct().collect()  # LEVELS rows at most
    return cells, sorted(r["level"] for r in used if r["level"] is not None)


def _circle_boxes(circles: DataFrame) -> DataFrame:
    return circles.withColumns(
        {
            "lat_min": F.col("zone_lat") - F.col("dlat"),
            "lat_max": F.col("zone_lat") + F.col("dlat"),
            "lon_min": F.col("zone_lon") - F.col("dlon"),
            "lon_max": F.col("zone_lon") + F.col("dlon"),
        }
    ).drop("dlat", "dlon")


_CELL = ["cell_level", "cell_lat", "cell_lon"]


def _cell_of(level: Column) -> dict[str, Column]:
    return {"cell_level": level, "cell_lat": F.floor(F.col("lat") / _step(level)), "cell_lon": F.floor(F.col("lon") / _step(level))}


def _looked_up(pts: DataFrame, index: DataFrame, cells: DataFrame, levels: Sequence[int], out: str) -> DataFrame:
    """Add ``out``: what the index's array holds for the point's cell in every grid in use, one join for each."""
    found = []
    for level in levels:
        one = index.filter(F.col("cell_level") == level).withColumnRenamed(out, f"_{out}_{level}")
        pts = pts.withColumns(_cell_of(F.lit(level))).join(broadcast_if_small(one, cells), _CELL, "left").drop(*_CELL)
        found.append(f"_{out}_{level}")
    kind = index.schema[out].dataType
    arrays = [F.coalesce(F.col(c), F.array().cast(kind)) for c in found] or [F.array().cast(kind)]
    return pts.withColumn(out, F.concat(*arrays)).drop(*found)


def with_zone_candidates(pts: DataFrame, circles: DataFrame, out: str) -> DataFrame:
    """Add ``out``: the zones whose circle may hold the point, with their distance."""
    cells, levels = _cells(_circle_boxes(circles))
    index = cells.groupBy(*_CELL).agg(F.collect_list(F.struct("zone", "mode", "zone_lat", "zone_lon", "radius_m")).alias(out))
    joined = _looked_up(pts, index, cells, levels, out)

    def measured(z: Column) -> Column:
        distance = haversine_m(F.col("lat"), F.col("lon"), z["zone_lat"], z["zone_lon"])
        return F.struct(
            z["zone"].alias("zone"), z["mode"].alias("mode"), z["radius_m"].alias("radius_m"), distance.alias("distance_m")
        )

    hits = F.filter(F.transform(F.col(out), measured), lambda z: z["distance_m"] <= z["radius_m"])
    return joined.withColumn(out, F.coalesce(hits, F.array().cast(_HITS)))


_HITS = "array<struct<zone:string,mode:string,radius_m:double,distance_m:double>>"


def _zone_join(pts: DataFrame, circles: DataFrame) -> DataFrame:
    cells, levels = _cells(_circle_boxes(circles))
    cells = cells.drop("lat_min", "lat_max", "lon_min", "lon_max")
    # one copy of a point for each grid in use
    level = F.explode(F.array(*map(F.lit, levels)) if levels else F.array().cast("array<int>"))
    return (
        pts.withColumn("_grid", level)
        .withColumns(_cell_of(F.col("_grid")))
        .drop("_grid")
        .join(broadcast_if_small(cells, cells), _CELL)
        .withColumn("zone_distance_m", haversine_m("lat", "lon", "zone_lat", "zone_lon"))
        .filter("zone_distance_m <= radius_m")
        .drop(*_CELL)
    )


def points_in_waypoints(pts: DataFrame, waypoints: Sequence[Waypoint]) -> DataFrame:
    """One row per (point, waypoint) with the point inside the waypoint's radius."""
    return _zone_join(pts, waypoint_circles(pts.sparkSession, waypoints))


def points_in_corridors(pts: DataFrame, corridors: Sequence[Corridor], key: Sequence[str] = (*ENTITY, "record_id")) -> DataFrame:
    """One row per (point, corridor) within the buffer: nearest distance and confidence."""
    nearest = _zone_join(pts, corridor_circles(pts.sparkSession, corridors)).groupBy(
        *key, "zone", "mode", "radius_m"
    ).agg(F.min("zone_distance_m").alias("zone_distance_m"))
    return nearest.withColumn("confidence", 1.0 - F.col("zone_distance_m") / F.col("radius_m"))


def inside_waypoint(waypoint: Waypoint) -> Column:
    """Point in waypoint, with a cheap box test before the trigonometry."""
    dlat, dlon = degree_margin(waypoint.lat, waypoint.radius_m)
    exact = haversine_m("lat", "lon", waypoint.lat, waypoint.lon) <= waypoint.radius_m
    if abs(waypoint.lon) + dlon > 180:
        return exact
    return (
        F.col("lat").between(waypoint.lat - dlat, waypoint.lat + dlat)
        & F.col("lon").between(waypoint.lon - dlon, waypoint.lon + dlon)
        & exact
    )


def near_corridor_box(corridor: Corridor) -> Column:
    """Box that is certain to hold every point within the corridor's buffer."""
    samples = corridor.sample_points()
    boxes = [(lat, lon, *degree_margin(lat, corridor.buffer_m)) for lat, lon in samples]
    if any(abs(lon) + dlon > 180 for _, lon, _, dlon in boxes):
        return F.lit(True)
    return F.col("lat").between(
        min(lat - dlat for lat, _, dlat, _ in boxes), max(lat + dlat for lat, _, dlat, _ in boxes)
    ) & F.col("lon").between(min(lon - dlon for _, lon, _, dlon in boxes), max(lon + dlon for _, lon, _, dlon in boxes))


def resolve_timezone(
    pts: DataFrame, tz_regions: Sequence[TzRegion] | DataFrame | None, default_tz: str, out: str = "timezone"
) -> DataFrame:
    """IANA zone of each point: smallest box holding it, else the default."""
    if tz_regions is None or (not isinstance(tz_regions, DataFrame) and not tz_regions):
        return pts.withColumn(out, F.lit(default_tz))
    if not isinstance(tz_regions, DataFrame) and len(tz_regions) <= UNROLL_LIMIT:
        def holds(r: TzRegion) -> Column:
            return F.col("lat").between(r.lat_min, r.lat_max) & F.col("lon").between(r.lon_min, r.lon_max)

        found = [F.when(holds(r), r.tz) for r in sorted(tz_regions, key=lambda r: (r.area, r.tz))]
        return pts.withColumn(out, F.coalesce(*found, F.lit(default_tz)))
    boxes = tz_regions if isinstance(tz_regions, DataFrame) else tz_boxes(pts.sparkSession, tz_regions)
    cells, levels = _cells(boxes)
    area = (F.col("lat_max") - F.col("lat_min")) * (F.col("lon_max") - F.col("lon_min"))
    index = cells.groupBy(*_CELL).agg(F.collect_list(F.struct(area.alias("area"), "zone", "lat_min", "lat_max", "lon_min", "lon_max")).alias("_boxes"))
    inside = F.filter(
        F.col("_boxes"),
        lambda b: F.col("lat").between(b["lat_min"], b["lat_max"]) & F.col("lon").between(b["lon_min"], b["lon_max"]),
    )
    return (
        _looked_up(pts, index, cells, levels, "_boxes")
        .withColumn(out, F.coalesce(F.array_min(inside)["zone"], F.lit(default_tz)))
        .drop("_boxes")
    )
