"""Points in polygons: time zones as real outlines, with holes, concave, and across the antimeridian.

A polygon is cut into cells of a hierarchical grid. A cell wholly inside needs no test. A cell on the outline keeps the edges that reach it and
whether its corner is inside; a point is inside if the way from that corner to it, along the cell, crosses an odd number of those edges. So a point
tests the few edges of its own cell, however long the outline is, and joins on cell keys alone.

Polygons are cut by the tasks that hold them, one row at a time.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tripweave.operators.zones import broadcast_if_small

#: The grid's corner and width in degrees. The corner is off any round coordinate, so that no outline runs along a cell's edge.
X0, Y0, WIDTH = -180.003141592, -90.002718281, 512.0
#: Halvings of the width at which cells are kept: 32 degrees down to 0.125; and edges that are few enough for a cell to stay whole.
LEVELS, FEW_EDGES = (4, 6, 8, 10, 12), 6

POLYGONS = "zone string, rings array<array<struct<lat:double,lon:double>>>"
_CELLS = "level int, cx int, cy int, zone string, area double, rx double, ry double, odd boolean, edges array<struct<x1:double,y1:double,x2:double,y2:double>>"
_EDGE = pa.struct([(c, pa.float64()) for c in ("x1", "y1", "x2", "y2")])
_ARROW = pa.schema([
    ("level", pa.int32()), ("cx", pa.int32()), ("cy", pa.int32()), ("zone", pa.string()), ("area", pa.float64()), ("rx", pa.float64()), ("ry", pa.float64()),
    ("odd", pa.bool_()), ("edges", pa.list_(_EDGE)),
])


def polygons(spark: SparkSession, zones: Sequence[tuple[str, Sequence[Sequence[tuple[float, float]]]]]) -> DataFrame:
    """Frame of (zone, rings); a ring is a list of (lat, lon), the first one the outline, others holes."""
    return spark.createDataFrame([(name, [[(float(a), float(b)) for a, b in ring] for ring in rings]) for name, rings in zones], POLYGONS)


def unwrapped(ring: Sequence[tuple[float, float]]) -> np.ndarray:
    """(lon, lat) of a ring whose neighbours are less than half a turn apart; a ring across the antimeridian goes on beyond 180."""
    points = np.array([(lon, lat) for lat, lon in ring], float)
    points[:, 0] = np.degrees(np.unwrap(np.radians(points[:, 0])))
    return points


def edges_of(rings: Sequence[Sequence[tuple[float, float]]]) -> tuple[np.ndarray, float]:
    """Edges (x1, y1, x2, y2) of all rings, in one turn, and the outline's area in square degrees."""
    out, area, first = [], 0.0, None
    for ring in rings:
        if len(ring) < 3:
            continue
        p = unwrapped(ring)
        if first is None:
            first = p[0, 0]
        p[:, 0] += 360 * round((first - p[0, 0]) / 360)  # holes lie in the outline's turn
        q = np.roll(p, -1, axis=0)
        if not out:
            area = abs(float((p[:, 0] * q[:, 1] - q[:, 0] * p[:, 1]).sum())) / 2
        out.append(np.hstack([p, q]))
    return (np.concatenate(out) if out else np.zeros((0, 4))), area


def crossings(edges: np.ndarray, rx: float, ry: float, px: float, py: float) -> int:
    """Edges crossed on the way from r along the parallel to the meridian of p, and along it to p."""
    x1, y1, x2, y2 = edges.T
    with np.errstate(divide="ignore", invalid="ignore"):
        across = (y1 > ry) != (y2 > ry)
        x = x1 + (ry - y1) * (x2 - x1) / (y2 - y1)
        along = (x1 > px) != (x2 > px)
        y = y1 + (px - x1) * (y2 - y1) / (x2 - x1)
    return int((across & ((x > rx) != (x > px))).sum() + (along & ((y > ry) != (y > py))).sum())


def covering(rings: Sequence[Sequence[tuple[float, float]]]) -> Iterator[tuple[int, int, int, bool, np.ndarray]]:
    """(level, cx, cy, corner inside, edges) of the cells that a polygon touches; no edges: the cell is inside."""
    edges, _ = edges_of(rings)
    if not len(edges):
        return
    for turn in (-360.0, 0.0, 360.0):
        shifted = edges + np.array([turn, 0, turn, 0])
        low, high = shifted.reshape(-1, 2).min(0), shifted.reshape(-1, 2).max(0)
        if high[0] < -180 or low[0] > 180:
            continue
        size = WIDTH / 2 ** LEVELS[0]
        a, b = np.floor((np.maximum(low, (X0, Y0)) - (X0, Y0)) / size).astype(int), np.floor((np.minimum(high, (180.0, 90.0)) - (X0, Y0)) / size).astype(int)
        far = float(low[0] - 1)  # a point outside
        for cx in range(a[0], b[0] + 1):
            for cy in range(a[1], b[1] + 1):
                rx, ry = X0 + cx * size, Y0 + cy * size
                yield from _cut(0, cx, cy, crossings(shifted, far, ry, rx, ry) % 2 == 1, shifted)


def _cut(depth: int, cx: int, cy: int, odd: bool, edges: np.ndarray) -> Iterator[tuple[int, int, int, bool, np.ndarray]]:
    size = WIDTH / 2 ** LEVELS[depth]
    rx, ry = X0 + cx * size, Y0 + cy * size
    x, y = edges[:, [0, 2]], edges[:, [1, 3]]
    near = edges[(x.max(1) >= rx) & (x.min(1) <= rx + size) & (y.max(1) >= ry) & (y.min(1) <= ry + size)]
    if not len(near):
        if odd:
            yield LEVELS[depth], cx, cy, True, near
        return
    if depth + 1 == len(LEVELS) or len(near) <= FEW_EDGES:
        yield LEVELS[depth], cx, cy, odd, near
        return
    parts = 2 ** (LEVELS[depth + 1] - LEVELS[depth])
    step = size / parts
    for i in range(parts):
        for j in range(parts):
            inside = odd ^ (crossings(near, rx, ry, rx + i * step, ry + j * step) % 2 == 1)
            yield from _cut(depth + 1, cx * parts + i, cy * parts + j, inside, near)


def cells(zones: DataFrame) -> DataFrame:
    """Covering cells of all polygons of (zone, rings)."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                rings = [[(p["lat"], p["lon"]) for p in ring or ()] for ring in row["rings"] or ()]
                area, out = edges_of(rings)[1], []
                for level, cx, cy, odd, edges in covering(rings):
                    size = WIDTH / 2**level
                    named = [dict(zip(("x1", "y1", "x2", "y2"), e, strict=True)) for e in edges.tolist()]
                    out.append({"level": level, "cx": cx, "cy": cy, "zone": row["zone"], "area": area, "rx": X0 + cx * size, "ry": Y0 + cy * size, "odd": odd, "edges": named})
                yield pa.RecordBatch.from_pylist(out, _ARROW)

    return zones.select("zone", "rings").mapInArrow(cut, _CELLS)


def _inside(c: Column, px: Column, py: Column) -> Column:
    """The same count as ``crossings``, as an expression over the edges of one cell."""
    rx, ry = c["rx"], c["ry"]

    def met(e: Column) -> Column:
        x = e["x1"] + (ry - e["y1"]) * (e["x2"] - e["x1"]) / (e["y2"] - e["y1"])
        y = e["y1"] + (px - e["x1"]) * (e["y2"] - e["y1"]) / (e["x2"] - e["x1"])
        across = F.when((e["y1"] > ry) != (e["y2"] > ry), ((x > rx) != (x > px)).cast("int")).otherwise(0)
        along = F.when((e["x1"] > px) != (e["x2"] > px), ((y > ry) != (y > py)).cast("int")).otherwise(0)
        return across + along

    crossed = F.aggregate(c["edges"], F.lit(0), lambda n, e: n + met(e))
    return (c["odd"].cast("int") + crossed) % 2 == 1


def resolve_polygon(pts: DataFrame, zones: DataFrame, default: str | None = None, out: str = "timezone") -> DataFrame:
    """Name of the polygon around each point, the one of the smallest area where several are; ``default`` where none is or the place is unknown.

    Points are looked up in each level of the grid that is in use, five at most."""
    cut = cells(zones)
    index = cut.groupBy("level", "cx", "cy").agg(F.collect_list(F.struct("zone", "area", "rx", "ry", "odd", "edges")).alias("_zones"))
    x, y = F.pmod(F.col("lon") + 180, F.lit(360.0)) - 180, F.col("lat")
    found = []
    rows = pts
    for level in LEVELS:
        size = WIDTH / 2**level
        here = index.filter(F.col("level") == level).select(F.col("cx").alias("_cx"), F.col("cy").alias("_cy"), F.col("_zones").alias(f"_zones_{level}"))
        rows = rows.withColumns({"_cx": F.floor((x - X0) / size).cast("int"), "_cy": F.floor((y - Y0) / size).cast("int")})
        rows = rows.join(broadcast_if_small(here, cut.filter(F.col("level") == level)), ["_cx", "_cy"], "left").drop("_cx", "_cy")
        found.append(F.coalesce(F.col(f"_zones_{level}"), F.array().cast(index.schema["_zones"].dataType)))
    inside = F.filter(F.concat(*found), lambda c: _inside(c, x, y))
    best = F.array_min(F.transform(inside, lambda c: F.struct(c["area"].alias("area"), c["zone"].alias("zone"))))
    return rows.withColumn(out, F.coalesce(best["zone"], F.lit(default))).drop(*[f"_zones_{level}" for level in LEVELS])
