"""Polygons against a plain ray test over all edges."""

import math
import random

import pytest

from tripweave.operators import polygons as P


def star(pick, lat, lon, reach, corners):
    """A concave ring around a place; longitudes come back into -180..180."""
    out = []
    for i in range(corners):
        a = 2 * math.pi * i / corners
        r = reach * (0.7 + 0.25 * math.sin(5 * a) + pick.uniform(-0.02, 0.02))
        out.append((lat + 0.4 * r * math.sin(a), (lon + r * math.cos(a) + 180) % 360 - 180))
    return out


def brute(zones, lat, lon, default):
    best = None
    if lat is None or lon is None:
        return default
    for name, rings in zones:
        edges, area = P.edges_of(rings)
        for turn in (-360, 0, 360):
            x1, y1, x2, y2 = (edges + [turn, 0, turn, 0]).T
            with P.np.errstate(all="ignore"):
                hits = ((y1 > lat) != (y2 > lat)) & (lon < x1 + (lat - y1) * (x2 - x1) / (y2 - y1))
            if hits.sum() % 2 and (best is None or (area, name) < best):
                best = (area, name)
    return best[1] if best else default


@pytest.fixture(scope="module")
def zones():
    pick = random.Random(4)
    out = [(f"z{i}", [star(pick, pick.uniform(-60, 60), pick.uniform(-170, 170), pick.choice([0.05, 1, 8, 20]), pick.choice([3, 5, 40, 200]))]) for i in range(25)]
    out.append(("holed", [star(pick, 10, 20, 30, 60), star(pick, 10, 20, 8, 30)]))
    out.append(("dateline", [star(pick, -20, 179, 25, 80), star(pick, -20, -179, 5, 9)]))
    out.append(("dateline west", [star(pick, 50, -178, 12, 40)]))
    out += [("line", [[(0, 0), (1, 1)]]), ("none", [])]
    return out


def test_same_as_all_edges(spark, zones):
    pick = random.Random(5)
    rows = [(i, pick.uniform(-85, 85), pick.uniform(-180, 180)) for i in range(3000)]
    for name, rings in zones:  # many close to each outline
        for lat, lon in (rings[0] if rings else [])[:40]:
            rows.append((len(rows), lat + pick.gauss(0, 0.1), (lon + pick.gauss(0, 0.2) + 180) % 360 - 180))
    rows += [(len(rows), None, 5.0), (len(rows) + 1, 5.0, None), (len(rows) + 2, 90.0, 180.0), (len(rows) + 3, -90.0, -180.0)]
    pts = spark.createDataFrame(rows, "id long, lat double, lon double").repartition(4)
    got = {r.id: r.timezone for r in P.resolve_polygon(pts, P.polygons(spark, zones), "UTC").collect()}
    want = {i: brute(zones, lat, lon, "UTC") for i, lat, lon in rows}
    assert got == want
    assert {"holed", "dateline", "dateline west", "UTC"} <= set(want.values())


def test_cells_inside_have_no_edges_and_outlines_few(spark, zones):
    long = [("coast", [star(random.Random(1), 0, 0, 10, 2_000)])]
    rows = P.cells(P.polygons(spark, long)).selectExpr("level", "size(edges) as n", "odd").collect()
    assert any(r.n == 0 and r.odd for r in rows) and max(r.n for r in rows) < 200


def test_no_polygons(spark):
    pts = spark.createDataFrame([(1, 1.0, 1.0)], "id long, lat double, lon double")
    assert P.resolve_polygon(pts, spark.createDataFrame([], P.POLYGONS), "UTC").first().timezone == "UTC"
