import math

import pytest
from pyspark.sql import functions as F

from tripweave.config import Corridor, TzRegion, Waypoint, Zones, load_zones
from tripweave.functions import geo, modes, timing
from tripweave.operators import classify as C, zones as Z


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


def test_distances(spark):
    assert value(spark, geo.haversine_m(40.0, -74.0, 40.0, -74.0)) == 0.0
    assert value(spark, geo.haversine_m(0.0, 0.0, 0.0, 180.0)) == pytest.approx(math.pi * 6_371_000)
    assert value(spark, geo.haversine_m(40.7128, -74.006, 42.3601, -71.0589)) == pytest.approx(306_000, rel=0.01)
    assert value(spark, geo.speed_kmh(1000.0, 3600.0)) == pytest.approx(1.0)
    assert value(spark, geo.speed_kmh(100.0, 0.0)) == 0.0


def test_geofence_edge_is_inside(spark):
    radius = value(spark, geo.haversine_m(40.001, -74.0, 40.0, -74.0))
    assert value(spark, geo.in_geofence(40.001, -74.0, 40.0, -74.0, radius))
    assert not value(spark, geo.in_geofence(40.001, -74.0, 40.0, -74.0, radius - 0.01))


def test_bearings(spark):
    assert value(spark, geo.bearing_deg(0.0, 0.0, 1.0, 0.0)) == pytest.approx(0.0)
    assert value(spark, geo.bearing_deg(0.0, 0.0, 0.0, -1.0)) == pytest.approx(270.0)
    assert value(spark, geo.angle_diff(350.0, 10.0)) == pytest.approx(20.0)


def test_corridor_samples_quarter_points():
    line = Corridor("c", "train", ((0.0, 0.0), (4.0, 8.0)))
    assert line.sample_points() == [(0.0, 0.0), (4.0, 8.0), (1.0, 2.0), (2.0, 4.0), (3.0, 6.0)]
    assert Corridor("c", "train", ()).sample_points() == []


def test_empty_corridor_is_infinitely_far(spark):
    assert value(spark, geo.corridor_distance(1.0, 1.0, [])) == float("inf")


@pytest.mark.parametrize(
    "speed, mode", [(0.5, "stationary"), (1.0, "walking"), (6.9, "walking"), (7.0, "driving"), (29.9, "driving"), (30.0, "train")]
)
def test_mode_by_speed(spark, speed, mode):
    assert value(spark, modes.mode_by_speed(F.lit(speed))) == mode


@pytest.mark.parametrize("avg, top, std, mode", [(0.5, 1, 0, "stationary"), (4, 6, 1, "walking"), (15, 40, 8, "driving"), (80, 120, 5, "train"), (40, 70, 30, "driving"), (40, 90, 30, "train")])
def test_suggestions(spark, avg, top, std, mode):
    assert value(spark, modes.suggest_mode(*(F.lit(float(x)) for x in (avg, top, std)))) == mode


@pytest.mark.parametrize(
    "case, want",
    [
        (("walking", 15.0, 25.0, 5.0, None, None), (True, 0.95, "driving")),
        (("stationary", 0.5, 1.0, 0.2, "walking", "train"), (True, 0.8, "waiting")),
        (("stationary", 0.5, 1.0, 0.2, "train", "train"), (False, 0.0, None)),
        (("driving", 90.0, 120.0, 10.0, None, None), (True, 0.56, "train")),
        (("driving", 40.0, 60.0, 10.0, None, None), (False, 0.0, None)),
        (("flying", 400.0, 900.0, 10.0, None, None), (False, 0.0, None)),
    ],
)
def test_mismatch(spark, case, want):
    lits = [F.lit(x).cast("string" if i in (0, 4, 5) else "double") for i, x in enumerate(case)]
    got = value(spark, modes.mode_mismatch(*lits))
    assert (got["mismatch"], got["confidence"], got["suggested_mode"]) == want


def test_mismatch_reason(spark):
    lits = [F.lit("walking"), F.lit(15.0), F.lit(25.0), F.lit(5.0), F.lit(None).cast("string"), F.lit(None).cast("string")]
    assert value(spark, modes.mode_mismatch(*lits))["reason"] == "avg speed 15.0 km/h outside walking range (1-7), max 25.0 km/h"


def test_local_time_and_names(spark):
    at = F.timestamp_seconds(F.lit(1711508400))
    assert str(value(spark, timing.to_local(at, F.lit("America/New_York")))) == "2024-03-26 23:00:00"
    assert value(spark, timing.day_name(F.lit("2024-01-07").cast("timestamp"))) == "Sun"
    assert value(spark, timing.day_name(F.lit(None).cast("timestamp"))) == "?"
    assert value(spark, timing.departure_decimal(F.lit("2024-01-07 08:20:00").cast("timestamp"))) == 8.33
    assert value(spark, timing.day_bounds_utc("2024-03-26", "America/New_York")) == 1711425600
    assert value(spark, timing.day_bounds_utc("2024-03-26", "America/New_York", end=True)) == 1711511999


POINTS = [(i, 40.80 + i * 0.00005, -73.98 + (i % 7) * 0.0001) for i in range(200)] + [(900, 0.0, 179.9999), (901, 10.0, -179.9999)]


def test_grid_lookup_equals_expressions(spark, monkeypatch):
    """The indexed path for large zone sets gives what the unrolled one gives."""
    pts = spark.createDataFrame(POINTS, "record_id long, lat double, lon double")
    waypoints = tuple(Waypoint(f"w{i}", 40.80 + i * 0.001, -73.98, 20.0 + i * 5, ("train", "driving", None)[i % 3]) for i in range(9)) + (
        Waypoint("edge", 0.0, -179.9999, 60.0, "walking"),
    )
    corridors = (
        Corridor("a", "train", ((40.80, -73.98), (40.805, -73.979)), 80.0),
        Corridor("b", "train", ((40.802, -73.98),), 60.0),
        Corridor("c", "driving", ((40.80, -73.9795), (40.801, -73.98), (40.81, -73.98)), 50.0),
        Corridor("odd", "flying", ((40.80, -73.98),), 500.0),
    )

    def scores():
        frame = C.WaypointClassifier(waypoints).score(pts, [], "w")
        frame = C.CorridorClassifier(corridors).score(frame, [], "c")
        frame = C.WaypointClassifier(waypoints).with_zone_set(frame, "z")
        return {r["record_id"]: ([round(x, 9) for x in r["w"] + r["c"]], r["z"]) for r in frame.collect()}

    unrolled = scores()
    monkeypatch.setattr(C, "UNROLL_LIMIT", 0)
    assert scores() == unrolled
    assert any(sum(s) > 0 for s, _ in unrolled.values()) and unrolled[900][1] == "edge"


def test_timezone_smallest_box_wins_on_both_paths(spark):
    regions = (TzRegion("Big/Zone", 40.0, 41.0, -75.0, -73.0), TzRegion("Small/Zone", 40.802, 40.804, -74.0, -73.9))
    pts = spark.createDataFrame(POINTS, "record_id long, lat double, lon double")
    plain = Z.resolve_timezone(pts, regions, "Default/Zone")
    grid = Z.resolve_timezone(pts, Z.tz_boxes(spark, regions), "Default/Zone")
    want = {r["record_id"]: r["timezone"] for r in plain.collect()}
    assert want == {r["record_id"]: r["timezone"] for r in grid.collect()}
    assert set(want.values()) == {"Big/Zone", "Small/Zone", "Default/Zone"}


def test_zone_config(tmp_path, monkeypatch):
    path = tmp_path / "z.json"
    path.write_text('{"waypoints": [{"name": "S", "lat": 1, "lon": 2, "radius_m": 3}], "corridors": [{"name": "C", "mode": "train", "points": [[1, 2]]}]}')
    zones = load_zones(str(path))
    assert zones.waypoints[0].mode_hint is None and zones.corridors[0].buffer_m == 150.0
    monkeypatch.setenv("ZONES_CONFIG", str(path))
    assert load_zones("/nowhere.json") == zones
    monkeypatch.delenv("ZONES_CONFIG")
    monkeypatch.chdir(tmp_path)
    assert load_zones() == Zones()
    assert [m.name for m, _ in C.build_ensemble(zones).entries] == ["speed", "speed_variance", "waypoint", "corridor"]
    assert len(C.build_ensemble().entries) == 2


def test_zones_for_unknown_modes_are_dropped_with_a_warning():
    with pytest.warns(UserWarning, match="flying"):
        C.build_ensemble(Zones(corridors=(Corridor("x", "flying", ((0.0, 0.0),)),)))


def test_many_zones_of_all_sizes_match_brute_force(spark):
    """Hundreds of small stops beside a country-sized one, and boxes of all sizes."""
    import random


    pick = random.Random(6)
    stops = [Waypoint(f"s{i}", 40 + pick.random(), -74 + pick.random(), pick.choice([50.0, 300.0, 2_000.0]), "walking") for i in range(200)]
    stops.append(Waypoint("country", 41.0, -73.0, 400_000.0, "train"))
    boxes = [TzRegion(f"z{i}", a := 40 + pick.random(), a + 0.02, b := -74 + pick.random(), b + 0.02) for i in range(150)]
    boxes += [TzRegion("large", 30.0, 50.0, -80.0, -60.0), TzRegion("world", -90.0, 90.0, -180.0, 180.0)]
    spots = [(i, "u", "d", 40 + pick.random() * 1.2, -74 + pick.random() * 1.2) for i in range(400)] + [(400, "u", "d", 0.0, 179.9)]
    pts = spark.createDataFrame(spots, "record_id long, user string, device string, lat double, lon double")

    def metres(p, w):
        from math import asin, cos, radians, sin, sqrt

        a, b = radians(p[3]), radians(w.lat)
        h = sin((b - a) / 2) ** 2 + cos(a) * cos(b) * sin(radians(w.lon - p[4]) / 2) ** 2
        return 2 * 6_371_000 * asin(sqrt(h))

    want = {(p[0], w.name) for p in spots for w in stops if metres(p, w) <= w.radius_m}
    assert {(r.record_id, r.zone) for r in Z.points_in_waypoints(pts, stops).collect()} == want
    listed = Z.with_zone_candidates(pts, Z.waypoint_circles(spark, stops), "near")
    assert {(r.record_id, z.zone) for r in listed.collect() for z in r.near} == want

    def zone(p):
        inside = [r for r in boxes if r.lat_min <= p[3] <= r.lat_max and r.lon_min <= p[4] <= r.lon_max]
        return min(inside, key=lambda r: (r.area, r.tz)).tz if inside else "none"

    got = {r.record_id: r.timezone for r in Z.resolve_timezone(pts, boxes, "none").collect()}
    assert got == {p[0]: zone(p) for p in spots}
    # the country does not widen the cells of the stops
    cells, levels = Z._cells(Z._circle_boxes(Z.waypoint_circles(spark, stops)))
    assert len(levels) > 1 and cells.groupBy(*Z._CELL).count().agg({"count": "max"}).first()[0] < 25
