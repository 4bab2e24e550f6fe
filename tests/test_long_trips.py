"""Trips cut in time shards against whole trips."""

import random
import re

import pytest
from pyspark.sql import functions as F

from catalog import base as B
from tripweave.config import TripConfig
from tripweave.operators import long_trips as L
from tripweave.operators.classify import build_ensemble
from tripweave.operators.segment import segment

COLUMNS = ["record_id", "transport_mode", "segment_id"]


def trip(pick, user, points, gap):
    """Points of one trip with runs of like speeds; ``gap`` draws the seconds between points."""
    rows, t, speed, lat = [], 1_700_000_000, 0.0, 40.80
    for i in range(points):
        if pick.random() < 0.12:
            speed = pick.choice([0.0, 0.0, 4.0, 20.0, 21.0, 45.0, 46.0])
        dt = 0 if i == 0 else gap()
        t += dt
        lat = 40.8002 + pick.choice([0, 0, 0, 0.0003, 0.0005])
        rows.append((user, "d", i + 100_000 * user, t, lat, -73.98, speed * pick.choice([1, 1, 1.3]), float(dt), "2024-01-10-morning" if user else None))
    return [(f"u{u}", *rest) for u, *rest in rows]


SCHEMA = "user string, device string, record_id long, tst long, lat double, lon double, speed_kmh double, time_delta_s double, commute_id string"


@pytest.fixture(scope="module")
def many(spark):
    pick = random.Random(5)
    rows = []
    for user in range(1, 25):
        gaps = [lambda: pick.randint(1, 20), lambda: pick.choice([1, 5, 400]), lambda: pick.choice([0, 0, 3])][user % 3]
        rows += trip(pick, user, pick.choice([1, 2, 3, 5, 6, 7, 40, 150]), gaps)
    rows += trip(pick, 0, 5, lambda: 10)
    return spark.createDataFrame(rows, SCHEMA).repartition(3).cache()


@pytest.mark.parametrize("seconds,keep,zones", [(7, False, False), (60, True, True), (5, True, True), (900, False, True)])
def test_equal_to_whole_trips(spark, many, seconds, keep, zones):
    """Shards down to a second or less hold one row or none; halos then come from many shards."""
    cfg = TripConfig(keep_forced_boundaries=keep)
    ensemble = build_ensemble(B.ZONES if zones else B.Zones(), cfg)
    want = segment(many, ensemble, cfg).select(*COLUMNS).collect()
    got = L.segment_in_shards(many, ensemble, cfg, shard_seconds=seconds)
    assert set(got.columns) == set(segment(many, ensemble, cfg).columns)
    assert sorted(map(str, got.select(*COLUMNS).collect())) == sorted(map(str, want))


def test_only_long_trips_are_cut(spark, many):
    got = L.segment_staged(many, cfg=TripConfig(), longest_seconds=1000)
    assert sorted(map(str, got.select(*COLUMNS).collect())) == sorted(map(str, segment(many).select(*COLUMNS).collect()))


def test_no_trip_at_all(spark, many):
    none = many.withColumn("commute_id", F.lit(None).cast("string"))
    assert L.segment_in_shards(none).filter("segment_id is not null").isEmpty()
    assert L.segment_in_shards(many.limit(0)).isEmpty()


def test_no_window_over_points_is_keyed_by_the_trip_alone(spark, many, tmp_path):
    """Only frames of one row a shard are windowed by trip; they have no point columns."""
    many.write.parquet(str(tmp_path / "p"))
    pts = L.time_shards(spark.read.parquet(str(tmp_path / "p")).filter("commute_id is not null"), 60)
    track = ["user", "device", "commute_id"]
    rows = L._smoothed(pts, track, build_ensemble(), TripConfig())
    whole = L._numbered(L._final_modes(rows, L.run_carries(rows, track, TripConfig()), track, TripConfig()), track, False)
    text = whole._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in text and "Cartesian" not in text
    sorts = re.findall(r"Sort \[(.*?)\], false", text)
    assert any("tst" in s for s in sorts)
    for s in sorts:
        if "tst#" in s or "record_id#" in s:
            assert "_lane" in s, s
