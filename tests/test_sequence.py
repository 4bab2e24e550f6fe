"""Window operators against the naive versions, many random tracks at once."""

import random

import pytest
from hypothesis import HealthCheck, given, settings, strategies as st
from pyspark.sql import functions as F

from tests import naive
from tripweave.config import TripConfig
from tripweave.operators import segment as S
from tripweave.operators.sequence import detect_commutes, enrich, enrich_and_detect

CFG = TripConfig(home_lat=40.75, home_lon=-74.0, home_radius_m=200, work_lat=40.85, work_lon=-73.95, work_radius_m=200)
SPOT = {"h": (40.75, -74.0), "w": (40.85, -73.95), "o": (40.80, -73.98)}
MODES = ("stationary", "walking", "driving", "train")


def track(spark, text, step=10, start=1711440000, user="u", device="d"):
    rows = [(user, device, i, start + i * step, *SPOT[c]) for i, c in enumerate(text)]
    return spark.createDataFrame(rows, "user string, device string, record_id long, tst long, lat double, lon double")


def directions(frame):
    return [r["commute_direction"] for r in frame.orderBy("tst").collect()]


def test_first_point_has_no_motion_and_speeds_follow(spark):
    rows = enrich(track(spark, "how"), CFG).orderBy("tst").collect()
    assert (rows[0]["distance_m"], rows[0]["time_delta_s"], rows[0]["speed_kmh"]) == (0.0, 0.0, 0.0)
    assert rows[0]["is_stationary"] and not rows[1]["is_stationary"]
    assert rows[1]["speed_kmh"] == pytest.approx(rows[1]["distance_m"] / 10 * 3.6)


def test_unordered_input_and_equal_times(spark):
    shuffled = track(spark, "hooow").orderBy(F.rand(1))
    assert [r["record_id"] for r in enrich(shuffled, CFG).orderBy("tst").collect()] == [0, 1, 2, 3, 4]
    same = track(spark, "ho", step=0)
    assert [r["speed_kmh"] for r in enrich(same, CFG).orderBy("record_id").collect()] == [0.0, 0.0]


def test_null_entity_is_kept(spark):
    pts = track(spark, "hoow").withColumn("user", F.lit(None).cast("string"))
    rows = enrich_and_detect(pts, CFG).collect()
    assert len(rows) == 4 and {r["user"] for r in rows} == {"unknown"}


def test_trip_cases(spark):
    def got(text):
        return directions(detect_commutes(enrich(track(spark, text), CFG), CFG))

    assert got("hhooow") == [None, None, *["morning"] * 4]
    assert got("wwoooh") == [None, None, *["evening"] * 4]
    assert got("hhooh") == [None] * 5  # came back
    assert got("hwh") == [None] * 3  # no point on the way
    assert got("ooohoo") == [None] * 6  # unfinished
    both = got("hoowooh")
    assert both == [None, "morning", "morning", "morning", "evening", "evening", "evening"]


def test_late_evening_belongs_to_the_local_date(spark):
    # 03:00 UTC is still the evening before in New York
    rows = enrich_and_detect(track(spark, "woooh", start=1711508400), CFG).orderBy("tst").collect()
    assert str(rows[1]["local_date"]) == "2024-03-26"
    assert rows[1]["commute_id"] == "2024-03-26-evening"


@pytest.mark.parametrize("shard_seconds", [15, 60, 86_400])
def test_random_trips_across_shards(spark, shard_seconds):
    """300 entities at once; shards as short as one or two points, with long gaps."""
    rng = random.Random(shard_seconds)
    rows, expected = [], {}
    for e in range(300):
        text = "".join(rng.choice("hwooo") for _ in range(rng.randint(1, 40)))
        tst = 1711440000
        for i, c in enumerate(text):
            tst += rng.choice((0, 5, 10, 10, 10, 300))
            rows.append((f"e{e}", "d", i, tst, *SPOT[c]))
        want = naive.trips([c == "h" for c in text], [c == "w" for c in text])
        expected.update({(f"e{e}", i): d for i, d in enumerate(want)})
    pts = spark.createDataFrame(rows, "user string, device string, record_id long, tst long, lat double, lon double")
    cfg = CFG.with_(shard_seconds=shard_seconds)
    fused = enrich_and_detect(pts, cfg)
    got = {(r["user"], r["record_id"]): r for r in fused.collect()}
    assert {k: r["commute_direction"] for k, r in got.items()} == expected
    single = detect_commutes(enrich(pts, cfg), cfg).select("user", "record_id", "commute_id", "time_delta_s")
    assert {(r[0], r[1]): (r[2], r[3]) for r in single.collect()} == {
        k: (r["commute_id"], r["time_delta_s"]) for k, r in got.items()
    }


def mode_tracks(spark, tracks):
    rows = [
        (t, i, i, m, bool(cut) and i > 0, float(dt))
        for t, points in enumerate(tracks)
        for i, (m, cut, dt) in enumerate(points)
    ]
    return spark.createDataFrame(rows, "t int, tst long, record_id long, mode string, cut boolean, time_delta_s double")


def by_track(frame, column):
    out = {}
    for r in frame.orderBy("t", "tst").collect():
        out.setdefault(r["t"], []).append(r[column])
    return out


POINT = st.tuples(st.sampled_from(MODES), st.sampled_from((False, False, False, True)), st.sampled_from((0, 10, 15, 40)))


@settings(max_examples=6, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.lists(POINT, min_size=1, max_size=30), min_size=1, max_size=60))
def test_segment_steps_match_the_naive_versions(spark, tracks):
    frame, by = mode_tracks(spark, tracks), ["t"]
    modes = [[m for m, _, _ in p] for p in tracks]
    cuts = [[c and i > 0 for i, (_, c, _) in enumerate(p)] for p in tracks]
    deltas = [[float(d) for _, _, d in p] for p in tracks]
    assert by_track(S.smooth_modes(frame, by), "mode") == {t: naive.smooth(m) for t, m in enumerate(modes)}
    merged = S.merge_short_segments(frame, by, boundary="cut")
    assert by_track(merged, "mode") == {t: naive.merge(*a) for t, a in enumerate(zip(modes, cuts, deltas))}
    waited = S.assign_segment_ids(S.detect_waiting(frame, by), by)
    assert by_track(waited, "mode") == {t: naive.waiting(m) for t, m in enumerate(modes)}
    assert by_track(waited, "segment_id") == {t: naive.ids(naive.waiting(m)) for t, m in enumerate(modes)}


def test_literal_segment_cases(spark):
    w, d, s, t = "walking", "driving", "stationary", "train"

    def steps(modes, deltas=None):
        return mode_tracks(spark, [[(m, False, dt) for m, dt in zip(modes, deltas or [10] * len(modes))]])

    assert by_track(S.smooth_modes(steps([w] * 5 + [d] + [w] * 5), ["t"]), "mode")[0] == [w] * 11
    merged = S.assign_segment_ids(S.merge_short_segments(steps([w, d, w, w], [100, 10, 50, 50]), ["t"]), ["t"])
    assert by_track(merged, "mode")[0] == [w] * 4 and by_track(merged, "segment_id")[0] == [0] * 4

    def waits(modes):
        return by_track(S.detect_waiting(steps(modes), ["t"]), "mode")[0]

    assert waits([d] * 2 + [s] * 2 + [t] * 2)[2:4] == ["waiting"] * 2
    assert waits([d, s, d]) == [d, s, d]
    assert waits([s, t])[0] == "waiting" and waits([w, s])[1] == "waiting"
    assert waits([s, s]) == [s, s]


def test_without_zones_the_ensemble_is_the_speed_rule(spark, sf_dir):
    from catalog.base import trip_points
    from tripweave.functions.modes import mode_by_speed
    from tripweave.operators.classify import build_ensemble

    pts = trip_points(spark, sf_dir).filter("commute_id is not null")
    voted = build_ensemble().classify(pts, ["user", "device", "commute_id"])
    assert voted.filter(F.col("mode") != mode_by_speed("speed_kmh")).isEmpty()
