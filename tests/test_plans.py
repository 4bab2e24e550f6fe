"""The physical plan is part of the contract: few shuffles, one sort each, no Python rows."""

import re

import pytest

from catalog import base as B
from tripweave.operators import analytics as A
from tripweave.operators.sequence import enrich_and_detect
from tripweave.plans.process import process
from tripweave.sources import points as store


def plan(frame) -> str:
    return frame._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def stored(spark, sf_dir, tmp_path_factory):
    """Pings as a table, so that plans show the pipeline alone."""
    path = str(tmp_path_factory.mktemp("pings") / "p")
    B.pings(spark, sf_dir).write.parquet(path)
    return path


@pytest.fixture(autouse=True)
def no_broadcast(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_no_window_is_partitioned_by_the_entity_alone(spark, stored):
    text = plan(process(spark.read.parquet(stored), cfg=B.CFG))
    assert "Python" not in text
    # sorts feeding windows over points always carry the shard or the track
    for sort in re.findall(r"Sort \[(.*?)\], false", text):
        names = [c.split("#")[0].strip() for c in sort.split(",")]
        assert "_shard" in names or "commute_id" in names, names


def test_segmentation_shares_one_sort(spark, stored):
    pts = A.on_trips(process(spark.read.parquet(stored), cfg=B.CFG))
    text = plan(pts)
    assert len(re.findall(r"Exchange hashpartitioning\(user#\d+, device#\d+, commute_id#\d+", text)) == 1
    assert len(re.findall(r"Sort \[user#\d+ ASC NULLS FIRST, device#\d+ ASC NULLS FIRST, commute_id", text)) == 1


def test_trip_detection_shuffles(spark, stored):
    text = plan(enrich_and_detect(spark.read.parquet(stored), B.CFG))
    # rows once; shard edges: their own narrow rows, by entity, and back to the shard key
    assert len(re.findall(r"Exchange hashpartitioning", text)) == 4
    assert "BroadcastNestedLoopJoin" not in text and "CartesianProduct" not in text


def test_scan_is_pruned_and_filtered(spark, sf_dir, tmp_path):
    path = str(tmp_path / "points")
    store.write_points(B.points(spark, sf_dir), path, buckets=2)
    pts = store.points_table(spark, path)
    day = plan(A.daily_points(pts, "2024-01-10").select("record_id"))
    assert re.search(r"PartitionFilters: \[.*local_date", day)
    stats = plan(A.commute_stats(pts))
    assert "IsNotNull(commute_id)" in stats
    schema = re.search(r"ReadSchema: struct<(.*?)>", stats).group(1)
    assert "lat" not in schema and "speed_kmh" not in schema


def test_zone_joins_are_equi_joins(spark, stored):
    from tripweave.operators.zones import points_in_waypoints

    text = plan(points_in_waypoints(spark.read.parquet(stored), B.ZONES.waypoints))
    assert "NestedLoop" not in text and "Cartesian" not in text
