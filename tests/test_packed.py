"""Columns that no step reads travel as one through the windows of a rebuild."""

from pyspark.sql import functions as F

from tripweave import TripConfig
from tripweave.plans.process import packed, process, process_staged

CFG = TripConfig(home_lat=40.75, home_lon=-74.0, work_lat=40.85, work_lon=-73.95)


def _points(spark):
    rows = []
    for i in range(40):
        lat, lon = (40.75, -74.0) if i % 20 == 0 else (40.85, -73.95) if i % 20 == 19 else (40.8 + i * 1e-4, -73.98)
        rows.append((i, "u", "d", 1704445200 + 60 * i, lat, lon, i if i % 3 else None, 100 - i, "x" * (i % 4), -1.0))
    return spark.createDataFrame(rows, "record_id long, user string, device string, tst long, lat double, lon double, acc long, batt long, note string, speed_kmh double")


def test_unread_columns_are_one_column_and_come_back(spark):
    pts = _points(spark)
    narrow, unpacked = packed(pts)
    assert set(narrow.columns) == {"record_id", "user", "device", "tst", "lat", "lon", "_carried"}
    assert sorted(unpacked(narrow).select(*pts.columns).collect(), key=lambda r: r.record_id) == pts.orderBy("record_id").collect()


def test_staged_pipeline_equals_the_plain_one(spark):
    pts = _points(spark)
    plain = process(pts, cfg=CFG)
    staged, trips = process_staged(pts, cfg=CFG)
    assert "_carried" in trips.columns and not {"acc", "batt", "note"} & set(trips.columns)
    assert sorted(staged.columns) == sorted(plain.columns)
    assert staged.select(*plain.columns).orderBy("record_id").collect() == plain.orderBy("record_id").collect()
    assert plain.filter(F.col("commute_id").isNotNull()).count() > 0
