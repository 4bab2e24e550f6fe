"""Versions of the point store: failed writes, earlier states, vacuum."""

import datetime
import os

import pytest

from tripweave.sources import points as store, snapshots


def rows(spark, *days, user="a"):
    data = [(user, "d", i, datetime.date(2024, 3, d), f"x{d}") for i, d in enumerate(days)]
    return spark.createDataFrame(data, "user string, device string, record_id long, local_date date, note string")


def days(frame):
    return sorted((r.user, r.local_date.day, r.note) for r in frame.collect())


def test_failure_between_files_and_manifest_changes_nothing(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "s")
    store.write_points(rows(spark, 1, 2), path, buckets=2)
    before = days(store.points_table(spark, path))

    def fail(*_):
        raise OSError("executor lost")

    monkeypatch.setattr(snapshots, "rename", fail)
    with pytest.raises(OSError):
        store.write_points(rows(spark, 2, 3).withColumnRenamed("note", "other"), path)
    with pytest.raises(OSError):
        store.clean_range(spark, path)
    monkeypatch.undo()
    assert days(store.points_table(spark, path)) == before and store.stored_dates(spark, path) == ["2024-03-01", "2024-03-02"]
    # the next write succeeds, and the leftovers of the failed one are no part of it
    store.write_points(rows(spark, 3), path)
    assert [d for _, d, _ in days(store.points_table(spark, path))] == [1, 2, 3]
    assert "other" not in store.points_table(spark, path).columns


def test_earlier_versions_and_open_readers(spark, tmp_path):
    path = str(tmp_path / "s")
    store.write_points(rows(spark, 1, 2, 3), path)
    reader = store.points_table(spark, path)
    store.write_points(rows(spark, 2, user="b"), path)
    store.clean_range(spark, path, until="2024-03-01")
    assert days(reader) == days(store.points_table(spark, path, version=1)) == [("a", 1, "x1"), ("a", 2, "x2"), ("a", 3, "x3")]
    assert days(store.points_table(spark, path, version=2)) == [("a", 1, "x1"), ("a", 3, "x3"), ("b", 2, "x2")]
    assert days(store.points_table(spark, path)) == [("a", 3, "x3"), ("b", 2, "x2")]
    assert snapshots.versions(spark, path) == [1, 2, 3]
    with pytest.raises(ValueError, match="no version 9"):
        store.points_table(spark, path, version=9)


def test_vacuum_keeps_what_kept_versions_need(spark, tmp_path):
    path = str(tmp_path / "s")
    store.write_points(rows(spark, 1, 2), path)
    os.makedirs(f"{path}/v=1-failed/local_date=2024-03-09")
    for d in (2, 3, 4):
        store.write_points(rows(spark, d, user="b"), path)
    snapshots.vacuum(spark, path, keep=1)
    assert snapshots.versions(spark, path) == [4]
    assert days(store.points_table(spark, path)) == [("a", 1, "x1"), ("b", 2, "x2"), ("b", 3, "x3"), ("b", 4, "x4")]
    folders = [f for f in os.listdir(path) if f.startswith("v=")]
    assert "v=1-failed" not in folders and len(folders) == 4
    first = next(f for f in folders if f.startswith("v=1-"))
    assert [f for f in os.listdir(f"{path}/{first}") if "=" in f and os.listdir(f"{path}/{first}/{f}")] == ["local_date=2024-03-01"]


def test_second_writer_is_refused(spark, tmp_path):
    path = str(tmp_path / "s")
    store.write_points(rows(spark, 1), path)
    stale = snapshots.snapshot(spark, path)
    store.write_points(rows(spark, 2), path)
    with pytest.raises(snapshots.VersionTaken):
        snapshots.commit(spark, path, stale, 1, {}, {})
    assert [d for _, d, _ in days(store.points_table(spark, path))] == [1, 2]


def test_store_from_before_manifests_is_read_and_adopted(spark, tmp_path):
    path = str(tmp_path / "s")
    store.with_bucket(rows(spark, 1, 2), 2).write.partitionBy(*store.PARTITIONS).parquet(path)
    assert len(days(store.points_table(spark, path))) == 2 and store.stored_dates(spark, path) == ["2024-03-01", "2024-03-02"]
    store.write_points(rows(spark, 2, 3, user="b"), path)
    assert days(store.points_table(spark, path)) == [("a", 1, "x1"), ("b", 2, "x2"), ("b", 3, "x3")]
    assert not [f for f in os.listdir(path) if f.startswith("local_date=")]


def test_empty_writes(spark, tmp_path):
    path = str(tmp_path / "s")
    store.write_points(rows(spark).limit(0), path)
    assert store.points_table(spark, path).isEmpty() and store.clean_range(spark, path) == []
    store.write_points(rows(spark, 1), path)
    store.write_points(rows(spark).limit(0), path)
    assert len(days(store.points_table(spark, path))) == 1
