"""The label store: label and move deltas, versions, merges, lost writers; pages by cursor and at far offsets."""

import datetime

import pytest
from pyspark.sql import functions as F

from tripweave.operators.labels import latest_labels
from tripweave.sources import label_store as store, raw, snapshots

AT = datetime.datetime(2024, 3, 28, 12)


def labels(spark, *rows):
    return spark.createDataFrame([("u", "d", trip, 0, "walking", mode, "", AT + datetime.timedelta(hours=h)) for trip, mode, h in rows], store.LABELS)


def trips(spark, *ids):
    return spark.createDataFrame([("u", "d", t) for t in ids], "user string, device string, commute_id string")


def live(spark, path, version=None):
    return sorted((r.commute_id, r.corrected_mode) for r in latest_labels(store.stored_labels(spark, path, version)).collect())


def test_moves_rename_earlier_labels_only(spark, tmp_path):
    path = str(tmp_path / "labels")
    assert store.stored_labels(spark, path).count() == 0 and store.migrate_stored(spark, path, trips(spark, "x")) == 0
    store.put_labels(labels(spark, ("2024-03-27-evening", "train", 0), ("odd", "car", 0)), path)
    assert store.migrate_stored(spark, path, trips(spark, "2024-03-26-evening", "2024-03-27-morning")) == 2
    store.put_labels(labels(spark, ("2024-03-27-evening", "bicycle", 1)), path)  # a new trip of the old name
    assert live(spark, path) == [("2024-03-26-evening", "train"), ("2024-03-27-evening", "bicycle"), ("odd", "car")]
    # nothing to move: no new version
    assert store.migrate_stored(spark, path, trips(spark, "2024-03-26-evening", "2024-03-27-evening")) == 3
    # a second rename moves what the first one moved
    store.migrate_stored(spark, path, trips(spark, "2024-03-25-evening", "2024-03-27-evening"))
    want = [("2024-03-25-evening", "train"), ("2024-03-27-evening", "bicycle"), ("odd", "car")]
    assert live(spark, path) == want
    assert live(spark, path, 1) == [("2024-03-27-evening", "train"), ("odd", "car")]
    store.merge_labels(spark, path)
    assert live(spark, path) == want and store.stored_labels(spark, path).count() == 3


def test_merge_and_vacuum(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(store, "MERGE_AT", 2)
    path = str(tmp_path / "labels")
    store.put_labels(labels(spark, ("2024-03-20-morning", "train", 0)), path)
    for day in range(19, 14, -1):
        store.migrate_stored(spark, path, trips(spark, f"2024-03-{day}-morning"))
    assert live(spark, path) == [("2024-03-15-morning", "train")]
    assert len(snapshots.versions(spark, path)) == store.KEEP
    assert sum(kind == "moves" for kind, _ in store._parts(spark, path)[1]) < 2
    with pytest.raises(ValueError):
        store.stored_labels(spark, path, 1)


def test_lost_writer_changes_nothing(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "labels")
    store.put_labels(labels(spark, ("2024-03-20-morning", "train", 0)), path)

    def fail(*_):
        raise OSError("driver lost")

    monkeypatch.setattr(snapshots, "rename", fail)
    with pytest.raises(OSError):
        store.migrate_stored(spark, path, trips(spark, "2024-03-19-morning"))
    monkeypatch.undo()
    assert live(spark, path) == [("2024-03-20-morning", "train")]
    store.migrate_stored(spark, path, trips(spark, "2024-03-19-morning"))
    assert live(spark, path) == [("2024-03-19-morning", "train")]


@pytest.mark.parametrize("order", ["asc", "desc"])
def test_pages_by_cursor_and_far_pages_cover_the_table(spark, order):
    times = [None, None, None, *[AT + datetime.timedelta(minutes=7 * (i // 3)) for i in range(600)], AT + datetime.timedelta(days=40)]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(times)], "id long, received_at timestamp").withColumn("user", F.lit("u")).coalesce(1).cache()
    want = [r.id for r in rows.orderBy(*[(F.asc if order == "asc" else F.desc)(c) for c in ("received_at", "id")]).collect()]
    got, last = [], None
    while page := raw.raw_page(rows, 250, order=order, after=last).collect():
        got += [r.id for r in page]
        last = page[-1].received_at, page[-1].id
    assert got == want
    for offset in (0, 1, 300, 590, 602, 603, 604, 9999):
        assert [r.id for r in raw.raw_far_page(rows, 20, offset, order=order).collect()] == want[offset : offset + 20]
