import pytest
from pyspark.sql import functions as F

from tests.test_sequence import CFG, track
from tripweave.operators import labels as L, review as R
from tripweave.plans import process as P, sql as Q
from tripweave.plans.incremental import refresh
from tripweave.schema import LABELS
from tripweave.sources import checksums, label_log, points as store, raw

LABEL = "user string, device string, commute_id string, segment_id long, original_mode string, corrected_mode string, notes string, labeled_at timestamp"


def messages(spark, text, ids=0, received="2024-03-27 10:00:00", **kw):
    pts = track(spark, text, **kw)
    payload = F.to_json(F.struct(F.lit("location").alias("_type"), "lat", "lon", "tst"))
    return pts.select(
        (F.col("record_id") + ids).alias("id"), F.lit(received).cast("timestamp").alias("received_at"),
        F.lit("location").alias("msg_type"), "user", "device", payload.alias("payload"),
    )


def rows_of(frame, *cols):
    return sorted(tuple(str(v) for v in r) for r in frame.select(*cols).collect())


def test_jsonl_reading(spark, tmp_path):
    day = tmp_path / "2024" / "03"
    day.mkdir(parents=True)
    (day / "2024-03-26.jsonl").write_text('{"_type":"location","lat":1.5,"lon":2,"tst":3}\n\n  \n{"broken\n[1]\n')
    (day / "2024-03-27.jsonl").write_text('{"foo":1}\n')
    (day / "2024-03-27.jsonl.sha256").write_text("abc  2024-03-27.jsonl\n")
    got = raw.read_raw_jsonl(spark, str(tmp_path))
    assert rows_of(got, "file_date", "is_valid") == [
        ("2024-03-26", "False"), ("2024-03-26", "False"), ("2024-03-26", "True"), ("2024-03-27", "True")
    ]
    assert raw.read_raw_jsonl(spark, str(tmp_path), since="2024-03-27").count() == 1
    assert raw.read_raw_jsonl(spark, str(tmp_path / "absent")).count() == 0
    assert P.points_from_jsonl(spark, str(tmp_path)).count() == 1


def test_receive_time_is_added_once(spark, tmp_path):
    lines = spark.createDataFrame([('{"a":1}',), ('{}',), ('{"received_at":"x"} ',)], "payload string")
    now = F.lit("2024-03-27 01:02:03").cast("timestamp")
    raw.append_raw(lines, str(tmp_path / "raw"), now)
    raw.append_raw(lines.limit(0), str(tmp_path / "raw"), now)
    back = sorted(r["value"] for r in spark.read.text(str(tmp_path / "raw")).collect())
    assert back == [
        '{"a":1,"received_at":"2024-03-27T01:02:03.000000Z"}', '{"received_at":"2024-03-27T01:02:03.000000Z"}', '{"received_at":"x"}'
    ]


def test_export_prune_and_counts(spark, tmp_path):
    table, ledger, out = (str(tmp_path / n) for n in ("raw", "ledger", "out"))
    for i, at in enumerate(("2024-03-01 10:00:00", "2024-03-10 10:00:00", "2024-03-27 10:00:00")):
        raw.write_records(messages(spark, "ho", ids=10 * i, received=at), table)
    frame = raw.raw_table(spark, table)
    assert raw.export_unsynced(frame, ledger, out, limit=3) == 3
    assert raw.export_unsynced(frame, ledger, out, limit=1) == 1
    assert raw.raw_counts(frame, raw.ledger_table(spark, ledger)).first().asDict() == {"total_records": 6, "unsynced_records": 2}
    # appended, not replaced: both batches of 10 March are there
    assert spark.read.text(out).groupBy("date").count().filter("date = '2024-03-10'").first()["count"] == 2
    now = F.lit("2024-03-20 05:00:00").cast("timestamp")
    raw.prune_table(spark, table, ledger, 0, now)
    assert raw.raw_table(spark, table).count() == 6
    raw.prune_table(spark, table, ledger, 15, now)
    assert rows_of(raw.raw_table(spark, table), "id") == [("10",), ("11",), ("20",), ("21",)]
    raw.prune_table(spark, table, ledger, 0 + 1, F.lit("2025-01-01").cast("timestamp"))
    assert rows_of(raw.raw_table(spark, table), "id") == [("20",), ("21",)]  # never exported, never pruned


def test_page_limits(spark):
    with pytest.raises(ValueError):
        raw.raw_page(messages(spark, "h"), limit=501)
    page = raw.raw_page(messages(spark, "hoow"), limit=2, order="asc")
    assert rows_of(page, "id") == [("0",), ("1",)]


def test_checksums(spark, tmp_path):
    folder = tmp_path / "raw"
    folder.mkdir()
    for name in "abc":
        (folder / f"{name}.jsonl").write_text(name)
    checksums.write_checksums(spark, str(folder), str(tmp_path / "sums"))
    (folder / "b.jsonl").write_text("changed")
    (folder / "d.jsonl").write_text("new")
    got = checksums.verify_checksums(spark, str(folder), str(tmp_path / "sums"))
    assert rows_of(got, "file", "status") == [("a.jsonl", "OK"), ("b.jsonl", "FAIL"), ("c.jsonl", "OK"), ("d.jsonl", "MISSING")]
    none = checksums.verify_checksums(spark, str(folder), str(tmp_path / "absent"))
    assert rows_of(checksums.checksum_totals(none), "status", "files") == [("MISSING", "4")]


STORED = ("user", "record_id", "local_date", "commute_id", "transport_mode", "segment_id", "time_delta_s")


def test_rebuild_is_idempotent_and_keeps_other_users(spark, tmp_path):
    table, out = str(tmp_path / "raw"), str(tmp_path / "points")
    raw.write_records(messages(spark, "hhoooow", user="a"), table)
    raw.write_records(messages(spark, "wooooh", user="b", ids=100), table)
    frame = raw.raw_table(spark, table)
    assert P.rebuild(spark, frame, out, CFG, dry_run=True)["total_records"] == 13
    assert store.points_table(spark, out).count() == 0
    first = P.rebuild(spark, frame, out, CFG)
    assert (first["total_records"], first["commutes_found"], first["dates"]) == (13, 2, ["2024-03-26"])
    before = rows_of(store.points_table(spark, out), *STORED)
    P.rebuild(spark, frame, out, CFG)
    assert P.rebuild(spark, frame, out, CFG, P.Filters(user="a"))["total_records"] == 7
    assert rows_of(store.points_table(spark, out), *STORED) == before
    assert store.stored_dates(spark, out) == ["2024-03-26"]
    assert store.clean_range(spark, out, since="2024-03-27") == []
    assert store.clean_range(spark, out, until="2024-03-26") == ["2024-03-26"]
    assert store.stored_dates(spark, out) == []


def test_clean_rebuild_of_one_user_keeps_the_others(spark, tmp_path):
    table, out = str(tmp_path / "raw"), str(tmp_path / "points")
    raw.write_records(messages(spark, "hhoooow", user="a"), table)
    raw.write_records(messages(spark, "wooooh", user="b", ids=100), table)
    frame = raw.raw_table(spark, table)
    P.rebuild(spark, frame, out, CFG, buckets=4)
    before = rows_of(store.points_table(spark, out), *STORED)
    P.rebuild(spark, frame, out, CFG, P.Filters(user="a", since="2024-03-26", until="2024-03-26"), clean=True)
    assert rows_of(store.points_table(spark, out), *STORED) == before
    # nothing left of user a in the messages: a clean rebuild takes a's rows, and only those
    P.rebuild(spark, frame.filter("user = 'b'"), out, CFG, P.Filters(user="a", since="2024-03-26", until="2024-03-26"), clean=True)
    assert rows_of(store.points_table(spark, out), *STORED) == [r for r in before if r[0] == "b"]


def test_other_bucket_counts_neither_double_nor_lose_rows(spark, tmp_path):
    whole, out = messages(spark, "hhoooow", user="a").unionByName(messages(spark, "wooooh", user="b", ids=100)), str(tmp_path / "points")
    P.rebuild(spark, whole, out, CFG, buckets=4)
    before = rows_of(store.points_table(spark, out), *STORED)
    refresh(spark, whole, out, CFG)
    assert store.stored_buckets(spark, out) == 4
    assert rows_of(store.points_table(spark, out), *STORED) == before
    for buckets in (1, 3):
        P.rebuild(spark, whole, out, CFG, buckets=buckets)
        assert rows_of(store.points_table(spark, out), *STORED) == before
    refresh(spark, whole, out, CFG, buckets=2)
    assert rows_of(store.points_table(spark, out), *STORED) == before
    # a bucket of a replaced day that gets no new row is emptied
    store.write_points(store.points_table(spark, out).filter("user = 'a'"), out, buckets=2)
    assert {r["user"] for r in store.points_table(spark, out).collect()} == {"a"}


def test_local_time_does_not_depend_on_the_session_zone(spark):
    from tripweave.functions.timing import day_bounds_utc, to_local

    before = spark.conf.get("spark.sql.session.timeZone")
    try:
        for zone in ("UTC", "America/New_York"):
            spark.conf.set("spark.sql.session.timeZone", zone)
            row = spark.sql("SELECT timestamp_seconds(1711508400) AS t, timestamp_seconds(1730613600) AS u").select(
                to_local("t", F.lit("America/New_York")).cast("string"), to_local("u", F.lit("UTC")).cast("string"),
                day_bounds_utc("2024-03-26", "America/New_York"), day_bounds_utc("2024-03-26", "America/New_York", end=True),
            ).first()
            assert tuple(row) == ("2024-03-26 23:00:00", "2024-11-03 06:00:00", 1711425600, 1711511999)
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)


def test_broken_receive_time_and_fractions_of_a_second(spark, tmp_path):
    (tmp_path / "2024-03-26.jsonl").write_text('{"_type":"location","lat":1.5,"lon":2,"tst":3,"received_at":"garbage"}\n')
    assert P.process_jsonl(spark, str(tmp_path), CFG).count() == 1
    at = messages(spark, "h", received="2024-03-26 23:59:59.5")
    assert raw.raw_count(at, until="2024-03-26").first()[0] == 1
    assert raw.raw_count(at, since="2024-03-27").first()[0] == 0


def test_rebuild_from_json_lines(spark, tmp_path):
    lines, out = str(tmp_path / "lines"), str(tmp_path / "points")
    raw.append_raw(messages(spark, "hhoooow"), lines, F.lit("2024-03-26 01:02:03").cast("timestamp"))
    assert P.rebuild_jsonl(spark, lines, out, CFG, dry_run=True)["total_records"] == 7
    got = P.rebuild_jsonl(spark, lines, out, CFG, since="2024-03-26", until="2024-03-26", clean=True)
    assert (got["total_records"], got["commutes_found"]) == (7, 1)
    assert store.points_table(spark, out).count() == 7


def test_date_filter_uses_local_gps_time(spark):
    pts = spark.createDataFrame([(1711468800,), (1711422000,)], "tst long")
    assert rows_of(P.local_day_range(pts, "America/New_York", "2024-03-26", "2024-03-26"), "tst") == [("1711468800",)]


def test_pipeline_filters_and_required_columns(spark):
    pts = track(spark, "hoow").withColumn("_type", F.when(F.col("record_id") == 1, "transition").otherwise("location"))
    pts = pts.withColumn("lat", F.when(F.col("record_id") != 2, F.col("lat")))
    assert rows_of(P.process(pts, cfg=CFG), "record_id") == [("0",), ("3",)]
    with pytest.raises(ValueError):
        P.process(pts.drop("tst"), cfg=CFG)


def label(spark, *rows):
    return spark.createDataFrame(rows, LABEL)


def test_labels_survive_a_rebuild(spark, tmp_path):
    import datetime as dt

    at = dt.datetime(2024, 4, 1)
    log = label(
        spark,
        ("u", "d", "2024-03-26-morning", 0, "train", "driving", "", at),
        ("u", "d", "2024-03-26-morning", 0, "train", "walking", "", at - dt.timedelta(days=1)),
        ("u", "d", "2024-03-27-evening", 3, "train", "driving", "", at),
        ("u", "d", "odd", 0, "train", "driving", "", at),
    )
    out = P.process(track(spark, "hhoooow"), log, cfg=CFG).filter("segment_id = 0")
    assert {(r["transport_mode"]) for r in out.collect()} == {"driving"}
    assert "driving" not in {r["predicted_mode"] for r in out.collect()}
    trips = label(spark, ("u", "d", "2024-03-26-morning", 0, "", "", "", at), ("u", "d", "2024-03-26-evening", 0, "", "", "", at), ("u", "d", "2024-03-28-evening", 0, "", "", "", at))
    assert rows_of(L.migration_map(log, trips), "old_id", "new_id") == [("2024-03-27-evening", "2024-03-26-evening")]
    moved = L.migrate_labels(log, trips)
    assert moved.columns == LABELS.fieldNames() and moved.filter("commute_id = '2024-03-26-evening'").count() == 1
    assert L.label_count(log).first()[0] == 3


def test_apply_suggestions_splits_by_confidence(spark):
    proposed = spark.createDataFrame(
        [("u", "d", "c", 0, "walking", "driving", 0.9, "n"), ("u", "d", "c", 1, "walking", "driving", 0.6, "n")],
        "user string, device string, commute_id string, segment_id long, original_mode string, corrected_mode string, confidence double, notes string",
    )
    log, skipped = R.apply_suggestions(spark.createDataFrame([], LABEL), proposed, F.lit("2024-04-01"))
    assert rows_of(log, "segment_id") == [("0",)]
    assert rows_of(skipped, "segment_id", "skip_reason") == [("1", "confidence 0.6 < 0.7")]


@pytest.mark.parametrize("order", [(2, 0, 1), (1, 2, 0)])
def test_incremental_refresh_equals_rebuild(spark, tmp_path, order):
    """Trips over several days, arriving in any order, replayed once."""
    whole = messages(spark, "hoo" + "o" * 6 + "whoowoh" + "ooh", step=30_000, user="a").unionByName(
        messages(spark, "wooohhoow", step=20_000, user="b", ids=100)
    )
    out, full = str(tmp_path / "points"), str(tmp_path / "full")
    for part in (*order, order[1]):
        refresh(spark, whole.filter(F.col("id") % 3 == part), out, CFG, buckets=2, lookback_days=2)
    P.rebuild(spark, whole, full, CFG, buckets=2)
    assert rows_of(store.points_table(spark, out), *STORED) == rows_of(store.points_table(spark, full), *STORED)


@pytest.mark.parametrize(
    "sql",
    [
        "DROP TABLE x", "SELECT 1; DROP TABLE x", "WITH a AS (SELECT 1) SELECT * FROM a", "select * from parquet.`/etc`",
        "SELECT java_method('java.lang.System', 'exit', 0)", "SELECT TRANSFORM(a) USING 'cat' FROM commute_data",
        "INSERT INTO t SELECT 1", "SELECT * FROM x /* c */ ; DELETE FROM y",
    ],
)
def test_guard_refuses(sql):
    with pytest.raises(ValueError):
        Q.check_query(sql)


@pytest.mark.parametrize(
    "sql", ["SELECT created_at, payload FROM commute_data", "  select 'drop table' AS s", "SELECT a.x FROM a JOIN b USING (x)", "SELECT updated FROM t -- drop"]
)
def test_guard_allows(sql):
    assert Q.check_query(sql) == sql


@pytest.mark.parametrize(
    "sql",
    [
        "SELECT * FROM `parquet`.`{0}`", "SELECT * FROM -- it's\nparquet.`{0}` -- it's", "SELECT * FROM IDENTIFIER('parquet.`{0}`')",
        "SELECT (SELECT count(*) FROM other) AS n FROM commutes", "SELECT * FROM other, (WITH other AS (SELECT 1) SELECT * FROM other)",
        "SELECT 1, 2, 3, 4, 5, 6, 7, 8, 9, 10, 11, 12, 13, 14, 15, 16, 17, 18, 19, 20, 21, 22, 23, 24, 25, 26, `reflect`('java.lang.System', 'nanoTime')",
        "SELECT * FROM read_files('{0}')",
    ],
)
def test_guard_refuses_relations(spark, tmp_path, sql):
    spark.range(1).write.parquet(path := str(tmp_path / "secret"))
    spark.range(1).createOrReplaceTempView("other")
    Q.register_views(P.process(track(spark, "hhoooow"), cfg=CFG))
    with pytest.raises(ValueError):
        Q.query(spark, sql.format(path))
    assert spark.conf.get("spark.sql.runSQLOnFiles") == "true"


def test_guard_keeps_common_tables(spark):
    Q.register_views(P.process(track(spark, "hhoooow"), cfg=CFG))
    got = Q.query(spark, "SELECT n FROM (WITH trips AS (SELECT count(*) AS n FROM commutes) SELECT n FROM trips) WHERE n IN (SELECT id FROM range(5))")
    assert got.first()["n"] == 1


def test_query_with_parameters(spark):
    Q.register_views(P.process(track(spark, "hhoooow"), cfg=CFG))
    got = Q.query(spark, "SELECT count(*) AS n FROM commute_data WHERE commute_direction = :way", {"way": "morning"})
    assert got.first()["n"] == 5
    assert Q.query(spark, "SELECT count(*) AS n FROM commutes").first()["n"] == 1


def test_label_log_on_disk(spark, tmp_path):
    path = str(tmp_path / "labels")
    assert label_log.labels_table(spark, path).count() == 0
    new = spark.createDataFrame(
        [("u", "d", "2024-03-26-morning", 1, "train", "driving")],
        "user string, device string, commute_id string, segment_id int, original_mode string, corrected_mode string",
    )
    label_log.append_labels(new, path, F.lit("2024-04-01"))
    label_log.append_labels(new.withColumn("corrected_mode", F.lit("walking")), path, F.lit("2024-04-02"))
    log = label_log.labels_table(spark, path)
    assert log.count() == 2 and rows_of(L.latest_labels(log), "corrected_mode", "notes") == [("walking", "")]
    label_log.compact_labels(spark, path, str(tmp_path / "compact"))
    assert label_log.labels_table(spark, str(tmp_path / "compact")).count() == 1
