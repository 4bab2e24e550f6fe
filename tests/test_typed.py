"""Typed message table: pruning, replays, rows that do not fit."""

import datetime
import glob
import json
import re

import pyarrow.parquet as pq
from pyspark.sql import functions as F

from tests.test_stores import CFG
from tripweave.plans import process as P
from tripweave.schema import RAW
from tripweave.sources import points as store, raw, typed

DAY = 86_400
T0 = 1_711_411_200  # 2024-03-26 00:00 UTC


def messages(spark, rows):
    """(id, user, tst, lat) as messages; a text instead of a latitude is the whole payload."""
    at = datetime.datetime(2024, 3, 30, 12)
    out = []
    for i, user, tst, lat in rows:
        payload = lat if isinstance(lat, str) else json.dumps({"_type": "location", "tst": tst, "lat": lat, "lon": -74.0, "acc": 5})
        out.append((i, at, "location", user, "d", payload))
    return spark.createDataFrame(out, RAW)


def week(spark):
    return messages(spark, [(d * 100 + k, "ab"[k % 2], T0 + d * DAY + 600 * k, 40.75 + k * 0.001) for d in range(7) for k in range(50)])


def test_same_points_as_from_the_message_table(spark, tmp_path):
    rows = week(spark)
    typed.write_typed(rows, str(tmp_path / "t"))
    table = typed.typed_table(spark, str(tmp_path / "t"))
    filters = P.Filters(since="2024-03-27", until="2024-03-28", user="a")
    columns = ["record_id", "user", "tst", "lat", "lon", "acc"]
    want = P.selected_points(rows, filters, CFG).select(*columns).collect()
    assert 0 < len(want) < 100
    assert sorted(P.selected_points(table, filters, CFG).select(*columns).collect()) == sorted(want)
    assert set(P.selected_points(table, filters, CFG).columns) >= set(columns)


def test_one_day_reads_its_partitions_and_parses_nothing(spark, tmp_path):
    typed.write_typed(week(spark), str(tmp_path / "t"))
    table = typed.typed_table(spark, str(tmp_path / "t"))
    done = P.process(P.selected_points(table, P.Filters(since="2024-03-27", until="2024-03-27"), CFG), cfg=CFG)
    spark.conf.set("spark.sql.maxMetadataStringLength", "4000")
    text = done._jdf.queryExecution().executedPlan().toString()
    spark.conf.unset("spark.sql.maxMetadataStringLength")
    assert "from_json" not in text and "get_json_object" not in text
    scans = re.findall(r"FileScan parquet .*", text)
    assert scans
    for scan in scans:
        assert re.search(r"PartitionFilters: \[.*gps_date#\d+ >= 2024-03-27.*gps_date#\d+ <= 2024-03-28", scan), scan
        assert re.search(r"GreaterThanOrEqual\(tst,\d+\), LessThanOrEqual\(tst,\d+\)", scan), scan
        assert "payload" not in scan.split("ReadSchema")[1]


def test_files_follow_each_other_in_time(spark, tmp_path):
    """Row-group bounds of a date do not overlap, so a range of times skips the others."""
    rows = messages(spark, [(i, "a", T0 + (i * 7919) % DAY, 40.0) for i in range(4000)]).repartition(5)
    typed.write_typed(rows, str(tmp_path / "t"))
    bounds = []
    for file in glob.glob(str(tmp_path / "t/gps_date=2024-03-26/batch=0/*.parquet")):
        meta = pq.ParquetFile(file).metadata
        at = [i for i in range(meta.num_columns) if meta.row_group(0).column(i).path_in_schema == "tst"][0]
        bounds += [(meta.row_group(g).column(at).statistics.min, meta.row_group(g).column(at).statistics.max) for g in range(meta.num_row_groups)]
    bounds.sort()
    assert all(a[1] <= b[0] for a, b in zip(bounds, bounds[1:], strict=False))


def test_batch_that_is_replayed_replaces_itself(spark, tmp_path):
    path = str(tmp_path / "t")
    typed.write_typed(messages(spark, [(1, "a", T0, 40.0), (2, "a", T0 + DAY, 40.0)]), path, 1)
    late = messages(spark, [(3, "a", T0 + 5, 40.0)])
    typed.write_typed(late, path, 2)
    typed.write_typed(late, path, 2)
    assert sorted(r.record_id for r in typed.typed_table(spark, path).collect()) == [1, 2, 3]


def test_unreadable_payloads_and_no_table(spark, tmp_path):
    path = str(tmp_path / "t")
    typed.write_typed(messages(spark, [(1, "a", 0, "not json"), (2, None, 0, '{"tst": 99999999999999, "lat": 1, "lon": 2}'), (3, "a", T0, 40.0)]), path)
    rows = {r.record_id: r for r in typed.typed_table(spark, path).collect()}
    assert rows[1].gps_date is None and rows[1].payload == "not json" and rows[2].gps_date is None and str(rows[3].gps_date) == "2024-03-26"
    assert typed.typed_table(spark, str(tmp_path / "none")).isEmpty()
    typed.write_typed(messages(spark, []), str(tmp_path / "e"))


def test_rebuild_from_the_typed_table(spark, tmp_path):
    rows = week(spark)
    typed.write_typed(rows, str(tmp_path / "t"))
    for name, table in (("raw", rows), ("typed", typed.typed_table(spark, str(tmp_path / "t")))):
        P.rebuild(spark, table, str(tmp_path / name), CFG, P.Filters(since="2024-03-27"))
    columns = ["record_id", "user", "tst", "speed_kmh", "commute_id", "transport_mode", "local_date"]
    got, want = (sorted(map(str, store.points_table(spark, str(tmp_path / n)).select(*columns).collect())) for n in ("typed", "raw"))
    assert got == want and len(got) > 200
