"""Sources, sinks, filters, the batch pipeline and streaming, each run over the whole events table.

Queries about stores write into a fresh folder below the checkpoint directory, then return
what a reader finds there.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.base import (
    CFG, LOCATED_SQL, MESSAGES_SQL, chain, events, enriched, label_log, ledger, messages, pings, plain,
    points, rnd, trip_points, ts, with_labels,
)
from catalog.labels_q import MOVES_SQL, ORPHANS_SQL
from catalog.registry import register
from tripweave.operators import analytics as A
from tripweave.plans import process as P
from tripweave.plans.incremental import refresh
from tripweave.sources import checksums, label_store, points as store, raw, snapshots, typed
from tripweave.sources.storage import scratch_path
from tripweave.streaming import ingest

_E = '"user", device'
_MSG = f"WITH messages AS ({MESSAGES_SQL}) "
NOW = "2024-01-31 12:00:00"


def _now():
    return F.lit(NOW).cast("timestamp")


def _event_id(column: str = "payload"):
    return F.regexp_extract(column, r'"event_id":(\d+)', 1).cast("bigint").alias("event_id")


def _day_files(spark, sf) -> str:
    """Payload lines in day folders; long clicks are cut off in the middle, as after a crash."""
    path = scratch_path(spark, "jsonl")
    rows = messages(spark, sf).join(
        events(spark, sf).select(F.col("event_id").alias("id"), "event_type", "value"), "id"
    )
    cut = (F.col("event_type") == "click") & (F.col("value") > 100)
    line = F.when(cut, F.concat(F.lit('{"event_id":'), F.col("id").cast("string"), F.lit(', "lat')))
    rows.select(
        F.explode(F.array(F.coalesce(line, F.col("payload")), F.lit("  "))).alias("value"),
        F.to_date("received_at").alias("date"),
    ).write.partitionBy("date").text(path)
    return path


_BROKEN = "event_type = 'click' AND value > 100"


@register("read_raw_jsonl_s1", f"SELECT event_id, CAST(CAST(ts AS DATE) AS VARCHAR) AS file_date, NOT ({_BROKEN}) AS is_valid FROM events")
def read_raw_jsonl_s1(spark, sf):
    return raw.read_raw_jsonl(spark, _day_files(spark, sf)).select(_event_id(), "file_date", "is_valid")


def _message_table(spark, sf) -> str:
    path = scratch_path(spark, "messages")
    raw.write_records(messages(spark, sf), path)
    return path


@register("read_raw_records_s2", _MSG + f"SELECT record_id AS id, {_E}, msg_type FROM messages WHERE msg_type = 'location'")
def read_raw_records_s2(spark, sf):
    return raw.read_raw_records(raw.raw_table(spark, _message_table(spark, sf))).select("id", "user", "device", "msg_type")


@register("read_raw_records_of_user_s2", _MSG + f"SELECT record_id AS id, {_E} FROM messages WHERE msg_type = 'location' AND \"user\" = 'u1' AND device = 'd0'")
def read_raw_records_of_user_s2(spark, sf):
    return raw.read_raw_records(messages(spark, sf), user="u1", device="d0").select("id", "user", "device")


@register("parse_payload_s3", _MSG + f"SELECT record_id, {_E}, {rnd('lat', 6)} AS lat, {rnd('lon', 6)} AS lon, tst, CAST(acc AS BIGINT) AS acc, CAST(batt AS BIGINT) AS batt, msg_type AS _type FROM messages")
def parse_payload_s3(spark, sf):
    parsed = raw.parse_payload(messages(spark, sf))
    return plain(parsed.select("record_id", "user", "device", "lat", "lon", "tst", "acc", "batt", "_type"), 6)


@register(
    "append_raw_s4",
    "SELECT event_id, '2024-01-31' AS \"date\", CASE WHEN event_type = 'view' THEN '2024-01-31T12:00:00.000000Z' "
    "ELSE strftime(ts, '%Y-%m-%dT%H:%M:%S.%fZ') END AS received_at FROM events",
)
def append_raw_s4(spark, sf):
    path = scratch_path(spark, "append")
    raw.append_raw(messages(spark, sf), path, _now())
    back = spark.read.text(path)
    return back.select(
        _event_id("value"), F.col("date").cast("string").alias("date"), F.get_json_object("value", "$.received_at").alias("received_at")
    )


_ALL = "SELECT t.*, s.transport_mode, s.segment_id FROM trips t LEFT JOIN segmented s USING (record_id)"
_STORED = f"SELECT record_id, {_E}, CAST(local_date AS VARCHAR) AS local_date, commute_id, transport_mode, segment_id FROM allp"
_STORED_COLS = ("record_id", "user", "device", "local_date", "commute_id", "transport_mode", "segment_id")


def _stored_points(spark, sf) -> str:
    path = scratch_path(spark, "points")
    store.write_points(points(spark, sf), path, buckets=2)
    return path


_WHOLE = chain("segmented", _STORED, source=LOCATED_SQL, allp=_ALL)


@register("write_points_s5", chain("segmented", _STORED, allp=_ALL))
def write_points_s5(spark, sf):
    """Written twice: the second run replaces the days instead of adding to them."""
    path = _stored_points(spark, sf)
    store.write_points(points(spark, sf), path, buckets=2)
    return plain(store.points_table(spark, path).select(*_STORED_COLS))


@register("points_table_s6", chain("trips", "SELECT record_id, commute_id, CASE WHEN device = 'd1' THEN 'second' END AS note FROM trips"))
def points_table_s6(spark, sf):
    """Files of two schemas read as one table, columns united by name."""
    path = scratch_path(spark, "points")
    pts = trip_points(spark, sf)
    store.write_points(pts.filter("device = 'd0'"), f"{path}/part=a")
    store.write_points(pts.filter("device <> 'd0'").withColumn("note", F.lit("second")), f"{path}/part=b")
    return store.points_table(spark, path).select("record_id", "commute_id", "note")


@register("list_dates_s7", chain("trips", "SELECT DISTINCT CAST(local_date AS VARCHAR) AS local_date FROM trips"))
def list_dates_s7(spark, sf):
    return plain(A.list_dates(store.points_table(spark, _stored_points(spark, sf))))


_PENDING = "SELECT event_id AS id, ts FROM events WHERE event_type <> 'signup'"


@register("export_unsynced_s8", f"SELECT id AS event_id, CAST(CAST(ts AS DATE) AS VARCHAR) AS \"date\" FROM ({_PENDING})")
def export_unsynced_s8(spark, sf):
    out = scratch_path(spark, "export")
    raw.write_export(raw.export_batch(messages(spark, sf), ledger(spark, sf)), out)
    return spark.read.text(out).select(_event_id("value"), F.col("date").cast("string").alias("date"))


@register("mark_synced_s9", f"SELECT event_id AS id FROM events WHERE event_type = 'signup' UNION ALL SELECT id FROM ({_PENDING})")
def mark_synced_s9(spark, sf):
    path = scratch_path(spark, "ledger")
    ledger(spark, sf).select("id", "synced_at", "received_at").write.parquet(path)
    raw.export_unsynced(messages(spark, sf), path, scratch_path(spark, "export"))
    return raw.ledger_table(spark, path).select("id")


@register("prune_synced_s10", "SELECT event_id AS id FROM events WHERE NOT (event_type = 'signup' AND ts < TIMESTAMP '2024-01-21')")
def prune_synced_s10(spark, sf):
    path, stamped = _message_table(spark, sf), scratch_path(spark, "ledger")
    ledger(spark, sf).select("id", "synced_at", "received_at").write.parquet(stamped)
    raw.prune_table(spark, path, stamped, 10, _now())
    return raw.raw_table(spark, path).select("id")


@register("raw_counts_s11", "SELECT count(*) AS total_records, count(*) FILTER (event_type <> 'signup') AS unsynced_records FROM events")
def raw_counts_s11(spark, sf):
    return raw.raw_counts(messages(spark, sf), ledger(spark, sf))


@register("raw_page_s12", _MSG + f"SELECT record_id AS id, {_E}, msg_type, strftime(received_at, '%Y-%m-%d %H:%M:%S') AS received_at FROM messages ORDER BY messages.received_at DESC, id DESC LIMIT 100 OFFSET 20")
def raw_page_s12(spark, sf):
    page = raw.raw_page(messages(spark, sf), limit=100, offset=20)
    return plain(page.select("id", "user", "device", "msg_type", "received_at"))


_PAGE = _MSG + f"SELECT record_id AS id, {_E}, msg_type, strftime(received_at, '%Y-%m-%d %H:%M:%S') AS received_at FROM messages ORDER BY messages.received_at DESC, id DESC LIMIT 100 OFFSET "


@register("raw_next_page_s12", _PAGE + "100")
def raw_next_page_s12(spark, sf):
    """The second page, from the last row of the first."""
    rows = messages(spark, sf)
    last = raw.raw_page(rows, limit=100).orderBy("received_at", "id").select("received_at", "id").first()
    page = raw.raw_page(rows, limit=100, after=tuple(last))
    return plain(page.select("id", "user", "device", "msg_type", "received_at"))


@register("raw_far_page_s12", _PAGE + "(SELECT count(*) // 3 FROM messages)")
def raw_far_page_s12(spark, sf):
    """The page a third of the way into the table."""
    rows = messages(spark, sf)
    page = raw.raw_far_page(rows, 100, rows.count() // 3)
    return plain(page.select("id", "user", "device", "msg_type", "received_at"))


@register("raw_count_s13", _MSG + "SELECT count(*) AS count FROM messages WHERE received_at >= TIMESTAMP '2024-01-05' AND received_at <= TIMESTAMP '2024-01-20 23:59:59' AND \"user\" = 'u2'")
def raw_count_s13(spark, sf):
    return raw.raw_count(messages(spark, sf), since="2024-01-05", until="2024-01-20", user="u2")


def _daily_lines(spark, sf) -> str:
    path = scratch_path(spark, "daily")
    daily = events(spark, sf).groupBy(F.to_date("ts").alias("date")).agg(
        F.concat_ws("|", F.count("*").cast("string"), F.sum("event_id").cast("string")).alias("value")
    )
    daily.select("value", "date").write.partitionBy("date").text(path)
    return path


_DAY = r"date=(\d{4}-\d{2}-\d{2})"


@register("checksums_s14", "SELECT CAST(d AS VARCHAR) AS day, sha256(CAST(n AS VARCHAR) || '|' || CAST(s AS VARCHAR) || chr(10)) AS digest FROM (SELECT CAST(ts AS DATE) AS d, count(*) AS n, sum(event_id) AS s FROM events GROUP BY 1)")
def checksums_s14(spark, sf):
    digests = checksums.file_digests(spark, _daily_lines(spark, sf))
    return digests.select(F.regexp_extract("file", _DAY, 1).alias("day"), "digest")


@register(
    "tree_digests_s14",
    "SELECT CAST(d AS VARCHAR) AS day, CAST(strlen(t) AS BIGINT) AS length, "
    "sha256(array_to_string(list_transform(range(0, strlen(t), 4), lambda i: sha256(substr(t, i + 1, 4))), '')) AS root "
    "FROM (SELECT d, CAST(n AS VARCHAR) || '|' || CAST(s AS VARCHAR) || chr(10) AS t FROM "
    "(SELECT CAST(ts AS DATE) AS d, count(*) AS n, sum(event_id) AS s FROM events GROUP BY 1))",
)
def tree_digests_s14(spark, sf):
    """Ranges of four bytes, so that every file has several."""
    digests = checksums.tree_digests(spark, _daily_lines(spark, sf), 4)
    return digests.select(F.regexp_extract("file", _DAY, 1).alias("day"), "length", "root")


@register(
    "verify_checksums_s15",
    "SELECT CASE WHEN d < DATE '2024-01-10' THEN 'FAIL' WHEN d > DATE '2024-01-25' THEN 'MISSING' ELSE 'OK' END AS status, count(*) AS files "
    "FROM (SELECT DISTINCT CAST(ts AS DATE) AS d FROM events) GROUP BY 1",
)
def verify_checksums_s15(spark, sf):
    """Checksums recorded, then early ones falsified and late ones lost."""
    path, written, altered = _daily_lines(spark, sf), scratch_path(spark, "sums"), scratch_path(spark, "sums")
    checksums.write_checksums(spark, path, written)
    day = F.regexp_extract("value", _DAY, 1)
    lines = spark.read.text(written).filter(day <= "2024-01-25")
    lines.select(
        F.when(day < "2024-01-10", F.concat(F.lit("0" * 64), F.expr("substring(value, 65)"))).otherwise(F.col("value")).alias("value")
    ).write.text(altered)
    return checksums.checksum_totals(checksums.verify_checksums(spark, path, altered))


@register("points_version_s6", _WHOLE)
def points_version_s6(spark, sf):
    """The state before a rebuild of one user without messages, read after it; that rebuild took a user's rows away."""
    out = scratch_path(spark, "points")
    table = raw.raw_table(spark, _message_table(spark, sf))
    P.rebuild(spark, table, out, CFG, buckets=2)
    span = {"since": "2023-12-01", "until": "2024-03-01"}
    P.rebuild(spark, table.filter("user <> 'u3'"), out, CFG, P.Filters(user="u3", **span), clean=True)
    first = snapshots.versions(spark, out)[0]
    assert store.points_table(spark, out).filter("user = 'u3'").isEmpty()
    return plain(store.points_table(spark, out, version=first).select(*_STORED_COLS))


@register("clean_range_s16", chain("trips", "SELECT CAST(local_date AS VARCHAR) AS local_date, count(*) AS n FROM trips WHERE local_date NOT BETWEEN DATE '2024-01-05' AND DATE '2024-01-12' GROUP BY 1"))
def clean_range_s16(spark, sf):
    path = scratch_path(spark, "points")
    store.write_points(trip_points(spark, sf), path)
    store.clean_range(spark, path, "2024-01-05", "2024-01-12")
    return plain(store.points_table(spark, path).groupBy("local_date").agg(F.count("*").alias("n")))


@register(
    "file_summary_s17",
    chain(
        "enriched",
        f"SELECT count(*) AS total_points, {ts('min(\"timestamp\")')} AS time_start, {ts('max(\"timestamp\")')} AS time_end, "
        f"{rnd('(max(tst) - min(tst)) / 60.0', 1)} AS duration_min, {rnd('sum(distance_m)', 0)} AS total_distance_m, "
        f"{rnd('max(speed_kmh)', 1)} AS max_speed_kmh, {rnd('avg(speed_kmh)', 1)} AS avg_speed_kmh, CAST(max(batt) AS BIGINT) AS battery_start, "
        f"CAST(min(batt) AS BIGINT) AS battery_end, {rnd('avg(acc)', 0)} AS avg_accuracy_m FROM enriched",
        source=f"SELECT record_id, \"user\", device, tst, lat, lon, acc, batt FROM ({MESSAGES_SQL}) WHERE lat IS NOT NULL",
    ),
)
def file_summary_s17(spark, sf):
    from tripweave.operators.sequence import enrich

    return plain(A.file_summary(enrich(P.drop_malformed(raw.parse_payload(messages(spark, sf))), CFG)))


_HEAD = f"record_id, {ts('\"timestamp\"')} AS \"timestamp\", {rnd('lat', 6)} AS lat, {rnd('lon', 6)} AS lon, {rnd('speed_kmh', 6)} AS speed_kmh, {rnd('distance_m', 6)} AS distance_m"


@register(
    "first_and_last_s17",
    chain(
        "enriched",
        f"(SELECT 'first' AS part, {_HEAD} FROM enriched ORDER BY tst, record_id LIMIT 5) UNION ALL "
        f"(SELECT 'last' AS part, {_HEAD} FROM enriched ORDER BY tst DESC, record_id DESC LIMIT 5)",
    ),
)
def first_and_last_s17(spark, sf):
    return plain(A.first_and_last(enriched(spark, sf)), 6)


# ------------------------------------------------------------- filters


@register("keep_locations_f1", _MSG + "SELECT record_id FROM messages WHERE msg_type = 'location'")
def keep_locations_f1(spark, sf):
    return P.keep_locations(raw.parse_payload(messages(spark, sf))).select("record_id")


@register("drop_malformed_f2", _MSG + "SELECT record_id FROM messages WHERE lat IS NOT NULL")
def drop_malformed_f2(spark, sf):
    return P.drop_malformed(raw.parse_payload(messages(spark, sf))).select("record_id")


_RANGE = (
    "tst BETWEEN epoch(TIMESTAMP '2024-01-05 00:00:00' AT TIME ZONE 'America/New_York') "
    "AND epoch(TIMESTAMP '2024-01-20 23:59:59' AT TIME ZONE 'America/New_York')"
)


@register("local_day_range_f3", chain("pings", f"SELECT record_id, tst FROM pings WHERE {_RANGE}"))
def local_day_range_f3(spark, sf):
    return P.local_day_range(pings(spark, sf), "America/New_York", "2024-01-05", "2024-01-20").select("record_id", "tst")


@register("day_bounds_f3", "SELECT DISTINCT CAST(epoch(CAST(CAST(ts AS DATE) AS TIMESTAMP) AT TIME ZONE 'America/New_York') AS BIGINT) AS first_s FROM events")
def day_bounds_f3(spark, sf):
    days = events(spark, sf).select(F.to_date("ts").alias("d")).distinct()
    return days.select(F.unix_timestamp(F.to_utc_timestamp(F.col("d").cast("timestamp"), "America/New_York")).alias("first_s"))


@register("split_and_recombine_f4", chain("segmented", "SELECT record_id, commute_id, transport_mode, segment_id FROM allp", allp=_ALL))
def split_and_recombine_f4(spark, sf):
    return points(spark, sf).select("record_id", "commute_id", "transport_mode", "segment_id")


@register("bound_parameters_f6", chain("trips", f"SELECT record_id FROM trips WHERE commute_direction = 'morning' AND {rnd('speed_kmh', 6)} >= 25"))
def bound_parameters_f6(spark, sf):
    from tripweave.plans.sql import query

    trip_points(spark, sf).createOrReplaceTempView("commute_data")
    sql = "SELECT record_id FROM commute_data WHERE commute_direction = :direction AND round(speed_kmh, 6) >= :speed"
    return query(spark, sql, {"direction": "morning", "speed": 25.0})


# ------------------------------------------------------------- pipeline


@register("process_p1", chain("segmented", "SELECT record_id, commute_id, transport_mode, segment_id FROM allp", source=LOCATED_SQL, allp=_ALL))
def process_p1(spark, sf):
    pts = P.process(raw.parse_payload(messages(spark, sf)), cfg=CFG)
    return pts.select("record_id", "commute_id", "transport_mode", "segment_id")


_LABELLED = (
    "SELECT p.record_id, p.transport_mode AS predicted_mode, coalesce(l.corrected_mode, p.transport_mode) AS transport_mode FROM allp p "
    "LEFT JOIN live l ON p.\"user\" = l.\"user\" AND p.device = l.device AND p.commute_id = l.commute_id AND p.segment_id = l.segment_id"
)


@register("process_with_labels_p1", with_labels(_LABELLED, allp=_ALL))
def process_with_labels_p1(spark, sf):
    log = label_log(A.segments(points(spark, sf)))
    return P.process(pings(spark, sf), labels=log, cfg=CFG).select("record_id", "predicted_mode", "transport_mode")


_RANGE_LOCATED = f"SELECT * FROM ({LOCATED_SQL}) WHERE {_RANGE}"


@register("rebuild_p2", chain("segmented", _STORED, source=_RANGE_LOCATED, allp=_ALL))
def rebuild_p2(spark, sf):
    out = scratch_path(spark, "points")
    table = raw.raw_table(spark, _message_table(spark, sf))
    P.rebuild(spark, table, out, CFG, P.Filters(since="2024-01-05", until="2024-01-20"), clean=True)
    return plain(store.points_table(spark, out).select(*_STORED_COLS))


@register(
    "rebuild_migrates_labels_p2",
    with_labels(
        f"SELECT l.\"user\", l.device, coalesce(m.new_id, l.commute_id) AS commute_id, segment_id, notes FROM log l "
        "LEFT JOIN moves m ON l.\"user\" = m.\"user\" AND l.device = m.device AND l.commute_id = m.old_id",
        source=LOCATED_SQL, orphans=ORPHANS_SQL, moves=MOVES_SQL,
    ),
)
def rebuild_migrates_labels_p2(spark, sf):
    """What a reader of the label store finds after a rebuild: labels of vanished trips under the neighbouring day's trip."""
    out, kept = scratch_path(spark, "points"), scratch_path(spark, "labels")
    table = raw.raw_table(spark, _message_table(spark, sf))
    P.rebuild(spark, table, out, CFG, buckets=2)
    label_store.put_labels(label_log(A.segments(store.points_table(spark, out))), kept)
    P.rebuild(spark, table, out, CFG, P.Filters(user="u3"), label_store=kept)
    return label_store.stored_labels(spark, kept).select("user", "device", "commute_id", "segment_id", "notes")


@register("rebuild_one_user_p2", chain("segmented", _STORED, source=LOCATED_SQL, allp=_ALL))
def rebuild_one_user_p2(spark, sf):
    """A full rebuild, then one narrowed to a user: nobody else's points may change."""
    out = scratch_path(spark, "points")
    table = raw.raw_table(spark, _message_table(spark, sf))
    P.rebuild(spark, table, out, CFG, buckets=2)
    P.rebuild(spark, table, out, CFG, P.Filters(user="u3"), buckets=2)
    return plain(store.points_table(spark, out).select(*_STORED_COLS))


def _typed_table(spark, sf) -> str:
    path = scratch_path(spark, "typed")
    typed.write_typed(messages(spark, sf), path)
    return path


_TYPED_OUT = f"record_id, {_E}, {rnd('lat', 6)} AS lat, tst, CAST(acc AS BIGINT) AS acc, msg_type, CAST(CAST(to_timestamp(tst) AT TIME ZONE 'UTC' AS DATE) AS VARCHAR) AS gps_date"


@register("typed_messages_s3", _MSG + f"SELECT {_TYPED_OUT} FROM messages")
def typed_messages_s3(spark, sf):
    rows = typed.typed_table(spark, _typed_table(spark, sf))
    return plain(rows.select("record_id", "user", "device", "lat", "tst", "acc", "msg_type", "gps_date"), 6)


@register("typed_day_range_f3", _MSG + f"SELECT record_id, tst FROM messages WHERE {_RANGE}")
def typed_day_range_f3(spark, sf):
    table = typed.typed_table(spark, _typed_table(spark, sf))
    return P.local_day_range(table, "America/New_York", "2024-01-05", "2024-01-20").select("record_id", "tst")


@register("process_typed_p1", chain("segmented", "SELECT record_id, commute_id, transport_mode, segment_id FROM allp", source=LOCATED_SQL, allp=_ALL))
def process_typed_p1(spark, sf):
    table = typed.typed_table(spark, _typed_table(spark, sf))
    pts = P.process(P.selected_points(table, P.Filters(), CFG), cfg=CFG)
    return pts.select("record_id", "commute_id", "transport_mode", "segment_id")


@register("rebuild_typed_p2", chain("segmented", _STORED, source=_RANGE_LOCATED, allp=_ALL))
def rebuild_typed_p2(spark, sf):
    """A rebuild of two weeks that reads their partitions only."""
    out = scratch_path(spark, "points")
    table = typed.typed_table(spark, _typed_table(spark, sf))
    P.rebuild(spark, table, out, CFG, P.Filters(since="2024-01-05", until="2024-01-20"), clean=True)
    return plain(store.points_table(spark, out).select(*_STORED_COLS))


@register("typed_ingest_i1", _MSG + f"SELECT {_TYPED_OUT} FROM messages")
def typed_ingest_i1(spark, sf):
    """Two batches by the stream, the later one with earlier and later times alike."""
    inbox, out, check = scratch_path(spark, "messages"), scratch_path(spark, "typed"), scratch_path(spark, "stream")
    rows = messages(spark, sf)
    for n in (0, 1):
        raw.write_records(rows.filter(F.pmod(F.xxhash64("id"), F.lit(2)) == n), inbox)
        typed.start_typed_ingest(spark, inbox, out, check, available_now=True).awaitTermination()
    table = typed.typed_table(spark, out)
    return plain(table.select("record_id", "user", "device", "lat", "tst", "acc", "msg_type", "gps_date"), 6)


@register("rebuild_clean_user_p2", _WHOLE)
def rebuild_clean_user_p2(spark, sf):
    """A clean rebuild narrowed to a user takes away and gives back that user's rows only."""
    out = scratch_path(spark, "points")
    table = raw.raw_table(spark, _message_table(spark, sf))
    P.rebuild(spark, table, out, CFG, buckets=2)
    P.rebuild(spark, table, out, CFG, P.Filters(user="u3", since="2023-12-01", until="2024-03-01"), clean=True)
    return plain(store.points_table(spark, out).select(*_STORED_COLS))


@register("rebuild_rebucket_s5", _WHOLE)
def rebuild_rebucket_s5(spark, sf):
    """Another bucket count rewrites the store: no row is doubled or lost."""
    out = scratch_path(spark, "points")
    table = raw.raw_table(spark, _message_table(spark, sf))
    for buckets in (4, 1):
        P.rebuild(spark, table, out, CFG, buckets=buckets)
    return plain(store.points_table(spark, out).select(*_STORED_COLS))


@register("refresh_rebucket_i2", _WHOLE)
def refresh_rebucket_i2(spark, sf):
    """An incremental rebuild keeps to the bucket count of the store."""
    out = scratch_path(spark, "points")
    table = raw.raw_table(spark, _message_table(spark, sf))
    P.rebuild(spark, table, out, CFG, buckets=4)
    refresh(spark, table, out, CFG)
    return plain(store.points_table(spark, out).select(*_STORED_COLS))


@register(
    "process_jsonl_p3",
    chain(
        "segmented", "SELECT tst, \"user\", device, commute_id, transport_mode, segment_id FROM allp",
        source=f"SELECT record_id, \"user\", device, tst, lat, lon FROM ({MESSAGES_SQL}) m JOIN events e ON e.event_id = m.record_id "
        f"WHERE msg_type = 'location' AND lat IS NOT NULL AND NOT (e.event_type = 'click' AND value > 100) AND CAST(e.ts AS DATE) >= DATE '2024-01-03'",
        allp=_ALL,
    ),
)
def process_jsonl_p3(spark, sf):
    pts = P.process_jsonl(spark, _day_files(spark, sf), CFG, since="2024-01-03")
    return pts.select("tst", "user", "device", "commute_id", "transport_mode", "segment_id")


# ------------------------------------------------------------- streaming


def _ingested(spark, sf) -> str:
    out, lines = scratch_path(spark, "ingest"), _day_files(spark, sf)
    ingest.start_ingest(spark, lines, out, scratch_path(spark, "stream"), available_now=True).awaitTermination()
    return out


@register(
    "ingest_i1",
    f"SELECT event_id, NOT ({_BROKEN}) AS readable, CASE WHEN {_BROKEN} THEN 'unknown' WHEN event_type = 'error' THEN 'transition' ELSE 'location' END AS msg_type FROM events",
)
def ingest_i1(spark, sf):
    out = _ingested(spark, sf)
    good = ingest.ingested(spark, out).select("payload", F.lit(True).alias("readable"), "msg_type")
    bad = ingest.ingested(spark, out, "quarantine").select("payload", F.lit(False).alias("readable"), "msg_type")
    return good.unionByName(bad).select(_event_id(), "readable", "msg_type")


@register("export_oldest_batch_s8", f"SELECT id AS event_id, CAST(CAST(ts AS DATE) AS VARCHAR) AS \"date\" FROM ({_PENDING}) ORDER BY ts, id LIMIT 500")
def export_oldest_batch_s8(spark, sf):
    """A bounded batch, asked for explicitly: the oldest pending messages."""
    out = scratch_path(spark, "export")
    raw.write_export(raw.export_batch(messages(spark, sf), ledger(spark, sf), limit=500), out)
    return spark.read.text(out).select(_event_id("value"), F.col("date").cast("string").alias("date"))


@register("incremental_rebuild_i2", chain("segmented", _STORED, source=LOCATED_SQL, allp=_ALL))
def incremental_rebuild_i2(spark, sf):
    """Messages arrive in three batches, the later ones late and out of order."""
    table, out, check = scratch_path(spark, "messages"), scratch_path(spark, "points"), scratch_path(spark, "stream")
    rows = messages(spark, sf)
    batch = F.pmod(F.xxhash64("id"), F.lit(3))
    for part in (rows.filter(batch == n) for n in (0, 1, 2)):
        raw.write_records(part, table)
        ingest.start_incremental_rebuild(spark, table, out, check, CFG, available_now=True).awaitTermination()
    return plain(store.points_table(spark, out).select(*_STORED_COLS))


# ------------------------------------------------------------- set operations and limits


@register("union_by_name_o1", "SELECT event_id, value, NULL AS note FROM events WHERE event_type = 'view' UNION ALL SELECT event_id, NULL, event_type FROM events WHERE event_type <> 'view'")
def union_by_name_o1(spark, sf):
    ev = events(spark, sf)
    views = ev.filter("event_type = 'view'").select("event_id", "value")
    rest = ev.filter("event_type <> 'view'").select("event_id", F.col("event_type").alias("note"))
    return views.unionByName(rest, allowMissingColumns=True)


_CIDS = "SELECT DISTINCT \"user\", device, commute_id FROM trips WHERE commute_direction = "


@register("set_difference_o2", chain("trips", f"SELECT substr(commute_id, 1, 10) AS day, \"user\", device FROM ({_CIDS}'morning') EXCEPT SELECT substr(commute_id, 1, 10), \"user\", device FROM ({_CIDS}'evening')"))
def set_difference_o2(spark, sf):
    days = A.on_trips(trip_points(spark, sf)).select(F.substring("commute_id", 1, 10).alias("day"), "user", "device", "commute_direction")
    morning = days.filter("commute_direction = 'morning'").drop("commute_direction").distinct()
    return morning.join(days.filter("commute_direction = 'evening'"), ["day", "user", "device"], "left_anti")


@register("set_intersection_o2", chain("trips", f"SELECT substr(commute_id, 1, 10) AS day, \"user\", device FROM ({_CIDS}'morning') INTERSECT SELECT substr(commute_id, 1, 10), \"user\", device FROM ({_CIDS}'evening')"))
def set_intersection_o2(spark, sf):
    days = A.on_trips(trip_points(spark, sf)).select(F.substring("commute_id", 1, 10).alias("day"), "user", "device", "commute_direction")
    morning = days.filter("commute_direction = 'morning'").drop("commute_direction").distinct()
    return morning.join(days.filter("commute_direction = 'evening'"), ["day", "user", "device"], "left_semi")


@register("distinct_o3", chain("trips", f"SELECT DISTINCT {_E}, commute_id FROM trips WHERE commute_id IS NOT NULL"))
def distinct_o3(spark, sf):
    return A.on_trips(trip_points(spark, sf)).select("user", "device", "commute_id").distinct()


@register("order_offset_limit_o4", f"SELECT event_id, {rnd('value', 3)} AS value FROM events ORDER BY events.value DESC, event_id LIMIT 25 OFFSET 10")
def order_offset_limit_o4(spark, sf):
    return plain(events(spark, sf).select("event_id", "value").orderBy(F.desc("value"), "event_id").offset(10).limit(25))


