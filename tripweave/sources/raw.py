"""The raw message log: JSON-lines day folders, the message table, export and pruning."""

from __future__ import annotations

import datetime

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tripweave.schema import LEDGER, PAYLOAD, RAW_STORED
from tripweave.sources.storage import drop_partition, partition_values, scratch_path

# keeps one file small enough for a checksum task to hold
MAX_RECORDS_PER_FILE = 500_000
_KEY = ["id", "received_at"]


def _missing(error: AnalysisException) -> bool:
    return "PATH_NOT_FOUND" in str(error.getCondition() or error)


# ------------------------------------------------------------- JSON-lines files


def read_raw_jsonl(spark: SparkSession, path: str, since: str | None = None, until: str | None = None) -> DataFrame:
    """Lines of JSON-lines files below ``path``: ``payload``, ``file_date``, ``is_valid``.

    Blank lines are skipped, an absent path is empty, a line that is not a JSON object is
    kept and marked. ``since``/``until`` compare with the date in the file or folder name.
    """
    try:
        lines = spark.read.option("recursiveFileLookup", "true").text(path)
    except AnalysisException as error:
        if not _missing(error):
            raise
        lines = spark.createDataFrame([], "value string").withColumn("_metadata", F.struct(F.lit("").alias("file_path")))
    # Fixed value: date in a day file's or day folder's name.
    date = F.regexp_extract("_metadata.file_path", r"(\d{4}-\d{2}-\d{2})[^/]*(?:/[^/]*)?$", 1)
    # checksum sidecars may lie beside the day files
    lines = lines.filter(~F.col("_metadata.file_path").endswith(".sha256"))
    lines = lines.select(F.trim("value").alias("payload"), date.alias("file_date")).filter("payload != ''")
    if since:
        lines = lines.filter(F.col("file_date") >= since)
    if until:
        lines = lines.filter(F.col("file_date") <= until)
    return lines.withColumn("is_valid", is_json_object("payload"))


def is_json_object(column: str) -> Column:
    """Well-formed JSON object."""
    return F.json_object_keys(column).isNotNull()


def with_received_at(payload: str, now: Column) -> Column:
    """JSON object text with ``received_at`` appended unless it has one."""
    text = F.rtrim(F.col(payload))
    body = F.rtrim(F.expr(f"substring(rtrim(`{payload}`), 1, length(rtrim(`{payload}`)) - 1)"))
    stamp = F.concat(F.lit('"received_at":"'), F.date_format(now, "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"), F.lit('"}'))
    glue = F.when(body.endswith("{"), "").otherwise(",")
    return F.when(F.get_json_object(text, "$.received_at").isNotNull(), text).otherwise(F.concat(body, glue, stamp))


def append_raw(df: DataFrame, path: str, now: Column | None = None) -> None:
    """Append ``payload`` lines to the day folder of the write time (UTC)."""
    now = F.current_timestamp() if now is None else now
    (
        df.select(with_received_at("payload", now).alias("value"), F.to_date(now).alias("date"))
        .write.mode("append")
        .option("maxRecordsPerFile", MAX_RECORDS_PER_FILE)
        .partitionBy("date")
        .text(path)
    )


# ------------------------------------------------------------- message table


def write_records(raw: DataFrame, path: str) -> None:
    """Append messages to the message table, partitioned by received date."""
    raw = raw.withColumn("received_date", F.to_date("received_at"))
    raw.write.mode("append").partitionBy("received_date").parquet(path)


def raw_table(spark: SparkSession, path: str) -> DataFrame:
    try:
        return spark.read.schema(RAW_STORED).parquet(path)
    except AnalysisException as error:
        if not _missing(error):
            raise
        return spark.createDataFrame([], RAW_STORED)


def read_raw_records(
    raw: DataFrame, user: str | None = None, device: str | None = None, msg_type: str | None = None
) -> DataFrame:
    """Location messages, optionally of one user, device or type; filters reach the scan."""
    raw = raw.filter(F.col("msg_type") == "location")
    for column, value in (("user", user), ("device", device), ("msg_type", msg_type)):
        if value:
            raw = raw.filter(F.col(column) == value)
    return raw


def parse_payload(raw: DataFrame) -> DataFrame:
    """Known payload fields as columns beside id, user, device and the untouched text."""
    parsed = raw.withColumn("_p", F.from_json("payload", PAYLOAD))
    known = [f for f in PAYLOAD.fieldNames() if f != "received_at"]
    record = {"id": "record_id"}
    carried = [F.col(c).alias(record.get(c, c)) for c in raw.columns]
    return parsed.select(*carried, *[F.col(f"_p.{f}").alias(f) for f in known])


def from_jsonl(lines: DataFrame) -> DataFrame:
    """Message rows from JSON lines; the sender comes from the receiver's own fields."""
    p = F.from_json("payload", PAYLOAD)
    return (
        lines.filter("is_valid")
        .withColumn("_p", p)
        .select(
            F.xxhash64("payload").alias("id"),
            F.try_to_timestamp("_p.received_at").alias("received_at"),
            F.coalesce("_p._type", F.lit("unknown")).alias("msg_type"),
            F.coalesce("_p._receiver_user", F.lit("unknown")).alias("user"),
            F.coalesce("_p._receiver_device", F.lit("unknown")).alias("device"),
            "payload",
        )
    )


def raw_page(
    raw: DataFrame,
    limit: int = 10,
    offset: int = 0,
    user: str | None = None,
    device: str | None = None,
    order: str = "desc",
    after: tuple[datetime.datetime | None, int] | None = None,
) -> DataFrame:
    """One page of messages by received time, newest first unless ``order='asc'``.

    ``after`` is the (received_at, id) of a page's last row: the page that follows it starts there, so its cost does not grow with its number.
    """
    if not 1 <= limit <= 500:
        raise ValueError("limit must be between 1 and 500")
    if after:
        raw = raw.filter(_beyond(*after, order))
    for column, value in (("user", user), ("device", device)):
        if value:
            raw = raw.filter(F.col(column) == value)
    keys = [F.asc(c) if order == "asc" else F.desc(c) for c in ("received_at", "id")]
    return raw.orderBy(*keys).offset(offset).limit(limit)


def _beyond(received_at: datetime.datetime | None, id_: int, order: str) -> Column:
    """Rows after a cursor; without a received time they come first in ascending and last in descending order."""
    time, asc = F.col("received_at"), order == "asc"
    next_id = F.col("id") > id_ if asc else F.col("id") < id_
    if received_at is None:
        later = time.isNotNull() if asc else F.lit(False)
        return later | (time.isNull() & next_id)
    at = F.lit(received_at)
    later = time > at if asc else (time < at) | time.isNull()
    return later | ((time == at) & next_id)


def raw_far_page(
    raw: DataFrame, limit: int, offset: int, user: str | None = None, device: str | None = None, order: str = "desc"
) -> DataFrame:
    """The rows of ``raw_page`` at a far offset: counts by day, then by minute of the days it lies in, find the time range of the page, and only
    the rows of those minutes are sorted. The driver sees a count per day, and per minute of the first and last day."""
    if not 1 <= limit <= 500:
        raise ValueError("limit must be between 1 and 500")
    for column, value in (("user", user), ("device", device)):
        if value:
            raw = raw.filter(F.col(column) == value)
    for unit in ("day", "minute"):
        step = F.date_trunc(unit, "received_at")
        counts = raw.groupBy(step.alias("step")).agg(F.count("*").alias("n"))
        wanted, seen, skipped = [], 0, 0
        for r in counts.orderBy(F.asc("step") if order == "asc" else F.desc("step")).collect():
            if seen + r.n <= offset:
                skipped = seen + r.n
            elif seen < offset + limit:
                wanted.append(r.step)
            else:
                break
            seen += r.n
        times = [t for t in wanted if t is not None]
        inside = F.lit(False)
        if times:
            inside = F.col("received_at").between(F.lit(min(times)), F.lit(max(times)) + F.expr(f"INTERVAL 1 {unit}") - F.expr("INTERVAL 1 MICROSECOND"))
        raw = raw.filter(inside | F.col("received_at").isNull() if None in wanted else inside)
        offset -= skipped
    return raw_page(raw, limit, offset, order=order)


def raw_count(
    raw: DataFrame,
    since: str | None = None,
    until: str | None = None,
    user: str | None = None,
    device: str | None = None,
    msg_type: str | None = None,
) -> DataFrame:
    """Number of messages received in whole UTC days ``since``..``until``."""
    if since:
        raw = raw.filter(F.col("received_at") >= F.lit(f"{since} 00:00:00Z").cast("timestamp"))
    if until:
        after = datetime.date.fromisoformat(until) + datetime.timedelta(days=1)
        raw = raw.filter(F.col("received_at") < F.lit(f"{after} 00:00:00Z").cast("timestamp"))
    for column, value in (("user", user), ("device", device), ("msg_type", msg_type)):
        if value:
            raw = raw.filter(F.col(column) == value)
    return raw.agg(F.count("*").alias("count"))


# ------------------------------------------------------------- export ledger


def ledger_table(spark: SparkSession, path: str) -> DataFrame:
    try:
        return spark.read.schema(LEDGER).parquet(path)
    except AnalysisException as error:
        if not _missing(error):
            raise
        return spark.createDataFrame([], LEDGER)


def unsynced(raw: DataFrame, ledger: DataFrame) -> DataFrame:
    """Messages not exported yet. The key includes the received time, so hashed ids that
    happen to collide never hide a message."""
    return raw.join(ledger.select(*_KEY), _KEY, "left_anti")


def export_batch(raw: DataFrame, ledger: DataFrame, limit: int | None = None) -> DataFrame:
    """Unexported messages: all of them, or the oldest ``limit``."""
    pending = unsynced(raw, ledger)
    return pending if limit is None else pending.orderBy("received_at", "id").limit(limit)


def write_export(batch: DataFrame, path: str) -> None:
    """Append payload lines to the folder of the received date."""
    (
        batch.select(F.col("payload").alias("value"), F.to_date("received_at").alias("date"))
        .write.mode("append")
        .option("maxRecordsPerFile", MAX_RECORDS_PER_FILE)
        .partitionBy("date")
        .text(path)
    )


def mark_synced(batch: DataFrame, ledger_path: str, now: Column | None = None) -> None:
    now = F.current_timestamp() if now is None else now
    batch.select("id", now.alias("synced_at"), "received_at").write.mode("append").parquet(ledger_path)


def export_unsynced(raw: DataFrame, ledger_path: str, path: str, limit: int | None = None) -> int:
    """Export one batch and stamp it; returns its size.

    The batch is written to the ledger's staging folder first and both steps read that
    copy, so messages that arrive meanwhile cannot slip between export and stamp.
    """
    spark = raw.sparkSession
    staged_at = scratch_path(spark, "export")
    export_batch(raw, ledger_table(spark, ledger_path), limit).write.parquet(staged_at)
    staged = spark.read.parquet(staged_at)
    write_export(staged, path)
    mark_synced(staged, ledger_path)
    return staged.count()


def retention_cutoff(retention_days: int, now: Column) -> Column:
    return F.date_sub(F.to_date(now), retention_days).cast("timestamp")


def prune_synced(raw: DataFrame, ledger: DataFrame, retention_days: int, now: Column) -> DataFrame:
    """Messages that stay: everything but exported ones older than the cutoff."""
    if retention_days <= 0:
        return raw
    old = F.col("received_at") < retention_cutoff(retention_days, now)
    # payloads of recent messages need no join, those of old ones an anti join only
    gone = ledger.filter(old).select(*_KEY)
    return raw.filter(F.coalesce(~old, F.lit(True))).unionByName(raw.filter(old).join(gone, _KEY, "left_anti"))


def prune_table(spark: SparkSession, path: str, ledger_path: str, retention_days: int, now: Column | None = None) -> None:
    """Prune the message table in place, touching only received dates before the cutoff."""
    if retention_days <= 0:
        return
    now = F.current_timestamp() if now is None else now
    cutoff = spark.range(1).select(F.date_sub(F.to_date(now), retention_days).cast("string")).first()[0]
    old_dates = [d for d in partition_values(spark, path, "received_date") if d < cutoff]
    if not old_dates:
        return
    old = raw_table(spark, path).filter(F.col("received_date") < F.lit(cutoff).cast("date"))
    kept = prune_synced(old, ledger_table(spark, ledger_path), retention_days, now)
    kept.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("received_date").parquet(path)
    # a date with nothing left writes no partition, so its folder is dropped by name
    left = {str(r[0]) for r in kept_dates(spark, path, ledger_path, cutoff, retention_days, now)}
    for date in old_dates:
        if date not in left:
            drop_partition(spark, path, "received_date", date)


def kept_dates(spark, path, ledger_path, cutoff, retention_days, now) -> list:
    """Old received dates that still hold messages; one row per day."""
    old = raw_table(spark, path).filter(F.col("received_date") < F.lit(cutoff).cast("date"))
    return prune_synced(old, ledger_table(spark, ledger_path), retention_days, now).select("received_date").distinct().collect()


def raw_counts(raw: DataFrame, ledger: DataFrame) -> DataFrame:
    """Total and unexported message counts, in one pass over the messages."""
    stamped = ledger.select(*_KEY, F.lit(True).alias("_synced")).distinct()
    return raw.select(*_KEY).join(stamped, _KEY, "left").agg(
        F.count("*").alias("total_records"), F.count_if(F.col("_synced").isNull()).alias("unsynced_records")
    )

