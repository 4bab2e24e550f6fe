"""Typed message table: payloads parsed once, rows clustered by GPS time.

The message table keeps what was received, by received date; export and pruning work on it. This table holds the same messages for the pipeline:
payload fields as columns, a partition per UTC date of the GPS time, and within a date files that follow each other in ``tst``, so that a
range of days reads its partitions and, in those, the row groups of its times. Messages without a GPS time lie in a partition of their own.

A stream fills it batch by batch; a batch is a partition level of its own, so a batch that is replayed after a failure replaces itself.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T
from pyspark.sql.streaming import StreamingQuery

from tripweave.schema import PAYLOAD, RAW, RAW_STORED
from tripweave.sources.raw import parse_payload

_FIELDS = [T.StructField("record_id" if f.name == "id" else f.name, f.dataType) for f in RAW.fields]
TYPED = T.StructType([*_FIELDS, *(f for f in PAYLOAD.fields if f.name != "received_at"), T.StructField("gps_date", T.DateType()), T.StructField("batch", T.LongType())])


def typed_messages(raw: DataFrame) -> DataFrame:
    """Messages with their payload's fields as columns, and ``gps_date``."""
    messages = parse_payload(raw.select(*RAW.fieldNames()))
    # a time that no date can hold is no time
    return messages.withColumn("gps_date", F.when(F.col("tst").between(-62_135_596_800, 253_402_300_799), date_of(F.col("tst"))))


def write_typed(raw: DataFrame, path: str, batch: int = 0) -> None:
    """Adds messages, or replaces those of the same ``batch`` on the dates that it holds."""
    rows = typed_messages(raw).withColumn("batch", F.lit(batch).cast("long"))
    (
        rows.repartitionByRange("gps_date", "tst", "record_id")
        .sortWithinPartitions("gps_date", "tst", "record_id")
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("gps_date", "batch")
        .parquet(path)
    )


def typed_table(spark: SparkSession, path: str) -> DataFrame:
    try:
        return spark.read.schema(TYPED).parquet(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], TYPED)


def date_of(tst: Column) -> Column:
    """UTC date of a GPS time, as the table's partitions name it; a constant for a constant time."""
    return F.date_add(F.lit("1970-01-01").cast("date"), F.floor(tst / 86_400).cast("int"))


def start_typed_ingest(spark: SparkSession, raw_dir: str, out: str, checkpoint: str, available_now: bool = False, interval: str = "1 minute") -> StreamingQuery:
    """Message table -> typed table, each message once."""
    stream = spark.readStream.schema(RAW_STORED).parquet(raw_dir)
    trigger = {"availableNow": True} if available_now else {"processingTime": interval}
    # batch 0 is for tables written at once
    write = lambda rows, number: write_typed(rows, out, number + 1)
    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(**trigger).start()
