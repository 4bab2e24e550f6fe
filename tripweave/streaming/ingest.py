"""Continuous ingest and incremental rebuild with Structured Streaming."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from tripweave.config import ENTITY, TripConfig, Zones
from tripweave.plans.incremental import refresh
from tripweave.plans.process import drop_malformed
from tripweave.schema import PAYLOAD, RAW_STORED
from tripweave.sources.raw import is_json_object, parse_payload, with_received_at


def received_messages(lines: DataFrame) -> DataFrame:
    """Message rows from text lines; text that is not a JSON object is kept as quarantine."""
    now = F.current_timestamp()
    lines = lines.select(F.trim("value").alias("value")).filter("value != ''")
    lines = lines.withColumn("_good", is_json_object("value")).withColumn(
        "_p", F.when(F.col("_good"), F.from_json("value", PAYLOAD))
    )
    return lines.select(
        F.xxhash64("value").alias("id"),
        F.coalesce(F.try_to_timestamp(F.col("_p.received_at")), now).alias("received_at"),
        F.coalesce("_p._type", F.lit("unknown")).alias("msg_type"),
        F.coalesce("_p._receiver_user", F.lit("unknown")).alias("user"),
        F.coalesce("_p._receiver_device", F.lit("unknown")).alias("device"),
        F.when(F.col("_good"), with_received_at("value", now)).otherwise(F.col("value")).alias("payload"),
        F.when(F.col("_good"), "ok").otherwise("quarantine").alias("status"),
    ).withColumn("received_date", F.to_date("received_at"))


def start_ingest(
    spark: SparkSession, in_dir: str, out_dir: str, checkpoint: str, available_now: bool = False, interval: str = "30 seconds"
) -> StreamingQuery:
    """Append arriving JSON-lines files to the message table, exactly once.

    The file sink's own commit log gives exactly-once output; readers skip quarantined
    lines by partition (``ingested``).
    """
    lines = spark.readStream.option("recursiveFileLookup", "true").text(in_dir)
    trigger = {"availableNow": True} if available_now else {"processingTime": interval}
    return (
        received_messages(lines)
        .writeStream.format("parquet")
        .option("path", out_dir)
        .option("checkpointLocation", checkpoint)
        .partitionBy("status", "received_date")
        .outputMode("append")
        .trigger(**trigger)
        .start()
    )


def ingested(spark: SparkSession, out_dir: str, status: str = "ok") -> DataFrame:
    """Messages of the ingest sink; ``status='quarantine'`` gives the unreadable lines."""
    return spark.read.parquet(out_dir).filter(F.col("status") == status).drop("status")


def deduplicated(messages: DataFrame, delay: str = "1 day") -> DataFrame:
    """Optional: drop repeats of one sender's ping within the watermark."""
    located = drop_malformed(parse_payload(messages)).withColumn("timestamp", F.timestamp_seconds("tst"))
    return located.withWatermark("timestamp", delay).dropDuplicatesWithinWatermark([*ENTITY, "tst"])


def start_incremental_rebuild(
    spark: SparkSession,
    raw_dir: str,
    out: str,
    checkpoint: str,
    cfg: TripConfig,
    labels: DataFrame | None = None,
    zones: Zones = Zones(),
    tz_regions=None,
    buckets: int | None = None,
    available_now: bool = False,
    interval: str = "5 minutes",
) -> StreamingQuery:
    """Keep the derived store current while messages arrive.

    A micro-batch replayed after a failure leaves the same store (see ``refresh``).
    """

    def on_batch(batch: DataFrame, _: int) -> None:
        refresh(batch.sparkSession, batch, out, cfg, labels, zones, tz_regions, buckets)

    stream = spark.readStream.schema(RAW_STORED).parquet(raw_dir)
    trigger = {"availableNow": True} if available_now else {"processingTime": interval}
    return stream.writeStream.foreachBatch(on_batch).option("checkpointLocation", checkpoint).trigger(**trigger).start()
