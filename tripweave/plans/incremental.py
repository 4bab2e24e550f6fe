"""Exact incremental rebuild: recompute only what new messages can change.

A new point can change the trips between the last zone point before it and the first
zone point after it, and with them every trip that shares a date with those. Both ends
are looked up per entity, so the result equals a full rebuild however long a trip lasts
and however late a message arrives.
"""

from __future__ import annotations

import datetime
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tripweave.config import ENTITY, TripConfig, Zones
from tripweave.operators.sequence import locate
from tripweave.plans.process import drop_malformed, keep_locations, packed, process
from tripweave.sources.points import PARTITIONS, points_table, settle_buckets, with_bucket, write_partitions
from tripweave.sources.raw import parse_payload, read_raw_records
from tripweave.sources.storage import ensure_checkpoint_dir, stage, unstage

# what the pipeline adds to a point
COMPUTED = (
    "timestamp", "timezone", "timestamp_local", "local_date", "distance_m", "time_delta_s", "speed_kmh",
    "is_stationary", "at_home", "at_work", "commute_id", "commute_direction", "predicted_mode", "transport_mode",
    "segment_id", "entity_bucket",
)


_SPAN = ("day_lo", "day_hi", "from_tst", "to_tst")


def _spans(touched: DataFrame, marks: DataFrame, entity: Sequence[str]) -> DataFrame:
    """Affected dates and enclosing zone points of the ``touched`` entities.

    Each step is a grouped min/max over narrow columns with map-side combine.
    """
    tst, zone_at, key = F.col("tst"), F.when(F.col("_in_zone"), F.col("tst")), list(entity)

    def measure(spans: DataFrame, **aggregates: Column) -> DataFrame:
        kept = [c for c in spans.columns if c not in key]
        return (
            marks.join(spans, key)
            .groupBy(*key)
            .agg(*[F.any_value(c).alias(c) for c in kept], *[a.alias(n) for n, a in aggregates.items()])
        )

    spans = measure(
        touched, _p=F.max(F.when(tst < F.col("_t0"), zone_at)), _q=F.min(F.when(tst > F.col("_t1"), zone_at))
    )
    inside = (tst >= F.coalesce("_p", "tst")) & (tst <= F.coalesce("_q", "tst"))
    spans = measure(
        spans, day_lo=F.min(F.when(inside, F.col("local_date"))), day_hi=F.max(F.when(inside, F.col("local_date")))
    )
    spans = measure(
        spans,
        _s=F.min(F.when(F.col("local_date") >= F.col("day_lo"), tst)),
        _e=F.max(F.when(F.col("local_date") <= F.col("day_hi"), tst)),
    )
    return measure(
        spans, from_tst=F.max(F.when(tst < F.col("_s"), zone_at)), to_tst=F.min(F.when(tst > F.col("_e"), zone_at))
    )


def affected_spans(
    stored: DataFrame, fresh: DataFrame, lookback_days: int = 7, entity: Sequence[str] = ENTITY
) -> DataFrame:
    """Per entity with fresh points: the dates whose trips may change (``day_lo``..``day_hi``)
    and the zone points that enclose them (``from_tst``, ``to_tst``; null = open end).

    Recent points are answered from the latest partitions; only entities with older points,
    or without a zone point in that window, look through the whole store.
    """
    def narrow(pts: DataFrame) -> DataFrame:
        return pts.select(*entity, "tst", "local_date", (F.col("at_home") | F.col("at_work")).alias("_in_zone"))

    ensure_checkpoint_dir(fresh.sparkSession)
    touched = fresh.groupBy(*entity).agg(
        F.min("tst").alias("_t0"), F.max("tst").alias("_t1"), F.min("local_date").alias("_first")
    ).checkpoint()
    newest = fresh.agg(F.max("local_date")).first()[0]
    recent = F.col("_first") >= F.date_sub(F.lit(newest), lookback_days)
    window = stored.filter(F.col("local_date") >= F.date_sub(F.lit(newest), 2 * lookback_days))
    near = _spans(touched.filter(recent), narrow(window).unionByName(narrow(fresh)), entity).checkpoint()
    # dates and instants disagree by up to a day where an entity changes time zone, so an
    # anchor right at the window's edge does not count
    edge = F.unix_timestamp(F.date_sub(F.lit(newest), 2 * lookback_days - 2).cast("timestamp"))
    anchored = near.filter(F.col("from_tst") >= edge).select(*entity, *_SPAN)
    far = touched.join(anchored, list(entity), "left_anti")
    if far.isEmpty():
        return anchored
    whole = _spans(far, narrow(stored).unionByName(narrow(fresh)), entity)
    return anchored.unionByName(whole.select(*entity, *_SPAN))


def _in_context() -> Column:
    tst = F.col("tst")
    return (tst >= F.coalesce("from_tst", "tst")) & (tst <= F.coalesce("to_tst", "tst"))


def _replaced() -> Column:
    """Points whose stored version is superseded: past the opening zone point, and idle or on
    a trip of an affected date. Other trips reaching into the span keep their stored rows."""
    day = F.substring("commute_id", 1, 10).cast("date")
    after_anchor = F.col("from_tst").isNull() | (F.col("tst") > F.col("from_tst"))
    return _in_context() & after_anchor & (F.col("commute_id").isNull() | day.between(F.col("day_lo"), F.col("day_hi")))


def refresh(
    spark: SparkSession,
    new: DataFrame,
    out: str,
    cfg: TripConfig,
    labels: DataFrame | None = None,
    zones: Zones = Zones(),
    tz_regions=None,
    buckets: int | None = None,
    lookback_days: int = 7,
    entity: Sequence[str] = ENTITY,
) -> None:
    """Fold new messages into the derived store at ``out``.

    Replaying the same messages gives the same store: points are identified by entity,
    record id and time.
    """
    fresh = locate(drop_malformed(parse_payload(read_raw_records(new))), cfg, tz_regions, entity)
    # the batch is read many times below: parsed and written once
    fresh = stage(fresh, "fresh")
    if fresh.isEmpty():
        unstage(fresh)
        return
    buckets = settle_buckets(spark, out, buckets, entity)
    whole = points_table(spark, out)
    if "entity_bucket" not in whole.columns:  # no store yet
        whole = whole.withColumn("entity_bucket", F.lit(None).cast("int"))
    spans = stage(affected_spans(whole, fresh, lookback_days, entity), "spans")
    key, point = list(entity), [*entity, "record_id", "tst"]
    stored = whole.filter(_reach(spans, buckets, entity))

    known = stored.join(fresh.select(*point), point, "left_anti").join(spans, key).filter(_in_context())
    context = (
        known.drop(*COMPUTED, *_SPAN)
        .unionByName(fresh.drop(*COMPUTED), allowMissingColumns=True)
    )
    narrow, unpacked = packed(keep_locations(context), entity)
    redone = unpacked(process(narrow, labels, zones, cfg, tz_regions, entity=entity))
    # written once to the shared folder: the partitions touched and the rows are both read from it
    redone = stage(redone.join(spans, key).filter(_replaced()).drop(*_SPAN), "redone")

    touched = with_bucket(redone, buckets, entity).select(*PARTITIONS).distinct()
    stale = F.coalesce(_replaced(), F.lit(False))
    carried = (
        stored.join(touched, list(PARTITIONS), "left_semi")
        .join(spans, key, "left")
        .filter(F.col("day_lo").isNull() | ~stale)
        .drop(*_SPAN, "entity_bucket")
    )
    write_partitions(redone.unionByName(carried, allowMissingColumns=True), out, buckets, entity)
    unstage(fresh, spans, redone)


def _reach(spans: DataFrame, buckets: int, entity: Sequence[str]) -> Column:
    """Partitions that the spans can touch, as constants so that the scan is pruned: their dates, a day more at both ends
    since a time zone can move a time by that much, and their buckets."""
    day = lambda column: F.to_date(F.timestamp_seconds(column))
    ends = spans.agg(
        F.min(F.least(F.coalesce(day("from_tst"), F.lit("0001-01-02").cast("date")), "day_lo")),
        F.max(F.greatest(F.coalesce(day("to_tst"), F.lit("9999-12-30").cast("date")), "day_hi")),
    ).first()
    if ends[0] is None:
        return F.lit(False)
    one = datetime.timedelta(days=1)
    used = [r[0] for r in with_bucket(spans, buckets, entity).select("entity_bucket").distinct().collect()]  # at most ``buckets``
    low, high = (F.lit((d + step).isoformat()).cast("date") for d, step in ((ends[0], -one), (ends[1], one)))
    return F.col("local_date").between(low, high) & F.col("entity_bucket").isin(used)
