"""The batch pipeline: raw points to enriched, segmented, corrected points."""

from __future__ import annotations

import datetime
from collections.abc import Callable, Sequence
from dataclasses import asdict, dataclass

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tripweave.config import ENTITY, TripConfig, Zones
from tripweave.functions.timing import day_bounds_utc
from tripweave.operators.classify import Ensemble, build_ensemble
from tripweave.operators.labels import apply_corrections, migrate_labels
from tripweave.operators.long_trips import segment_staged
from tripweave.operators.segment import segment
from tripweave.operators.sequence import enrich_and_detect, locate
from tripweave.sources.label_store import migrate_stored, stored_labels
from tripweave.sources.points import points_table, replace_rows, settle_buckets, stored_dates
from tripweave.sources.raw import from_jsonl, parse_payload, read_raw_jsonl, read_raw_records
from tripweave.sources.storage import stage, unstage
from tripweave.sources.typed import date_of

REQUIRED = ("lat", "lon", "tst")


def keep_locations(pts: DataFrame) -> DataFrame:
    """Location messages only, when the message type is known."""
    return pts.filter(F.col("_type") == "location") if "_type" in pts.columns else pts


def drop_malformed(pts: DataFrame) -> DataFrame:
    return pts.dropna(subset=list(REQUIRED))


def local_day_range(pts: DataFrame, tz: str, since: str | None = None, until: str | None = None) -> DataFrame:
    """Points whose GPS time falls on local days ``since``..``until``, both included.

    The bounds are constants. Of a typed message table they select partitions and row groups; where ``tst`` is parsed from
    a payload, every row is read first.
    """
    dated = "gps_date" in pts.columns
    if since:
        low = day_bounds_utc(since, tz)
        pts = pts.filter(F.col("tst") >= low)
        pts = pts.filter(F.col("gps_date") >= date_of(low)) if dated else pts
    if until:
        high = day_bounds_utc(until, tz, end=True)
        pts = pts.filter(F.col("tst") <= high)
        pts = pts.filter(F.col("gps_date") <= date_of(high)) if dated else pts
    return pts


def process(
    pts: DataFrame,
    labels: DataFrame | None = None,
    zones: Zones = Zones(),
    cfg: TripConfig = TripConfig(),
    tz_regions=None,
    ensemble: Ensemble | None = None,
    entity: Sequence[str] = ENTITY,
) -> DataFrame:
    """Full lazy pipeline from located points to points ready for the store."""
    if not set(REQUIRED) <= set(pts.columns):
        raise ValueError(f"missing required columns: {sorted(set(REQUIRED) - set(pts.columns))}")
    pts = drop_malformed(keep_locations(pts))
    pts = enrich_and_detect(pts, cfg, tz_regions, entity)
    pts = segment(pts, ensemble or build_ensemble(zones, cfg), cfg, entity)
    return apply_corrections(pts, labels, entity)


# what enrichment, trips, segments and corrections read of a point beside its entity
_READ = ("record_id", "lat", "lon", "tst", "timestamp", "timestamp_local", "local_date")


def packed(pts: DataFrame, entity: Sequence[str] = ENTITY) -> tuple[DataFrame, Callable[[DataFrame], DataFrame]]:
    """``pts`` with all columns that no step reads as one, ``_carried``, so that sorts and windows copy one value of a row instead of each;
    and the way back."""
    rest = [c for c in pts.columns if c not in (*entity, *_READ)]
    if len(rest) < 2:
        return pts, lambda done: done

    def unpacked(done: DataFrame) -> DataFrame:
        made = [c for c in done.columns if c != "_carried"]  # a computed column replaces one of its name
        return done.select(*made, *[F.col("_carried").getField(c).alias(c) for c in rest if c not in made])

    return pts.select(*[c for c in pts.columns if c not in rest], F.struct(*rest).alias("_carried")), unpacked


def process_staged(
    pts: DataFrame, labels: DataFrame | None = None, zones: Zones = Zones(), cfg: TripConfig = TripConfig(), tz_regions=None,
) -> tuple[DataFrame, DataFrame]:
    """``process`` with the trip points written once, so that trips of days or months are cut in time shards; also that table, to be unstaged."""
    narrow, unpacked = packed(drop_malformed(keep_locations(pts)))
    trips = stage(enrich_and_detect(narrow, cfg, tz_regions), "trips")
    return unpacked(apply_corrections(segment_staged(trips, build_ensemble(zones, cfg), cfg), labels)), trips


@dataclass(frozen=True)
class Filters:
    since: str | None = None
    until: str | None = None
    user: str | None = None
    device: str | None = None
    msg_type: str | None = None

    def given(self) -> dict:
        return {k: v for k, v in asdict(self).items() if v}


def selected_points(raw: DataFrame, filters: Filters, cfg: TripConfig) -> DataFrame:
    """Located points of the message table, or of the typed one, under the rebuild filters."""
    records = read_raw_records(raw, filters.user, filters.device, filters.msg_type)
    located = drop_malformed(records if "gps_date" in raw.columns else parse_payload(records))
    located = local_day_range(located, cfg.default_tz, filters.since, filters.until)
    # of the typed table only the fields go on; the text stays where it is
    return located.drop("gps_date", "batch", "payload") if "gps_date" in raw.columns else located


def in_selection(filters: Filters, cfg: TripConfig) -> Column:
    """Stored rows that a rebuild under ``filters`` is responsible for: their user, device and GPS time."""
    chosen = F.lit(True)
    if filters.since:
        chosen &= F.col("tst") >= day_bounds_utc(filters.since, cfg.default_tz)
    if filters.until:
        chosen &= F.col("tst") <= day_bounds_utc(filters.until, cfg.default_tz, end=True)
    for column, value in (("user", filters.user), ("device", filters.device)):
        if value:
            chosen &= F.col(column) == value
    return chosen


def _concerned(spark: SparkSession, out: str, fresh: list[str], filters: Filters, clean: bool) -> list[str]:
    """Local dates to look at: those of the new rows and, to clean, the stored ones of the range and a day around it,
    since a time zone can move a time by that much."""
    if not (clean and (filters.since or filters.until)):
        return fresh
    day = datetime.timedelta(days=1)
    low = str(datetime.date.fromisoformat(filters.since) - day) if filters.since else ""
    high = str(datetime.date.fromisoformat(filters.until) + day) if filters.until else "9999"
    return sorted({*fresh, *(d for d in stored_dates(spark, out) if low <= d <= high)})


def rebuild(
    spark: SparkSession,
    raw: DataFrame,
    out: str,
    cfg: TripConfig,
    filters: Filters = Filters(),
    labels: DataFrame | None = None,
    zones: Zones = Zones(),
    tz_regions=None,
    clean: bool = False,
    dry_run: bool = False,
    buckets: int | None = None,
    label_store: str | None = None,
) -> dict:
    """Rebuild derived points from the message table; returns a summary.

    Labels are given as a frame, or as a label store: then those that must follow a trip to its new id are renamed in the store, after the
    points are published. A job lost in between leaves old ids, which the next rebuild moves.

    Only rows of the filters' users and GPS times are replaced, and only on days that have new rows; ``clean`` also removes
    such rows of days that have none any more, once the new rows are written. Everything else stays. ``buckets`` is
    the store's own count unless given; another count rewrites the store.
    """
    points = selected_points(raw, filters, cfg)
    if dry_run:
        return {"dry_run": True, "filters": filters.given(), "clean": clean, "output": out, "total_records": points.count()}
    return rebuild_points(spark, points, out, cfg, filters, labels, zones, tz_regions, clean, buckets, label_store)


def rebuild_points(
    spark: SparkSession, points: DataFrame, out: str, cfg: TripConfig, filters: Filters = Filters(), labels: DataFrame | None = None,
    zones: Zones = Zones(), tz_regions=None, clean: bool = False, buckets: int | None = None, label_store: str | None = None,
) -> dict:
    """The writing half of ``rebuild``, for located points from any source."""
    if label_store:
        labels = stored_labels(spark, label_store)
    # parsed once: the keys and the pipeline's two branches read this copy
    points = stage(points, "selected")
    fresh = sorted(str(r[0]) for r in locate(points, cfg, tz_regions).select("local_date").distinct().collect())
    dates = _concerned(spark, out, fresh, filters, clean)
    summary = {"dry_run": False, "filters": filters.given(), "total_records": 0, "commutes_found": 0, "dates": []}
    if not dates:
        unstage(points)
        return {**summary, "labels": labels}
    buckets = settle_buckets(spark, out, buckets)
    replaced = in_selection(filters, cfg)
    if not (clean and (filters.since or filters.until)):
        replaced &= F.col("local_date").isin([datetime.date.fromisoformat(d) for d in fresh])
    done, trips = process_staged(points, labels, zones, cfg, tz_regions)
    replace_rows(spark, done, replaced, dates, out, buckets)
    unstage(points, trips)
    if not fresh:
        return {**summary, "labels": labels}
    stored = points_table(spark, out).filter(in_selection(filters, cfg))
    per_day = stored.groupBy("local_date").agg(F.count("*").alias("n")).orderBy("local_date").collect()
    trips = stored.filter("commute_id is not null").select(*ENTITY, "commute_id").distinct()
    summary.update(
        total_records=sum(r["n"] for r in per_day),
        commutes_found=trips.count(),
        dates=[str(r["local_date"]) for r in per_day],
    )
    # trips found anywhere in the store count as existing: only true orphans move
    all_trips = points_table(spark, out).filter("commute_id is not null").select(*ENTITY, "commute_id").distinct()
    if label_store:
        migrate_stored(spark, label_store, all_trips)
        return {**summary, "labels": stored_labels(spark, label_store)}
    return {**summary, "labels": None if labels is None else migrate_labels(labels, all_trips)}


def points_from_jsonl(
    spark: SparkSession, path: str, since: str | None = None, until: str | None = None
) -> DataFrame:
    """Located points of all JSON-lines files in the date range, as one frame.

    All files form one history: trips may cross file borders.
    """
    return drop_malformed(keep_locations(parse_payload(from_jsonl(read_raw_jsonl(spark, path, since, until)))))


def process_jsonl(
    spark: SparkSession,
    path: str,
    cfg: TripConfig,
    since: str | None = None,
    until: str | None = None,
    labels: DataFrame | None = None,
    zones: Zones = Zones(),
    tz_regions=None,
) -> DataFrame:
    """Pipeline over JSON-lines files; write the result with ``write_points``."""
    return process(points_from_jsonl(spark, path, since, until), labels, zones, cfg, tz_regions)


def rebuild_jsonl(
    spark: SparkSession, path: str, out: str, cfg: TripConfig, since: str | None = None, until: str | None = None,
    labels: DataFrame | None = None, zones: Zones = Zones(), tz_regions=None, clean: bool = False, dry_run: bool = False,
    buckets: int | None = None,
) -> dict:
    """Rebuild the store from JSON-lines files; since and until compare with file dates and with the GPS time."""
    filters = Filters(since=since, until=until)
    points = local_day_range(points_from_jsonl(spark, path, since, until), cfg.default_tz, since, until)
    if dry_run:
        return {"dry_run": True, "filters": filters.given(), "clean": clean, "output": out, "total_records": points.count()}
    return rebuild_points(spark, points, out, cfg, filters, labels, zones, tz_regions, clean, buckets)
