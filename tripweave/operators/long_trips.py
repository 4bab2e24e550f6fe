"""Segmentation of trips that are too long for one task: a scan over time shards.

A trip lasts until the opposite zone is reached, which may be months. Here no window over points is keyed by the trip alone: rows are keyed by
(trip, time shard), and what crosses a shard edge is

* ``halo``: the few rows before and after a shard that centred windows (speed variance, majority, previous and next mode) look at. A shard
  may hold fewer rows than the halo needs; rows then come from further shards;
* carries: elapsed time, the run that is open at the edge, where it ends, the last kept mode, the moving modes before and after, and the number of
  segments so far. Each shard gives one row with these for itself; they are combined by prefix and suffix aggregates over one row a shard,
  and joined back on the shard's key.

The rows pass two staged tables, since the second carry depends on modes that need the first. Results equal ``segment``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from tripweave.config import ENTITY, MOVING_MODES, TripConfig
from tripweave.functions.windows import ORDER, next_non_null, ordered, running
from tripweave.operators.classify import Ensemble, build_ensemble
from tripweave.operators.features import FEATURE_REACH, rolling_features
from tripweave.operators.segment import segment, smooth_modes
from tripweave.sources.storage import stage, unstage

_LANE = "_lane"


def time_shards(pts: DataFrame, seconds: int) -> DataFrame:
    return pts.withColumn(_LANE, F.floor(F.col("tst") / F.lit(seconds)))


def with_halo(rows: DataFrame, track: Sequence[str], reach: int, order: Sequence[str] = ORDER) -> DataFrame:
    """``rows`` (with ``_lane``) and copies of the ``reach`` rows before and after each shard; ``_halo`` marks the copies.

    Rows further away than ``reach`` may be among the copies; between them and the shard stand at least ``reach`` others.
    """
    key = [*track, _LANE]
    w = ordered(key, order)
    # the rank and a look ahead find both ends of a shard on one sort
    near = rows.withColumns({"_rank": F.row_number().over(w), "_last": F.lead(F.lit(1), reach).over(w).isNull()})
    ends = near.filter((F.col("_rank") <= reach) | F.col("_last"))
    along = Window.partitionBy(*track).orderBy(_LANE)

    def receivers(step: int) -> Column:
        """Shards on one side that have fewer than ``reach`` rows between them and this one."""
        lanes = []
        for m in range(1, reach + 1):
            between = F.lit(0)
            if m > 1:
                frame = along.rowsBetween(1 - m, -1) if step < 0 else along.rowsBetween(1, m - 1)
                between = F.coalesce(F.sum("_n").over(frame), F.lit(0))
            other = F.lag(_LANE, m).over(along) if step < 0 else F.lead(_LANE, m).over(along)
            lanes.append(F.when(between < reach, other))
        return F.array_compact(F.array(*lanes))

    shards = rows.groupBy(*key).agg(F.count("*").alias("_n"))
    shards = shards.select(*key, receivers(-1).alias("_earlier"), receivers(1).alias("_later")).filter("size(_earlier) + size(_later) > 0")
    met = ends.join(shards, key)
    targets = F.concat(F.when(F.col("_rank") <= reach, F.col("_earlier")).otherwise(F.array().cast("array<bigint>")), F.when(F.col("_last"), F.col("_later")).otherwise(F.array().cast("array<bigint>")))
    copies = met.withColumn("_to", F.explode(targets)).withColumn(_LANE, F.col("_to"))
    copies = copies.select(*rows.columns, F.lit(True).alias("_halo"))
    return rows.withColumn("_halo", F.lit(False)).unionByName(copies)


def _smoothed(trips: DataFrame, track: Sequence[str], ensemble: Ensemble, cfg: TripConfig) -> DataFrame:
    """Trip points with smoothed mode, boundary, and the row's place in its run of equal modes: starts, stays, ends."""
    key = [*track, _LANE]
    pts = with_halo(trips, track, cfg.variance_window // 2 + 5)
    pts = ensemble.classify(pts, key, "_mode")
    pts = ensemble.with_boundaries(pts, key, "_boundary")
    pts = smooth_modes(pts, key, "_mode")
    w = ordered(key)
    pts = pts.withColumns({"_before": F.lag("_mode").over(w), "_after": F.lead("_mode").over(w), "_after_boundary": F.lead("_boundary").over(w)})
    first = F.col("_before").isNull()
    pts = pts.withColumns({
        "_starts": first | (F.col("_before") != F.col("_mode")) | F.col("_boundary"),
        "_stays": first | F.col("_boundary"),
        "_ends": F.col("_after").isNull() | (F.col("_after") != F.col("_mode")) | F.col("_after_boundary"),
    })
    return pts.filter(~F.col("_halo")).drop("_halo", "_before", "_after", "_after_boundary")


def _within(rows: DataFrame, key: Sequence[str]) -> DataFrame:
    """Elapsed time and the opening and closing of the row's run, as far as the shard itself shows them."""
    rows = rows.withColumn("_elapsed", F.sum("time_delta_s").over(running(key)))
    opened = F.struct((F.col("_elapsed") - F.col("time_delta_s")).alias("at"), F.col("_stays").alias("stays"), F.col("_mode").alias("mode"))
    rows = rows.withColumns({"_open": F.when(F.col("_starts"), opened), "_close": F.when(F.col("_ends"), F.col("_elapsed"))})
    return rows.withColumns({
        "_opened": F.last("_open", ignorenulls=True).over(running(key)),
        "_closed": F.coalesce("_close", next_non_null("_close", key)),
    })


def _at(pick, condition: Column, *values: str) -> Column:
    """Values of the first or last row (by ``ORDER``) that meets a condition."""
    return pick(F.when(condition, F.struct(*ORDER, *values)))


def _moving(mode: Column) -> Column:
    return F.when(mode.isin(*MOVING_MODES), mode)


def run_carries(rows: DataFrame, track: Sequence[str], cfg: TripConfig) -> DataFrame:
    """One row a shard: ``base`` elapsed before it, ``open_in`` and ``close_in`` of runs that cross its edges, ``kept_in`` the last
    kept mode before it, ``moved_in`` and ``moves_in`` the moving modes before and after it."""
    key = [*track, _LANE]
    inside = F.col("_opened").isNotNull() & F.col("_closed").isNotNull()
    keeps = F.col("_opened.stays") | (F.col("_closed") - F.col("_opened.at") >= cfg.min_segment_s)
    rows = _within(rows, key).withColumn("_kept", F.when(inside & keeps, F.col("_mode")))
    kept, kept_moving = F.col("_kept").isNotNull(), _moving(F.col("_kept")).isNotNull()
    always = F.lit(True)
    shards = rows.groupBy(*key).agg(
        F.sum("time_delta_s").alias("total"),
        _at(F.min, always, "_starts", "_mode", "_kept", "_closed").alias("head"),
        _at(F.max, always, "_ends").alias("tail"),
        _at(F.max, F.col("_starts"), "_open").alias("opened"),
        _at(F.min, F.col("_ends"), "_close").alias("closed"),
        _at(F.max, kept, "_kept").alias("kept_last"),
        _at(F.min, kept_moving, "_kept").alias("moving_first"),
        _at(F.max, kept_moving, "_kept").alias("moving_last"),
    )
    along = Window.partitionBy(*track).orderBy(_LANE)
    earlier = along.rowsBetween(Window.unboundedPreceding, -1)
    shards = shards.withColumn("base", F.coalesce(F.sum("total").over(earlier), F.lit(0.0)))
    last_open = F.struct((F.col("base") + F.col("opened._open.at")).alias("at"), F.col("opened._open.stays").alias("stays"), F.col("opened._open.mode").alias("mode"))
    shards = shards.withColumns({
        "open_here": F.when(F.col("opened").isNotNull(), last_open),
        "close_here": F.col("base") + F.col("closed._close"),
    })
    shards = shards.withColumns({"open_in": F.last("open_here", ignorenulls=True).over(earlier), "close_in": next_non_null("close_here", track, [_LANE])})

    goes_on = ~F.col("head._starts")  # the first row continues a run of an earlier shard
    head_close = F.coalesce("close_here", "close_in")
    head_kept = F.col("open_in.stays") | (head_close - F.col("open_in.at") >= cfg.min_segment_s)
    tail_open = ~F.col("tail._ends") & F.col("open_here").isNotNull()  # a run that starts here ends later
    tail_kept = F.col("open_here.stays") | (F.col("close_in") - F.col("open_here.at") >= cfg.min_segment_s)
    shards = shards.withColumns({
        "head_mode": F.when(goes_on & head_kept, F.col("head._mode")),
        "tail_mode": F.when(tail_open & tail_kept, F.col("open_here.mode")),
    })
    shards = shards.withColumn("kept_here", F.coalesce("tail_mode", "kept_last._kept", "head_mode"))
    shards = shards.withColumn("kept_in", F.last("kept_here", ignorenulls=True).over(earlier))
    # the mode of the first rows: that of their run if it is kept, else the one carried in
    head_run_ends_later = F.col("head._closed").isNull()
    first_kept = F.when(goes_on, F.col("head_mode").isNotNull()).when(head_run_ends_later, F.col("tail_mode").isNotNull()).otherwise(F.col("head._kept").isNotNull())
    carried = F.when(~first_kept, _moving(F.col("kept_in")))
    head, tail = _moving(F.col("head_mode")), _moving(F.col("tail_mode"))
    shards = shards.withColumns({
        "moves_here": F.coalesce(carried, head, F.col("moving_first._kept"), tail),
        "moved_here": F.coalesce(tail, F.col("moving_last._kept"), head, carried),
    })
    return shards.select(
        *key, "base", "open_in", "close_in", "kept_in",
        F.last("moved_here", ignorenulls=True).over(earlier).alias("moved_in"),
        next_non_null("moves_here", track, [_LANE]).alias("moves_in"),
    )


def _final_modes(rows: DataFrame, carries: DataFrame, track: Sequence[str], cfg: TripConfig) -> DataFrame:
    """Modes after merging short segments and naming waits, with the carries of each shard."""
    key = [*track, _LANE]
    rows = _within(rows, key).join(carries, key)
    shifted = F.struct((F.col("base") + F.col("_opened.at")).alias("at"), F.col("_opened.stays").alias("stays"), F.col("_opened.mode").alias("mode"))
    opened = F.when(F.col("_opened").isNotNull(), shifted).otherwise(F.col("open_in"))
    rows = rows.withColumns({"_opened": opened, "_closed": F.coalesce(F.col("base") + F.col("_closed"), F.col("close_in"))})
    keeps = F.col("_opened.stays") | (F.col("_closed") - F.col("_opened.at") >= cfg.min_segment_s)
    rows = rows.withColumn("_kept", F.when(keeps, F.col("_mode")))
    rows = rows.withColumn("_mode", F.coalesce(F.last("_kept", ignorenulls=True).over(running(key)), F.col("kept_in")))
    rows = rows.withColumn("_moving", _moving(F.col("_mode")))
    rows = rows.withColumns({
        "_moved": F.coalesce(F.last("_moving", ignorenulls=True).over(running(key)), F.col("moved_in")),
        "_moves": F.coalesce(next_non_null("_moving", key), F.col("moves_in")),
    })
    transfer = ~F.col("_moved").eqNullSafe(F.col("_moves"))
    mode = F.when((F.col("_mode") == "stationary") & transfer, "waiting").otherwise(F.col("_mode"))
    return rows.withColumn("_mode", mode).drop(
        "_elapsed", "_open", "_close", "_opened", "_closed", "_kept", "_moving", "_moved", "_moves", "base", "open_in", "close_in", "kept_in", "moved_in", "moves_in",
        "_starts", "_stays", "_ends",
    )


def _numbered(rows: DataFrame, track: Sequence[str], keep_boundaries: bool) -> DataFrame:
    """Segment ids: starts within the shard, plus those of all earlier shards and of the edges between them."""
    key = [*track, _LANE]
    before = F.lag("_mode").over(ordered(key))
    cut = before.isNotNull() & (F.col("_mode") != before)
    if keep_boundaries:
        cut = cut | (before.isNotNull() & F.col("_boundary"))
    rows = rows.withColumn("_cut", cut.cast("long")).withColumn("_segment", F.sum("_cut").over(running(key)))
    shards = rows.groupBy(*key).agg(
        F.sum("_cut").alias("cuts"),
        F.min(F.struct(*ORDER, "_mode", "_boundary")).alias("head"),
        F.max(F.struct(*ORDER, "_mode")).alias("tail"),
    )
    along = Window.partitionBy(*track).orderBy(_LANE)
    last = F.lag("tail._mode").over(along)
    edge = last.isNotNull() & (F.col("head._mode") != last)
    if keep_boundaries:
        edge = edge | (last.isNotNull() & F.col("head._boundary"))
    shards = shards.withColumn("edge", edge.cast("long"))
    upto = F.sum("edge").over(along.rowsBetween(Window.unboundedPreceding, 0)) + F.coalesce(F.sum("cuts").over(along.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    shards = shards.select(*key, upto.alias("_offset"))
    return rows.join(shards, key).withColumn("_segment", F.col("_segment") + F.col("_offset")).drop("_cut", "_offset")


def segment_in_shards(
    pts: DataFrame, ensemble: Ensemble | None = None, cfg: TripConfig = TripConfig(), entity: Sequence[str] = ENTITY, shard_seconds: int = 86_400
) -> DataFrame:
    """``segment``, with trips cut in time shards of ``shard_seconds``; writes two staged tables of the trip points.

    Classifiers may look as far as the variance window at both sides of a point.
    """
    ensemble = ensemble or build_ensemble(cfg=cfg)
    track = [*entity, "commute_id"]
    trips = time_shards(pts.filter("commute_id is not null"), shard_seconds)
    rows = stage(_smoothed(trips, track, ensemble, cfg), "smoothed")
    modes = stage(_final_modes(rows, run_carries(rows, track, cfg), track, cfg), "modes")
    unstage(rows)
    done = _numbered(modes, track, cfg.keep_forced_boundaries)
    done = done.select(*pts.columns, F.col("_mode").alias("transport_mode"), F.col("_segment").alias("segment_id"))
    idle = pts.filter("commute_id is null").withColumns({"transport_mode": F.lit(None).cast("string"), "segment_id": F.lit(None).cast("long")})
    return done.unionByName(idle)


def segment_staged(
    pts: DataFrame, ensemble: Ensemble | None = None, cfg: TripConfig = TripConfig(), entity: Sequence[str] = ENTITY, longest_seconds: int = 2 * 86_400
) -> DataFrame:
    """``segment`` for a written table: trips of up to ``longest_seconds`` a task each, longer ones in time shards."""
    track = [*entity, "commute_id"]
    spans = pts.filter("commute_id is not null").groupBy(*track).agg((F.max("tst") - F.min("tst")).alias("_span"))
    long = spans.filter(F.col("_span") > longest_seconds).select(*track)
    if long.isEmpty():
        return segment(pts, ensemble, cfg, entity)
    # rows outside trips have no trip to look up
    short = segment(pts.join(long, track, "left_anti"), ensemble, cfg, entity)
    return short.unionByName(segment_in_shards(pts.join(long, track, "left_semi"), ensemble, cfg, entity))


def point_features_in_shards(pts: DataFrame, entity: Sequence[str] = ENTITY, shard_seconds: int = 86_400) -> DataFrame:
    """``point_features`` of trip points, with trips cut in time shards."""
    track = [*entity, "commute_id"]
    key = [*track, _LANE]
    rows = with_halo(time_shards(pts.filter("commute_id is not null"), shard_seconds), track, FEATURE_REACH)
    rows = rolling_features(rows, key).filter(~F.col("_halo")).drop("_halo")
    rows = rows.withColumn("_elapsed", F.sum("time_delta_s").over(running(key)))
    rows = rows.withColumn("_moving_at", F.when(F.col("is_stopped") == 0, F.col("_elapsed")))
    rows = rows.withColumn("_moved_at", F.last("_moving_at", ignorenulls=True).over(running(key)))
    along = Window.partitionBy(*track).orderBy(_LANE)
    earlier = along.rowsBetween(Window.unboundedPreceding, -1)
    shards = rows.groupBy(*key).agg(F.sum("time_delta_s").alias("total"), F.max("_moving_at").alias("moved"))
    shards = shards.withColumn("base", F.coalesce(F.sum("total").over(earlier), F.lit(0.0)))
    moved = F.last(F.col("base") + F.col("moved"), ignorenulls=True).over(earlier)
    shards = shards.select(*key, (F.col("base") - F.coalesce(moved, F.lit(0.0))).alias("_stopped_in"))
    rows = rows.join(shards, key)
    return rows.withColumn("stop_duration_s", F.col("_elapsed") - F.coalesce("_moved_at", -F.col("_stopped_in"))).drop("_elapsed", "_moving_at", "_moved_at", "_stopped_in", _LANE)


def polyline_vertices_in_shards(pts: DataFrame, entity: Sequence[str] = ENTITY, shard_seconds: int = 86_400) -> DataFrame:
    """``polyline_vertices``, numbered within time shards and shifted by the points of earlier ones."""
    line = [*entity, "commute_id", "segment_id"]
    key = [*line, _LANE]
    rows = time_shards(pts.filter("commute_id is not null"), shard_seconds).withColumn("_rank", F.row_number().over(ordered(key)))
    shards = rows.groupBy(*key).agg(F.count("*").alias("_n"))
    along = Window.partitionBy(*line).orderBy(_LANE)
    shards = shards.select(
        *key, F.coalesce(F.sum("_n").over(along.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"),
        F.sum("_n").over(Window.partitionBy(*line)).alias("_all"),
    )
    rows = rows.join(shards.filter("_all > 1"), key)
    return rows.select(*line, "transport_mode", (F.col("_rank") + F.col("_before")).cast("int").alias("vertex"), "lat", "lon")
