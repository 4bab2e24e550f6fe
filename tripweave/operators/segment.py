"""Cutting trips into segments of one transport mode.

All steps share one ordering, so a whole trip is segmented on a single sort: looking
ahead uses ``lead .. ignore nulls`` instead of a second, descending sort.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import add

from pyspark.sql import DataFrame, functions as F

from tripweave.config import ENTITY, MOVING_MODES, TripConfig
from tripweave.functions.windows import ORDER, next_non_null, ordered, running
from tripweave.operators.classify import Ensemble, build_ensemble


def smooth_modes(
    pts: DataFrame, by: Sequence[str], mode: str = "mode", out: str | None = None, order: Sequence[str] = ORDER
) -> DataFrame:
    """Majority of the centred five rows; ties take the mode seen earliest in the window.

    The first and last two rows keep their mode, as do tracks of five rows or fewer.
    """
    w = ordered(by, order)
    near = {f"_m{i}": F.lag(mode, -i).over(w) for i in (-3, -2, -1, 1, 2, 3)}
    pts = pts.withColumns(near)
    window = [F.col("_m-2"), F.col("_m-1"), F.col(mode), F.col("_m1"), F.col("_m2")]
    # votes and their maximum are columns of their own: inlined, they would be recomputed per branch
    votes = {
        f"_n{k}": reduce(add, [(other == this).cast("int") for other in window]) for k, this in enumerate(window)
    }
    pts = pts.withColumns(votes).withColumn("_top", F.greatest(*votes))
    majority = F.coalesce(*[F.when(F.col(n) == F.col("_top"), m) for n, m in zip(votes, window)])
    inside = F.col("_m-2").isNotNull() & F.col("_m2").isNotNull()
    more_than_five = F.col("_m-3").isNotNull() | F.col("_m3").isNotNull()
    return pts.withColumn(out or mode, F.when(inside & more_than_five, majority).otherwise(F.col(mode))).drop(
        *near, *votes, "_top"
    )


def assign_segment_ids(
    pts: DataFrame,
    by: Sequence[str],
    mode: str = "mode",
    boundary: str | None = None,
    out: str = "segment_id",
    order: Sequence[str] = ORDER,
) -> DataFrame:
    """0-based id of the run of equal modes; a boundary row starts a new run."""
    before = F.lag(mode).over(ordered(by, order))
    starts = before.isNotNull() & (F.col(mode) != before)
    if boundary:
        starts = starts | (before.isNotNull() & F.col(boundary))
    pts = pts.withColumn("_starts", starts.cast("long"))
    return pts.withColumn(out, F.sum("_starts").over(running(by, order))).drop("_starts")


def merge_short_segments(
    pts: DataFrame,
    by: Sequence[str],
    cfg: TripConfig = TripConfig(),
    mode: str = "mode",
    boundary: str | None = None,
    order: Sequence[str] = ORDER,
) -> DataFrame:
    """Segments under the minimum duration take the (merged) mode of their predecessor.

    The first segment and segments that start on a protected boundary stay.
    """
    w = ordered(by, order)
    protected = F.col(boundary) if boundary else F.lit(False)
    pts = pts.withColumn("_protected", protected)
    pts = pts.withColumns(
        {
            "_before": F.lag(mode).over(w),
            "_after": F.lead(mode).over(w),
            "_after_protected": F.lead("_protected").over(w),
            "_elapsed": F.sum("time_delta_s").over(running(by, order)),
        }
    )
    first = F.col("_before").isNull()
    starts = first | (F.col("_before") != F.col(mode)) | F.col("_protected")
    ends = F.col("_after").isNull() | (F.col("_after") != F.col(mode)) | F.col("_after_protected")
    pts = pts.withColumns(
        {
            "_opened": F.when(
                starts,
                F.struct(
                    (F.col("_elapsed") - F.col("time_delta_s")).alias("elapsed"),
                    (first | F.col("_protected")).alias("stays"),
                ),
            ),
            "_closed": F.when(ends, F.col("_elapsed")),
        }
    )
    pts = pts.withColumns(
        {
            "_opened": F.last("_opened", ignorenulls=True).over(running(by, order)),
            "_closed": F.coalesce("_closed", next_non_null("_closed", by, order)),
        }
    )
    keeps = F.col("_opened.stays") | (F.col("_closed") - F.col("_opened.elapsed") >= cfg.min_segment_s)
    pts = pts.withColumn("_kept", F.when(keeps, F.col(mode)))
    return pts.withColumn(mode, F.last("_kept", ignorenulls=True).over(running(by, order))).drop(
        "_protected", "_before", "_after", "_after_protected", "_elapsed", "_opened", "_closed", "_kept"
    )


def detect_waiting(pts: DataFrame, by: Sequence[str], mode: str = "mode", order: Sequence[str] = ORDER) -> DataFrame:
    """Stationary stretches become waiting when the nearest moving modes around them
    differ, or when only one side has one; stops within one mode stay stationary."""
    pts = pts.withColumn("_moving", F.when(F.col(mode).isin(*MOVING_MODES), F.col(mode)))
    pts = pts.withColumns(
        {
            "_moved": F.last("_moving", ignorenulls=True).over(running(by, order)),
            "_moves": next_non_null("_moving", by, order),
        }
    )
    transfer = ~F.col("_moved").eqNullSafe(F.col("_moves"))
    return pts.withColumn(
        mode, F.when((F.col(mode) == "stationary") & transfer, "waiting").otherwise(F.col(mode))
    ).drop("_moving", "_moved", "_moves")


def track_keys(pts: DataFrame, cfg: TripConfig, entity: Sequence[str] = ENTITY) -> tuple[DataFrame, list[str]]:
    """Keys of one ordered track. Points outside trips are spread over time lanes, or all
    of an entity's idle points would meet under one null trip id."""
    lane = F.when(F.col("commute_id").isNull(), F.floor(F.col("tst") / F.lit(cfg.shard_seconds)))
    return pts.withColumn("_lane", lane), [*entity, "commute_id", "_lane"]


def segment(
    pts: DataFrame,
    ensemble: Ensemble | None = None,
    cfg: TripConfig = TripConfig(),
    entity: Sequence[str] = ENTITY,
) -> DataFrame:
    """Add ``transport_mode`` and ``segment_id`` to trip points; null elsewhere."""
    ensemble = ensemble or build_ensemble(cfg=cfg)
    pts, by = track_keys(pts, cfg, entity)
    pts = ensemble.classify(pts, by, "_mode")
    pts = ensemble.with_boundaries(pts, by, "_boundary")
    pts = smooth_modes(pts, by, "_mode")
    pts = merge_short_segments(pts, by, cfg, "_mode", "_boundary")
    pts = detect_waiting(pts, by, "_mode")
    pts = assign_segment_ids(pts, by, "_mode", "_boundary" if cfg.keep_forced_boundaries else None, "_segment")
    on_trip = F.col("commute_id").isNotNull()
    return pts.withColumns(
        {"transport_mode": F.when(on_trip, F.col("_mode")), "segment_id": F.when(on_trip, F.col("_segment"))}
    ).drop("_lane", "_mode", "_boundary", "_segment")
