"""Transport-mode rules as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from tripweave.config import MODE_SPEED_RANGES, MOVING_MODES, TripConfig

# Texts of a review verdict.
UNKNOWN_MODE = "unknown mode"
CONSISTENT = "speed profile consistent with mode"
TRANSFER = "stationary between %s and %s — likely a transfer"
OUT_OF_RANGE = "avg speed %s km/h outside %s range (%s-%s)"
TOP_SPEED = ", max %s km/h"


def _c(x) -> Column:
    return x if isinstance(x, Column) else F.col(x)


def mode_by_speed(speed, cfg: TripConfig = TripConfig()) -> Column:
    """Mode of a single point from its speed alone."""
    s = _c(speed)
    return (
        F.when(s < cfg.stationary_max_kmh, "stationary")
        .when(s < cfg.walk_max_kmh, "walking")
        .when(s < cfg.train_min_kmh, "driving")
        .otherwise("train")
    )


def speed_band(speed) -> Column:
    """Coarse speed band used for track colouring (fixed values: 1, 7, 30, 80 km/h)."""
    s = _c(speed)
    return (
        F.when(s < 1, "stationary")
        .when(s < 7, "walking")
        .when(s < 30, "slow vehicle")
        .when(s < 80, "driving")
        .otherwise("train")
    )


def suggest_mode(avg_speed, max_speed, speed_std) -> Column:
    """Most plausible mode for a segment's speed profile."""
    avg, top, std = _c(avg_speed), _c(max_speed), _c(speed_std)
    return (
        F.when(avg < 1, "stationary")
        .when(avg < 7, "walking")
        .when(avg < 30, "driving")
        .when((std > 0) & (std / avg < 0.4), "train")
        .when(top > 80, "train")
        .when(avg < 60, "driving")
        .otherwise("train")
    )


def mode_mismatch(mode, avg_speed, max_speed, speed_std, prev_mode, next_mode) -> Column:
    """Struct(mismatch, confidence, suggested_mode, reason) for one segment."""
    mode, avg, top, std = _c(mode), _c(avg_speed), _c(max_speed), _c(speed_std)
    prev_mode, next_mode = _c(prev_mode), _c(next_mode)

    def verdict(mismatch, confidence, suggested, reason) -> Column:
        return F.struct(
            F.lit(mismatch).alias("mismatch"),
            confidence.cast("double").alias("confidence"),
            suggested.cast("string").alias("suggested_mode"),
            reason.alias("reason"),
        )

    def bound(i: int) -> Column:
        pairs = [x for m, r in MODE_SPEED_RANGES.items() for x in (F.lit(m), F.lit(r[i]))]
        return F.element_at(F.create_map(*pairs), mode)

    lo, hi = bound(0), bound(1)
    none = F.lit(None).cast("string")
    transfer = (
        (mode == "stationary")
        & (avg < 2)
        & prev_mode.isin(*MOVING_MODES)
        & next_mode.isin(*MOVING_MODES)
        & (prev_mode != next_mode)
    )
    overshoot = F.when(avg < lo, (lo - avg) / F.greatest(lo, F.lit(1))).otherwise((avg - hi) / F.greatest(hi, F.lit(1)))
    confidence = F.round(F.round(F.least(F.lit(0.95), F.lit(0.5) + overshoot * 0.5), 6), 2)
    reason = F.concat(
        F.format_string(OUT_OF_RANGE, avg.cast("string"), mode, lo.cast("string"), hi.cast("string")),
        F.when(top > 0, F.format_string(TOP_SPEED, top.cast("string"))).otherwise(F.lit("")),
    )
    return (
        F.when(mode.isNull() | ~mode.isin(*MODE_SPEED_RANGES), verdict(False, F.lit(0), none, F.lit(UNKNOWN_MODE)))
        .when(
            avg.between(lo, hi) & F.coalesce(transfer, F.lit(False)),
            verdict(True, F.lit(0.8), F.lit("waiting"), F.format_string(TRANSFER, prev_mode, next_mode)),
        )
        .when(avg.between(lo, hi), verdict(False, F.lit(0), none, F.lit(CONSISTENT)))
        .otherwise(verdict(True, confidence, suggest_mode(avg, top, std), reason))
    )
