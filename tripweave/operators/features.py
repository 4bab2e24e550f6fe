"""Point features for the mode model, on the same track windows as segmentation."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from tripweave.config import ENTITY, TripConfig
from tripweave.functions.geo import angle_diff, bearing_deg
from tripweave.functions.timing import cyclical_hour
from tripweave.functions.windows import ordered, running
from tripweave.operators.segment import track_keys

# The model's input columns, in order.
FEATURE_COLUMNS = (
    "speed_kmh",
    "acceleration",
    "bearing_change",
    "speed_mean_w10",
    "speed_std_w10",
    "speed_cv_w10",
    "accel_std_w10",
    "bearing_change_mean_w10",
    "distance_sum_w10",
    "hour_sin",
    "hour_cos",
    "day_of_week",
    "is_stopped",
    "stop_duration_s",
)


def stop_duration(pts: DataFrame, by: Sequence[str], stopped: str = "is_stopped", out: str = "stop_duration_s") -> DataFrame:
    """Seconds of the current stop so far; zero while moving.

    Running time minus running time at the last moving row: no island key, no re-sort.
    """
    pts = pts.withColumn("_elapsed", F.sum("time_delta_s").over(running(by)))
    moved_at = F.last(F.when(F.col(stopped) == 0, F.col("_elapsed")), ignorenulls=True).over(running(by))
    return pts.withColumn(out, F.col("_elapsed") - F.coalesce(moved_at, F.lit(0.0))).drop("_elapsed")


def point_features(pts: DataFrame, cfg: TripConfig = TripConfig(), entity: Sequence[str] = ENTITY) -> DataFrame:
    """Motion, rolling, temporal and stop features of every point, per trip."""
    pts, by = track_keys(pts, cfg, entity)
    return stop_duration(rolling_features(pts, by), by).drop("_lane")


#: Rows on either side that ``rolling_features`` looks at.
FEATURE_REACH = 7


def rolling_features(pts: DataFrame, by: Sequence[str]) -> DataFrame:
    """All but the stop's duration: what a few neighbouring rows decide."""
    w = ordered(by)
    pts = pts.withColumn("_p", F.lag(F.struct("lat", "lon", "speed_kmh")).over(w))
    gain = F.when(F.col("time_delta_s") > 0, (F.col("speed_kmh") - F.col("_p.speed_kmh")) / F.col("time_delta_s"))
    pts = pts.withColumns(
        {
            "acceleration": F.coalesce(gain, F.lit(0.0)),
            "bearing": F.coalesce(bearing_deg(F.col("_p.lat"), F.col("_p.lon"), "lat", "lon"), F.lit(0.0)),
        }
    ).drop("_p")
    turn = angle_diff("bearing", F.lag("bearing").over(w))
    pts = pts.withColumn("bearing_change", F.coalesce(turn, F.lit(0.0)))
    near = w.rowsBetween(-5, 5)
    pts = pts.withColumns(
        {
            "speed_mean_w10": F.avg("speed_kmh").over(near),
            "speed_std_w10": F.coalesce(F.stddev_samp("speed_kmh").over(near), F.lit(0.0)),
            "accel_std_w10": F.coalesce(F.stddev_samp("acceleration").over(near), F.lit(0.0)),
            "bearing_change_mean_w10": F.avg("bearing_change").over(near),
            "distance_sum_w10": F.sum("distance_m").over(near),
        }
    )
    hour_sin, hour_cos = cyclical_hour("timestamp")
    cv = F.when(F.col("speed_mean_w10") > 0, F.col("speed_std_w10") / F.col("speed_mean_w10")).otherwise(0.0)
    return pts.withColumns(
        {
            "speed_cv_w10": cv,
            "hour": F.hour("timestamp"),
            "minute": F.minute("timestamp"),
            "day_of_week": F.weekday("timestamp"),
            "hour_sin": hour_sin,
            "hour_cos": hour_cos,
            "is_stopped": (F.col("speed_kmh") < 1.0).cast("int"),
        }
    )


def training_set(features: DataFrame, label_col: str = "transport_mode") -> DataFrame:
    """Rows that carry a label: the fourteen features and ``label``."""
    keep = [c for c in (*ENTITY, "record_id", "commute_id") if c in features.columns]
    return features.filter(F.col(label_col).isNotNull()).select(
        *keep, *FEATURE_COLUMNS, F.col(label_col).alias("label")
    )
