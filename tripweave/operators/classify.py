"""Transport-mode classifiers and the weighted ensemble that combines them.

A classifier adds an ``array<double>`` column of five scores in ``MODES`` order. The
built-in ones are Column expressions; ``PandasClassifier`` is the door for third-party
models and receives Arrow batches.
"""

from __future__ import annotations

import warnings
from collections.abc import Callable, Sequence
from dataclasses import dataclass
from functools import reduce
from operator import or_
from typing import Protocol

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.functions import pandas_udf

from tripweave.config import MODES, Corridor, TripConfig, Waypoint, Zones
from tripweave.functions.geo import corridor_distance
from tripweave.functions.modes import mode_by_speed
from tripweave.functions.windows import ORDER, ordered
from tripweave.operators.zones import (
    UNROLL_LIMIT,
    corridor_circles,
    inside_waypoint,
    near_corridor_box,
    waypoint_circles,
    with_zone_candidates,
)

# Votes per classifier.
WEIGHTS = {"speed": 1.0, "speed_variance": 0.5, "waypoint": 1.5, "corridor": 1.2}


def score_array(**by_mode: Column) -> Column:
    """Five scores in ``MODES`` order; missing modes and nulls count as no signal."""
    return F.array(*[F.coalesce(by_mode.get(m, F.lit(None)).cast("double"), F.lit(0.0)) for m in MODES])


class Classifier(Protocol):
    name: str

    def score(self, pts: DataFrame, by: Sequence[str], out: str) -> DataFrame:
        """Return ``pts`` with ``out``, scores per row; ``by`` keys one ordered track."""
        ...


@dataclass(frozen=True)
class SpeedClassifier:
    cfg: TripConfig = TripConfig()
    name: str = "speed"

    def score(self, pts, by, out):
        pts = pts.withColumn("_rule", mode_by_speed("speed_kmh", self.cfg))
        return pts.withColumn(out, score_array(**{m: F.when(F.col("_rule") == m, 1.0) for m in MODES})).drop("_rule")


@dataclass(frozen=True)
class SpeedVarianceClassifier:
    """Smooth speed looks like a train, uneven speed like a car."""

    cfg: TripConfig = TripConfig()
    name: str = "speed_variance"

    def score(self, pts, by, out):
        half = self.cfg.variance_window // 2
        window = ordered(by).rowsBetween(-half, half)
        mean, std = F.avg("speed_kmh").over(window), F.stddev_samp("speed_kmh").over(window)
        size = F.count("speed_kmh").over(window)
        threshold = self.cfg.smooth_cv_threshold
        pts = pts.withColumn(
            "_cv",
            F.when((F.col("speed_kmh") >= self.cfg.variance_min_kmh) & (size >= 3) & (mean >= 1.0), std / mean),
        )
        cv = F.col("_cv")
        scores = score_array(
            train=F.when(cv < threshold, 1.0 - cv / threshold),
            driving=F.when(cv >= threshold, F.least(F.lit(1.0), (cv - threshold) / threshold)),
        )
        return pts.withColumn(out, scores).drop("_cv")


@dataclass(frozen=True)
class WaypointClassifier:
    waypoints: tuple[Waypoint, ...]
    name: str = "waypoint"

    def score(self, pts, by, out):
        hinted = [w for w in self.waypoints if w.mode_hint in MODES]
        if len(hinted) <= UNROLL_LIMIT:
            votes = {
                m: F.when(reduce(or_, [inside_waypoint(w) for w in hinted if w.mode_hint == m]), 1.0)
                for m in {w.mode_hint for w in hinted}
            }
            return pts.withColumn(out, score_array(**votes))
        pts = with_zone_candidates(pts, waypoint_circles(pts.sparkSession, hinted), "_hits")
        hints = F.transform("_hits", lambda z: z["mode"])
        votes = {m: F.when(F.array_contains(hints, m), 1.0) for m in MODES}
        return pts.withColumn(out, score_array(**votes)).drop("_hits")

    def with_zone_set(self, pts: DataFrame, out: str) -> DataFrame:
        """Add ``out``: sorted names of the waypoints around each point, as one string."""
        if len(self.waypoints) <= UNROLL_LIMIT:
            names = sorted({w.name for w in self.waypoints})
            inside = {n: reduce(or_, [inside_waypoint(w) for w in self.waypoints if w.name == n]) for n in names}
            return pts.withColumn(out, F.concat_ws("\x1f", *[F.when(inside[n], n) for n in names]))
        pts = with_zone_candidates(pts, waypoint_circles(pts.sparkSession, self.waypoints), "_hits")
        names = F.array_sort(F.array_distinct(F.transform("_hits", lambda z: z["zone"])))
        return pts.withColumn(out, F.concat_ws("\x1f", names)).drop("_hits")

    def with_boundaries(self, pts: DataFrame, by: Sequence[str], out: str, order: Sequence[str] = ORDER) -> DataFrame:
        """True where the set of surrounding waypoints differs from the previous point's."""
        pts = self.with_zone_set(pts, "_zone_set")
        changed = F.col("_zone_set") != F.lag("_zone_set").over(ordered(by, order))
        return pts.withColumn(out, F.coalesce(changed, F.lit(False))).drop("_zone_set")


@dataclass(frozen=True)
class CorridorClassifier:
    corridors: tuple[Corridor, ...]
    name: str = "corridor"

    def score(self, pts, by, out):
        usable = [c for c in self.corridors if c.mode in MODES and c.points]
        if sum(len(c.sample_points()) for c in usable) <= UNROLL_LIMIT:
            confidences: dict[str, list[Column]] = {}
            for c in usable:
                distance = corridor_distance("lat", "lon", c.sample_points())
                confidence = F.when(
                    near_corridor_box(c), F.when(distance <= c.buffer_m, 1.0 - distance / c.buffer_m)
                )
                confidences.setdefault(c.mode, []).append(F.coalesce(confidence, F.lit(0.0)))
            votes = {m: F.greatest(*cs) if len(cs) > 1 else cs[0] for m, cs in confidences.items()}
            return pts.withColumn(out, score_array(**votes))
        pts = with_zone_candidates(pts, corridor_circles(pts.sparkSession, usable), "_hits")

        def best(mode: str) -> Column:
            near = F.filter("_hits", lambda z: z["mode"] == mode)
            return F.array_max(F.transform(near, lambda z: 1.0 - z["distance_m"] / z["radius_m"]))

        return pts.withColumn(out, score_array(**{m: best(m) for m in MODES})).drop("_hits")


@dataclass(frozen=True)
class PandasClassifier:
    """Third-party row model: ``fn`` maps pandas Series to a Series of 5-score lists."""

    name: str
    fn: Callable
    columns: tuple[str, ...]

    def score(self, pts, by, out):
        return pts.withColumn(out, pandas_udf(self.fn, "array<double>")(*self.columns))


@dataclass(frozen=True)
class Ensemble:
    """Weighted vote; ties go to the mode that comes first in ``MODES``."""

    entries: tuple[tuple[Classifier, float], ...]

    def classify_with_confidence(
        self, pts: DataFrame, by: Sequence[str], out: str = "mode", scores_out: str = "mode_scores"
    ) -> DataFrame:
        parts = [f"_score_{i}" for i in range(len(self.entries))]
        for part, (classifier, _) in zip(parts, self.entries):
            pts = classifier.score(pts, by, part)
        totals = {}
        for k, mode in enumerate(MODES):
            total = F.lit(0.0)
            for part, (_, weight) in zip(parts, self.entries):
                total = total + F.col(part)[k] * F.lit(float(weight))
            totals[f"_vote_{mode}"] = total
        # columns of their own, or every comparison below would sum the votes again
        pts = pts.withColumns(totals).withColumn("_best", F.greatest(*totals))
        winner = F.coalesce(*[F.when(F.col(f"_vote_{mode}") == F.col("_best"), mode) for mode in MODES])
        return pts.withColumns({out: winner, scores_out: F.array(*totals)}).drop(*parts, *totals, "_best")

    def classify(self, pts: DataFrame, by: Sequence[str], out: str = "mode") -> DataFrame:
        return self.classify_with_confidence(pts, by, out, "_scores").drop("_scores")

    def with_boundaries(self, pts: DataFrame, by: Sequence[str], out: str) -> DataFrame:
        """Forced segment boundaries from all waypoint classifiers."""
        flags = []
        for i, (classifier, _) in enumerate(self.entries):
            if isinstance(classifier, WaypointClassifier):
                pts = classifier.with_boundaries(pts, by, f"_bound_{i}")
                flags.append(f"_bound_{i}")
        if not flags:
            return pts.withColumn(out, F.lit(False))
        return pts.withColumn(out, reduce(or_, [F.col(f) for f in flags])).drop(*flags)

    def plus(self, classifier: Classifier, weight: float) -> "Ensemble":
        return Ensemble((*self.entries, (classifier, weight)))


def build_ensemble(zones: Zones = Zones(), cfg: TripConfig = TripConfig()) -> Ensemble:
    """Speed and speed variance always; waypoints and corridors when configured."""
    unknown = {w.mode_hint for w in zones.waypoints if w.mode_hint} | {c.mode for c in zones.corridors}
    if unknown - set(MODES):
        warnings.warn(f"zones vote for unknown modes and are ignored: {sorted(unknown - set(MODES))}", stacklevel=2)
    members: list[Classifier] = [SpeedClassifier(cfg), SpeedVarianceClassifier(cfg)]
    if zones.waypoints:
        members.append(WaypointClassifier(zones.waypoints))
    if zones.corridors:
        members.append(CorridorClassifier(zones.corridors))
    return Ensemble(tuple((m, WEIGHTS[m.name]) for m in members))
