"""Decision-tree mode model, trained on human labels."""

from __future__ import annotations

import json
from collections.abc import Sequence
from dataclasses import asdict, dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tripweave.config import ENTITY, MODES, TripConfig
from tripweave.functions.numeric import stable_round
from tripweave.operators.classify import score_array
from tripweave.operators.exact_tree import Tree, constant, grow, whole
from tripweave.operators.features import FEATURE_COLUMNS, point_features, training_set
from tripweave.operators.labels import apply_corrections, labelled_points, restrict_to_labelled
from tripweave.sources.storage import stage, unstage

MAX_DEPTH = 30  # the driver holds the tree, at most 2 ** (depth + 1) nodes


def _mode_index(column: str) -> Column:
    return (F.array_position(F.array(*[F.lit(m) for m in MODES]), F.col(column)) - 1).cast("int")


def _mode_name(index: Column) -> Column:
    return F.get(F.array(*[F.lit(m) for m in MODES]), index)


def whole_features(frame: DataFrame) -> Column:
    """The model's inputs as whole numbers; a missing feature counts as zero."""
    have = set(frame.columns)
    return F.array(*[whole(F.col(c)) if c in have else F.lit(0).cast("long") for c in FEATURE_COLUMNS])


@dataclass
class ModeModel:
    """A trained tree with its metrics; also usable as an ensemble classifier."""

    tree: Tree | None = None
    metrics: dict = field(default_factory=dict)
    cfg: TripConfig = TripConfig()
    name: str = "ml_baseline"

    def _features(self, pts: DataFrame) -> DataFrame:
        return pts if "speed_cv_w10" in pts.columns else point_features(pts, self.cfg)

    def _leaves(self, pts: DataFrame) -> DataFrame:
        """``_leaf``: the leaf of every row, whose features are made if they are missing."""
        pts = self._features(pts)
        return pts.withColumn("_f", whole_features(pts)).withColumn("_leaf", self.tree.leaf(F.col("_f")))

    def _mode(self) -> Column:
        choices = [self.tree.choice(n) for n in range(len(self.tree.left))]
        return _mode_name(F.get(constant(choices, "int"), F.col("_leaf")))

    def score(self, pts: DataFrame, by: Sequence[str], out: str) -> DataFrame:
        """Class probabilities in mode order; zeros when untrained."""
        if self.tree is None:
            return pts.withColumn(out, score_array())
        odds = [self.tree.odds(n) for n in range(len(self.tree.left))]
        ranked = {m: F.get(constant([o[i] for o in odds], "double"), F.col("_leaf")) for i, m in enumerate(MODES)}
        return self._leaves(pts).withColumn(out, score_array(**ranked)).select(*[c for c in pts.columns if c != out], out)

    def predict(self, pts: DataFrame, out: str = "predicted") -> DataFrame:
        if self.tree is None:
            return pts.withColumn(out, F.lit("unknown"))
        return self._leaves(pts).withColumn(out, self._mode()).select(*[c for c in pts.columns if c != out], out)

    def save(self, path: str) -> None:
        """Model directory plus a readable metrics sidecar beside it."""
        if self.tree is None:
            raise ValueError("an untrained model cannot be used here")
        spark = SparkSession.getActiveSession()
        nodes = spark.createDataFrame([(json.dumps(asdict(self.tree)),)], "value string")
        nodes.coalesce(1).write.mode("overwrite").text(f"{path}/tree")
        meta = {
            "version": 2,
            "classes": list(self.metrics.get("per_class", {})),
            "feature_names": list(FEATURE_COLUMNS),
            "metrics": self.metrics,
        }
        sidecar = spark.createDataFrame([(json.dumps(meta),)], "value string")
        sidecar.coalesce(1).write.mode("overwrite").text(f"{path}/metrics")

    @classmethod
    def load(cls, spark, path: str, cfg: TripConfig = TripConfig()) -> "ModeModel":
        tree = Tree(**json.loads(spark.read.text(f"{path}/tree").first()[0]))
        meta = json.loads(spark.read.text(f"{path}/metrics").first()[0])
        return cls(tree, meta["metrics"] or {}, cfg)


def labelled_training_set(
    pts: DataFrame,
    log: DataFrame,
    commute_ids: Sequence[str] | None = None,
    cfg: TripConfig = TripConfig(),
    entity: Sequence[str] = ENTITY,
) -> DataFrame:
    """All points of labelled trips; labels override the classifier's mode."""
    labelled = restrict_to_labelled(pts.filter("commute_id is not null"), log, commute_ids, entity)
    features = point_features(labelled, cfg, entity)
    corrected = apply_corrections(features.drop("predicted_mode"), log, entity)
    return training_set(corrected)


def hold_out(
    data: DataFrame, test_fraction: float, key: Sequence[str] = ("record_id",), seed: int = 42, label: str = "label"
) -> DataFrame:
    """Add ``is_test``: a uniform hash of the row key, so every class is split alike and the split is the same on every run
    and every partitioning. Of a class of two or more rows the one with the smallest hash is always held out."""
    text = F.concat_ws("|", F.lit(str(seed)), *[F.col(k).cast("string") for k in key])
    drawn = data.withColumn("_draw", F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long"))
    chosen = F.col("_draw") % 1_000_000 < int(test_fraction * 1_000_000)
    if test_fraction <= 0:
        return drawn.withColumn("is_test", F.lit(False)).drop("_draw")
    least = drawn.groupBy(F.col(label).alias("_class")).agg(F.min("_draw").alias("_least"), F.count("*").alias("_n"))
    first = (F.col("_n") > 1) & (F.col("_draw") == F.col("_least"))
    # one row for each mode
    marked = drawn.join(F.broadcast(least), drawn[label].eqNullSafe(F.col("_class")))
    return marked.withColumn("is_test", chosen | first).drop("_draw", "_class", "_least", "_n")


def class_weights(counts: dict[str, int]) -> dict[str, float]:
    """Balanced weights n / (k * n_class)."""
    total, k = sum(counts.values()), len(counts)
    return {m: total / (k * n) for m, n in counts.items()}


def confusion(predictions: DataFrame, actual: str = "label", predicted: str = "predicted") -> DataFrame:
    return predictions.groupBy(actual, predicted).agg(F.count("*").alias("n"))


def per_class_metrics(matrix: DataFrame, actual: str = "label", predicted: str = "predicted") -> DataFrame:
    """Precision, recall, F1 and support per mode from a confusion matrix."""
    hit = F.when(F.col(actual) == F.col(predicted), F.col("n")).otherwise(0)
    cells = matrix.select(F.col(actual).alias("mode"), hit.alias("hits"), F.col("n").alias("support"), F.lit(0).cast("long").alias("claimed"))
    claims = matrix.select(
        F.col(predicted).alias("mode"), F.lit(0).cast("long").alias("hits"), F.lit(0).cast("long").alias("support"), F.col("n").alias("claimed")
    )
    sums = cells.unionByName(claims).groupBy("mode").agg(
        F.sum("hits").alias("hits"), F.sum("support").alias("support"), F.sum("claimed").alias("claimed")
    )
    precision = F.when(F.col("claimed") > 0, F.col("hits") / F.col("claimed")).otherwise(0.0)
    recall = F.when(F.col("support") > 0, F.col("hits") / F.col("support")).otherwise(0.0)
    f1 = F.when(precision + recall > 0, 2 * precision * recall / (precision + recall)).otherwise(0.0)
    return sums.select(
        "mode",
        stable_round(precision, 3).alias("precision"),
        stable_round(recall, 3).alias("recall"),
        stable_round(f1, 3).alias("f1"),
        "support",
    )


def accuracy(matrix: DataFrame, actual: str = "label", predicted: str = "predicted") -> DataFrame:
    hit = F.when(F.col(actual) == F.col(predicted), F.col("n")).otherwise(0)
    return matrix.agg(
        stable_round(F.sum(hit) / F.sum("n"), 4).alias("accuracy"), F.sum(hit).alias("correct"), F.sum("n").alias("total")
    )


def fit(data: DataFrame, max_depth: int = 10, test_fraction: float = 0.2, cfg: TripConfig = TripConfig()) -> ModeModel:
    """Train on a ``training_set`` frame and score the held-out rows."""
    if not 1 <= max_depth <= MAX_DEPTH:
        raise ValueError(f"max_depth must be between 1 and {MAX_DEPTH}")
    # the tree reads its rows once a level: written with the whole features only
    labelled = data.filter(F.col("label").isin(*MODES))
    kept = stage(labelled.select("record_id", "label", _mode_index("label").alias("label_index"), whole_features(labelled).alias("features")), "labelled")
    total = kept.count()
    if total < 10:
        unstage(kept)
        raise ValueError(f"a tree needs 10 labelled points or more, there are {total}")
    split = test_fraction > 0 and total >= 20
    rows = stage(hold_out(kept, test_fraction if split else 0.0), "split")
    training = rows.filter(~F.col("is_test")) if split else rows
    held_out = rows.filter("is_test") if split else rows
    counts = {r["label"]: r["n"] for r in training.groupBy("label").agg(F.count("*").alias("n")).collect()}  # five at most
    weights = class_weights(counts)
    tree = grow(training, [counts.get(m, 0) for m in MODES], [weights.get(m, 0.0) for m in MODES], max_depth)
    model = ModeModel(tree, {}, cfg)
    judged = held_out.withColumn("_leaf", tree.leaf(F.col("features"))).withColumn("predicted", model._mode())
    cells = confusion(judged).collect()  # a row for each pair of modes
    matrix = data.sparkSession.createDataFrame(cells, "label string, predicted string, n bigint")
    scores = {r["mode"]: r.asDict() for r in per_class_metrics(matrix).collect()}
    model.metrics = {
        "accuracy": accuracy(matrix).first()["accuracy"],
        "sample_count": total,
        "per_class": {
            m: {k: scores[m][k] for k in ("precision", "recall", "f1", "support")} for m in MODES if m in scores
        },
        "feature_importances": {
            c: round(v, 4) for c, v in zip(FEATURE_COLUMNS, tree.importances(len(FEATURE_COLUMNS)), strict=True)
        },
    }
    unstage(kept, rows)
    return model


def train_from_labels(
    pts: DataFrame,
    log: DataFrame,
    commute_ids: Sequence[str] | None = None,
    max_depth: int = 10,
    test_fraction: float = 0.2,
    cfg: TripConfig = TripConfig(),
    path: str | None = None,
) -> ModeModel:
    """Train from labelled trips and optionally save the model."""
    trips = log if commute_ids is None else log.filter(F.col("commute_id").isin(list(commute_ids)))
    if trips.isEmpty():
        raise ValueError("the label log is empty" if commute_ids is None else "none of the given trips has labels")
    model = fit(labelled_training_set(pts, log, commute_ids, cfg), max_depth, test_fraction, cfg)
    if path:
        model.save(path)
    return model


def metrics_frame(spark, model: ModeModel) -> DataFrame:
    """Per-mode metrics, accuracy and importances as (section, name, metric, value) rows."""
    m = model.metrics
    rows = [("overall", "all", "accuracy", float(m["accuracy"])), ("overall", "all", "sample_count", float(m["sample_count"]))]
    rows += [("per_class", c, k, float(v)) for c, ks in m["per_class"].items() for k, v in ks.items()]
    rows += [("importance", c, "importance", float(v)) for c, v in m["feature_importances"].items()]
    return spark.createDataFrame(rows, "section string, name string, metric string, value double")


def evaluate_classifier(pts: DataFrame, log: DataFrame, mode: str = "predicted_mode", entity: Sequence[str] = ENTITY) -> DataFrame:
    """Classifier output against human labels: point counts per ``predicted->label``.

    Runs on the classifier's own mode, not on the corrected one.
    """
    mode = mode if mode in pts.columns else "transport_mode"
    judged = labelled_points(pts, log, entity)
    return judged.groupBy(
        F.coalesce(F.col(mode), F.lit("none")).alias("predicted"), F.col("corrected_mode").alias("actual")
    ).agg(F.count("*").alias("n"))
