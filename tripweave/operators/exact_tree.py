"""Classification tree grown level by level with exact splits, as DataFrame aggregations.

Features are whole numbers (a real feature is counted in steps of ``STEP``), so values that differ only by float noise are one
value and every split is exact. A level is one job over all rows of its open nodes:

* class counts by (node, feature, value), combined before the shuffle;
* prefix sums of the counts in the order of values. Values are cut into blocks of ``2 ** RADIX``, blocks into groups of as many,
  so no window sees more than some thousand rows of a node and feature, however many rows or distinct values there are;
* the best Gini split of each node as one aggregate; equal splits go to the first feature, then the smallest value.

The driver receives one row for each open node and level, and holds the tree (a node has a feature, a threshold and class counts).
A row finds its leaf by an expression over constant arrays: no join, no shuffle, no Python.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tripweave.functions.numeric import stable_round
from tripweave.sources.storage import stage, unstage

#: Decimals of a feature that count, and the largest whole number used for one.
DECIMALS = 3
LARGEST = 2**52
#: Bits of a value inside its block, and of a block inside its group.
RADIX = 12


def whole(value: Column) -> Column:
    """A feature in steps of a thousandth. Null and NaN are zero, infinities and values out of range the largest number."""
    given = F.when(value.isNull() | F.isnan(value), F.lit(0.0)).otherwise(value.cast("double"))
    scaled = F.round(stable_round(given, DECIMALS) * 10**DECIMALS)
    return F.greatest(F.least(scaled, F.lit(float(LARGEST))), F.lit(float(-LARGEST))).cast("long")


def _total(values: Sequence[float]) -> float:
    return reduce(lambda a, b: a + b, values)


@dataclass
class Tree:
    """Nodes by number; node 0 is the root, the right child follows the left one, ``left`` is 0 for a leaf."""

    weights: list[float]
    feature: list[int] = field(default_factory=list)
    threshold: list[int] = field(default_factory=list)
    left: list[int] = field(default_factory=list)
    gain: list[float] = field(default_factory=list)
    counts: list[list[int]] = field(default_factory=list)
    depth: int = 0

    def add(self, counts: Sequence[int]) -> int:
        self.feature.append(0)
        self.threshold.append(0)
        self.left.append(0)
        self.gain.append(0.0)
        self.counts.append(list(counts))
        return len(self.left) - 1

    def leaf(self, features: Column) -> Column:
        """The leaf of a row, from its array of whole features."""
        feature, threshold, left = (constant(x, kind) for x, kind in ((self.feature, "int"), (self.threshold, "bigint"), (self.left, "int")))

        def step(node: Column, _: Column) -> Column:
            goes_left = F.get(features, F.get(feature, node)) <= F.get(threshold, node)
            child = F.get(left, node)
            return F.when(child == 0, node).when(goes_left, child).otherwise(child + 1)

        if not self.depth:
            return F.lit(0)
        return F.aggregate(F.sequence(F.lit(1), F.lit(self.depth)), F.lit(0), step)

    def odds(self, node: int) -> list[float]:
        weighted = [n * w for n, w in zip(self.counts[node], self.weights, strict=True)]
        total = _total(weighted)
        return [x / total for x in weighted]

    def choice(self, node: int) -> int:
        """Class of the greatest weight; of equal ones the first."""
        weighted = [n * w for n, w in zip(self.counts[node], self.weights, strict=True)]
        return weighted.index(max(weighted))

    def importances(self, features: int) -> list[float]:
        """Share of the total decrease of impurity that each feature brought."""
        sums = [0.0] * features
        for f, g, child in zip(self.feature, self.gain, self.left, strict=True):
            if child:
                sums[f] += g
        total = sum(sums)
        return [s / total if total > 0 else 0.0 for s in sums]


def constant(values: Sequence, kind: str) -> Column:
    """A constant array. A cast of the whole array is folded to a literal by the optimizer, a lambda over it would run for every row."""
    text = ",".join(map(str, values))
    return F.split(F.lit(text), ",").cast(f"array<{kind}>")


def histogram(rows: DataFrame, classes: int, features: str = "features", label: str = "label_index") -> DataFrame:
    """(node, feature, value, c0, c1, ..): rows of each class by value."""
    long = rows.select("node", F.col(label).alias("_label"), F.posexplode(features).alias("feature", "value"))
    counts = [F.count(F.when(F.col("_label") == c, 1)).alias(f"c{c}") for c in range(classes)]
    return long.groupBy("node", "feature", "value").agg(*counts)


def prefix_sums(hist: DataFrame, classes: int) -> DataFrame:
    """``hist`` with l0, l1, .. (counts of all values up to this one) and ``following``, the next value of the node and feature.

    Three sums: inside a block, of earlier blocks of its group, of earlier groups.
    """
    names = [f"c{c}" for c in range(classes)]
    hist = hist.withColumns({"block": F.shiftright("value", RADIX), "part": F.shiftright("value", 2 * RADIX)})

    def before(frame: DataFrame, by: list[str], order: str, mark: str) -> DataFrame:
        w = Window.partitionBy(*by).orderBy(order)
        earlier = w.rowsBetween(Window.unboundedPreceding, -1)
        sums = [F.coalesce(F.sum(n).over(earlier), F.lit(0)).alias(f"{mark}{n}") for n in names]
        return frame.select(*by, order, *sums, F.lead("low").over(w).alias(f"{mark}low"))

    def totals(by: list[str]) -> DataFrame:
        return hist.groupBy(*by).agg(*[F.sum(n).alias(n) for n in names], F.min("value").alias("low"))

    key = ["node", "feature"]
    blocks = before(totals([*key, "part", "block"]), [*key, "part"], "block", "b")
    parts = before(totals([*key, "part"]), key, "part", "p")
    w = Window.partitionBy(*key, "part", "block").orderBy("value")
    inside = [F.sum(n).over(w.rowsBetween(Window.unboundedPreceding, 0)).alias(f"i{n}") for n in names]
    rows = hist.select(*key, "part", "block", "value", *inside, F.lead("value").over(w).alias("ilow"))
    met = rows.join(blocks.join(parts, [*key, "part"]), [*key, "part", "block"])
    sums = [(F.col(f"i{n}") + F.col(f"b{n}") + F.col(f"p{n}")).alias(f"l{n[1:]}") for n in names]
    return met.select(*key, "value", *sums, F.coalesce("ilow", "blow", "plow").alias("following"))


def _purity(counts: list[Column], weights: Sequence[float]) -> Column:
    """Sum of squared class weights over the weight: the part of a Gini impurity that a split can change."""
    weighted = [n * F.lit(w) for n, w in zip(counts, weights, strict=True)]
    return _total([x * x for x in weighted]) / _total(weighted)


def best_splits(hist: DataFrame, nodes: DataFrame, weights: Sequence[float]) -> DataFrame:
    """(node, score, feature, value, following, lefts): the best split of every node that has one.

    ``nodes`` has (node, t0, t1, ..), the class counts of the open nodes of a level; it is as small as the tree.
    """
    k = range(len(weights))
    candidates = prefix_sums(hist, len(weights)).filter(F.col("following").isNotNull()).join(F.broadcast(nodes), "node")
    left = [F.col(f"l{c}") for c in k]
    right = [F.col(f"t{c}") - F.col(f"l{c}") for c in k]
    score = _purity(left, weights) + _purity(right, weights)
    rank = F.struct(score.alias("score"), (-F.col("feature")).alias("f"), (-F.col("value")).alias("v"))
    best = F.max_by(F.struct(score.alias("score"), "feature", "value", "following", F.array(*left).alias("lefts")), rank)
    return candidates.groupBy("node").agg(best.alias("best")).select("node", "best.*")


def grow(rows: DataFrame, counts: Sequence[int], weights: Sequence[float], max_depth: int) -> Tree:
    """A tree over ``rows`` (features array<long>, label_index int), whose class counts are ``counts``.

    A node is split as long as it has two classes, two values of some feature and less than ``max_depth`` splits above it.
    ``rows`` is read once a level; hand over a written table.
    """
    spark = rows.sparkSession
    tree = Tree(list(weights))
    level = [tree.add(counts)]
    schema = ", ".join(["node int", *[f"t{c} bigint" for c in range(len(weights))]])
    for _ in range(max_depth):
        level = [n for n in level if sum(c > 0 for c in tree.counts[n]) > 1]
        if not level:
            break
        nodes = spark.createDataFrame([(n, *tree.counts[n]) for n in level], schema)
        is_open = constant([int(n in set(level)) for n in range(len(tree.left))], "int")
        placed = rows.withColumn("node", tree.leaf(F.col("features"))).filter(F.get(is_open, F.col("node")) == 1)
        # three sums read the counts: made once and written
        hist = stage(histogram(placed, len(weights)), "histogram")
        found = best_splits(hist, nodes, weights).collect()  # one row a node
        unstage(hist)
        level = []
        for r in sorted(found, key=lambda r: r["node"]):
            node, lefts = r["node"], list(r["lefts"])
            whole_counts = tree.counts[node]
            weighted = [n * w for n, w in zip(whole_counts, weights, strict=True)]
            tree.feature[node], tree.threshold[node] = r["feature"], (r["value"] + r["following"]) // 2
            tree.gain[node] = r["score"] - _total([x * x for x in weighted]) / _total(weighted)
            tree.left[node] = tree.add(lefts)
            level += [tree.left[node], tree.add([t - n for t, n in zip(whole_counts, lefts, strict=True)])]
        tree.depth += 1
    return tree
