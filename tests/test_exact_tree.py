"""The level-wise tree against a recursive one over plain lists."""

import math
import random

import pytest
from pyspark.sql import functions as F

from tripweave.operators import exact_tree
from tripweave.operators.exact_tree import RADIX, constant, grow, histogram, prefix_sums, whole


def purity(counts, weights):
    w = [n * x for n, x in zip(counts, weights)]
    return sum(x * x for x in w) / sum(w)


def brute(rows, weights, depth, classes):
    """(feature, threshold, left, right) or class counts."""
    counts = [sum(y == c for _, y in rows) for c in range(classes)]
    best = None
    if depth and sum(c > 0 for c in counts) > 1:
        for f in range(len(rows[0][0])):
            values = sorted({x[f] for x, _ in rows})
            for v, after in zip(values, values[1:]):
                left = [sum(y == c and x[f] <= v for x, y in rows) for c in range(classes)]
                score = purity(left, weights) + purity([a - b for a, b in zip(counts, left)], weights)
                if best is None or score > best[0]:
                    best = (score, f, (v + after) // 2)
    if best is None:
        return counts
    _, f, t = best
    return (f, t, brute([r for r in rows if r[0][f] <= t], weights, depth - 1, classes), brute([r for r in rows if r[0][f] > t], weights, depth - 1, classes))


def shape(tree, node=0):
    child = tree.left[node]
    return (tree.feature[node], tree.threshold[node], shape(tree, child), shape(tree, child + 1)) if child else tree.counts[node]


def frame(spark, rows):
    return spark.createDataFrame([(list(x), y) for x, y in rows], "features array<bigint>, label_index int").repartition(5)


@pytest.mark.parametrize("seed", range(3))
def test_same_tree_as_brute_force(spark, seed):
    pick = random.Random(seed)
    wide = 3 << RADIX  # values over several blocks and, by their sign, groups
    rows = [((pick.randint(-3, 3), pick.randint(-wide, wide), pick.choice([0, 1 << 30, -(1 << 30)]), 7), 0) for _ in range(150)]
    rows = [(x, (x[0] > 0) + (x[1] > 500) * (pick.random() < 0.8)) for x, _ in rows]
    rows += rows[:20]  # repeated rows
    counts = [sum(y == c for _, y in rows) for c in range(3)]
    weights = [len(rows) / (3 * n) for n in counts]
    tree = grow(frame(spark, rows), counts, weights, 4)
    assert shape(tree) == brute(rows, weights, 4, 3)
    # rows find the leaf whose counts they made up
    got = frame(spark, rows).groupBy(tree.leaf(F.col("features")).alias("leaf")).agg(*[F.count(F.when(F.col("label_index") == c, 1)) for c in range(3)])
    assert all(tree.left[r[0]] == 0 and tree.counts[r[0]] == list(r[1:]) for r in got.collect())
    assert sum(tree.importances(4)) == pytest.approx(1.0) and tree.importances(4)[3] == 0.0


def test_prefix_sums_over_blocks(spark):
    values = [-(1 << 40), -(1 << 25), -5, -1, 0, 1, 4095, 4096, 4097, 1 << 24, (1 << 24) + 1, 1 << 40]
    rows = [((v,), i % 2) for i, v in enumerate(values) for _ in range(i + 1)]
    hist = histogram(frame(spark, rows).withColumn("node", F.lit(0)), 2)
    got = {r.value: (r.l0, r.l1, r.following) for r in prefix_sums(hist, 2).collect()}
    want = {v: (*[sum(x[0] <= v and y == c for x, y in rows) for c in (0, 1)], (values + [None])[i + 1]) for i, v in enumerate(values)}
    assert got == want


def test_one_class_or_equal_rows_are_a_leaf(spark):
    assert grow(frame(spark, [((1,), 0), ((2,), 0)]), [2, 0], [1.0, 0.0], 5).left == [0]
    tied = grow(frame(spark, [((1,), 0), ((1,), 1)]), [1, 1], [1.0, 1.0], 5)
    assert tied.left == [0] and tied.choice(0) == 0 and tied.odds(0) == [0.5, 0.5]


def test_whole_numbers(spark):
    given = [None, math.nan, math.inf, -math.inf, 1.2345, -0.0004, 0.1 + 0.2]
    rows = spark.createDataFrame([(x,) for x in given], "x double").select(whole(F.col("x")).alias("x"))
    assert [r.x for r in rows.collect()] == [0, 0, 2**52, -(2**52), 1235, 0, 300]


def test_plan_has_no_window_over_a_whole_feature(spark):
    hist = histogram(frame(spark, [((1,), 0), ((2,), 1)]).withColumn("node", F.lit(0)), 2)
    plan = prefix_sums(hist, 2)._jdf.queryExecution().optimizedPlan().toString()
    specs = [line for line in plan.splitlines() if line.strip(" :+-").startswith("Window")]
    over_values = [s for s in specs if "value#" in s.rsplit("[", 1)[-1]]
    assert over_values and all("block#" in s for s in over_values)


def test_constant_arrays_are_literals(spark):
    """A lambda over the array would run again for every row and level, longer with every node."""
    plan = spark.range(3).select(F.get(constant([4, 5], "bigint"), F.col("id").cast("int")).alias("x"))
    assert [r.x for r in plan.orderBy("id").collect()] == [4, 5, None]
    text = plan._jdf.queryExecution().optimizedPlan().toString()
    assert "[4,5]" in text and "split(" not in text


def test_counts_of_a_level_are_made_once(spark, monkeypatch):
    read = []
    best = exact_tree.best_splits

    def noted(hist, nodes, weights):
        read.append(len(hist.inputFiles()))
        return best(hist, nodes, weights)

    monkeypatch.setattr(exact_tree, "best_splits", noted)
    rows = [((i, i % 3), int(i % 7 > 3)) for i in range(50)]
    counts = [sum(y == c for _, y in rows) for c in range(2)]
    grow(frame(spark, rows), counts, [1.0, 1.0], 3)
    assert len(read) == 3 and all(read)
