import numpy as np
from pyspark.sql import functions as F

from tripweave.llm import quality as q
from tripweave.llm.queries import op8_quality

DIR = "/root/testdata/sf0.1"


def test_held_out_labels(spark):
    got = op8_quality(spark, DIR).join(spark.read.parquet(f"{DIR}/labels.parquet"), "doc_id").filter("held_out").toPandas()
    assert ((got.predicted == 1) == (got.quality == 1)).mean() > 0.97
    low = got.predicted[got.quality == 0]
    assert (low == 0).mean() > 0.9


def test_expression_equals_the_rules(spark):
    pick = np.random.default_rng(0)
    x = pick.random((600, len(q.STATISTICS)))
    y = ((x[:, 3] > 0.5) & (x[:, 7] < 0.7) | (x[:, 12] > 0.9)).astype(float)
    model = q.train(x, y)
    frame = spark.createDataFrame([tuple(map(float, r)) for r in x], ", ".join(f"{c} double" for c in q.STATISTICS))
    got = np.array([r.s for r in frame.select(q.compiled(model).alias("s")).collect()])
    total = model.intercept + sum(w * q.holds(r, x) for r, w in zip(model.rules, model.weights, strict=True))
    assert np.allclose(got, 1 / (1 + np.exp(-total)))
    assert ((got > 0.5) == (y == 1)).mean() > 0.95
    assert 0 < len(model.rules) < 300


def test_lasso_reaches_its_optimum():
    pick = np.random.default_rng(1)
    r = (pick.random((400, 6)) < 0.4).astype(float)
    y = (pick.random(400) < 1 / (1 + np.exp(1 - 3 * r[:, 0]))).astype(float)
    b, w = q.lasso(r, y, 0.01, 3000)
    slope = r.T @ (1 / (1 + np.exp(-(r @ w + b))) - y) / len(y)
    assert np.all(np.abs(slope[w == 0]) <= 0.01 + 1e-6) and np.allclose(slope[w != 0], -0.01 * np.sign(w[w != 0]), atol=1e-5)
    assert (w == 0).any() and w[0] > 1


def test_statistics_of_a_text_do_not_depend_on_its_neighbours():
    texts = ["A b. A b.\nA b.", "", "é|é X!! TWO!! a$$$", " \n ", "w " * 3000]
    raw = [t.encode() for t in texts]
    together = q.statistics_of(np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)]))
    for i, b in enumerate(raw):
        assert np.array_equal(q.statistics_of(np.frombuffer(b, np.uint8), np.array([0, len(b)]))[0], together[i])
    of = dict(zip(q.STATISTICS, together[2], strict=True))
    assert of["words"] == 4 and of["capital_words"] == 0.25 and of["marked_words"] == 0.75 and of["distinct_words"] == 1


def test_nulls_empty_and_no_labels(spark):
    docs = spark.createDataFrame([(1, None, 1.0), (1, None, 1.0), (None, "", 2.0)], "doc_id long, text string, words double")
    stats = q.statistics(docs)
    assert stats.count() == 3 and stats.filter("words = 0").count() == 3
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    model = q.fit(stats, none, F.lit(False))
    assert [r.s for r in stats.select(q.compiled(model).alias("s")).collect()] == [0.0] * 3
    assert q.statistics(docs.limit(0)).count() == 0
