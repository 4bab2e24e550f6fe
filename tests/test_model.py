import pytest
from pyspark.sql import functions as F

from catalog.base import CFG, label_log, points
from tripweave.config import MODES
from tripweave.operators import analytics as A, model as M
from tripweave.operators.classify import build_ensemble
from tripweave.operators.features import FEATURE_COLUMNS, point_features


@pytest.fixture(scope="module")
def data(spark, sf_dir):
    pts = A.on_trips(points(spark, sf_dir)).cache()
    return pts, label_log(A.segments(pts)).cache()


@pytest.fixture(scope="module")
def model(data):
    return M.train_from_labels(*data, cfg=CFG)


def test_features_of_a_plain_track(spark):
    rows = [("u", "d", "c", i, i * 10, 40.0, -74.0, 1.5 * max(0, i - 4), 0.0, 10.0 if i else 0.0) for i in range(10)]
    pts = spark.createDataFrame(
        rows, "user string, device string, commute_id string, record_id long, tst long, lat double, lon double, speed_kmh double, distance_m double, time_delta_s double"
    ).withColumn("timestamp", F.timestamp_seconds("tst"))
    got = point_features(pts).orderBy("tst").collect()
    assert [r["stop_duration_s"] for r in got[:6]] == [0.0, 10.0, 20.0, 30.0, 40.0, 0.0]
    assert got[0]["acceleration"] == 0.0 and got[6]["acceleration"] == pytest.approx(0.15)
    assert set(FEATURE_COLUMNS) <= set(got[0].asDict())


def test_metrics_shape(model):
    m = model.metrics
    assert 0.5 < m["accuracy"] <= 1.0 and m["sample_count"] >= 20
    assert sum(m["feature_importances"].values()) == pytest.approx(1.0, abs=0.01)
    assert set(m["per_class"]) <= set(MODES)


def test_prediction_and_vote(data, model):
    pts, _ = data
    assert {r["predicted"] for r in model.predict(pts).select("predicted").distinct().collect()} <= set(MODES)
    voted = build_ensemble(cfg=CFG).plus(model, 5.0).classify(pts, ["user", "device", "commute_id"])
    assert voted.count() == pts.count()


def test_untrained_model(spark, data, tmp_path):
    pts, _ = data
    empty = M.ModeModel()
    assert empty.predict(pts.limit(3)).first()["predicted"] == "unknown"
    assert empty.score(pts.limit(3), [], "s").first()["s"] == [0.0] * 5
    with pytest.raises(ValueError):
        empty.save(str(tmp_path / "m"))


def test_save_and_load(spark, data, model, tmp_path):
    model.save(str(tmp_path / "m"))
    again = M.ModeModel.load(spark, str(tmp_path / "m"), CFG)
    assert again.metrics == model.metrics
    pts, _ = data
    both = again.predict(model.predict(pts, "a"), "b")
    assert both.filter("a <> b").isEmpty()


def test_errors(data):
    pts, log = data
    with pytest.raises(ValueError):
        M.train_from_labels(pts, log.limit(0), cfg=CFG)
    with pytest.raises(ValueError):
        M.train_from_labels(pts, log, commute_ids=["nope"], cfg=CFG)


def test_class_weights_balance():
    assert M.class_weights({"a": 30, "b": 10}) == {"a": pytest.approx(2 / 3), "b": 2.0}
