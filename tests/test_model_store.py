"""Models are trained, kept, loaded in another session and score alike."""

import pytest
from pyspark.sql import functions as F

from barloom.operators import ml
from barloom.operators.model_store import ModelStore, fold_periods


@pytest.fixture(scope="module")
def labelled(spark):
    noise = lambda tag: F.pmod(F.xxhash64("id", F.lit(tag)), F.lit(1000)) / 1000
    at = F.timestamp_seconds(F.col("id") * 86400).cast("timestamp_ntz")
    rows = spark.range(400).select(at.alias("timestamp"), F.lit("A").alias("symbol"), noise("a").alias("a"), noise("b").alias("b"))
    return rows.withColumns({"target_binary_up_1d": (F.col("a") + F.col("b") > 1).cast("int"), "target_fwd_ret_1d": F.col("a") - F.col("b")}).persist()


@pytest.mark.parametrize("kind,target", [
    ("baseline", "target_binary_up_1d"), ("logistic_regression", "target_binary_up_1d"), ("ridge_regression", "target_fwd_ret_1d"),
    ("random_forest", "target_fwd_ret_1d"), ("lightgbm", "target_binary_up_1d")])
def test_save_and_load(spark, labelled, tmp_path, kind, target):
    params = {"n_estimators": 3} if kind in ("random_forest", "lightgbm") else None
    model, folded = ml.fit_experiment(labelled, ["a", "b"], target, kind, params)
    name = ModelStore(spark, str(tmp_path)).save(model, kind, target, 42, params, fold_periods(folded), ml.experiment_metrics(model, folded, target))
    again = ModelStore(spark.newSession(), str(tmp_path))
    loaded, test = again.load(name), folded.filter("fold = 'test'")
    assert loaded.features == model.features and loaded.task == model.task and loaded.scaling == model.scaling
    assert sorted(map(tuple, loaded.predict(test).collect())) == sorted(map(tuple, model.predict(test).collect()))
    record = again.records().first()
    assert record.periods["train"].end < record.periods["test"].start and record.periods["test"].rows == test.count()
    assert set(record.metrics) == {"train", "validation", "test"} and record.versions["spark"] == spark.version


def test_latest_and_missing(spark, labelled, tmp_path):
    store, target = ModelStore(spark, str(tmp_path)), "target_fwd_ret_1d"
    for kind, params in (("baseline", {"strategy": "mean"}), ("ridge_regression", None), ("baseline", {"strategy": "median"})):
        model, _ = ml.fit_experiment(labelled, ["a", "b"], target, kind, params)
        store.save(model, kind, target, 1, params)
    assert store.load_latest(target, "baseline").model.strategy == "median"
    assert not isinstance(store.load_latest(target, "ridge_regression").model, ml.Baseline)
    assert store.load_latest(target, "xgboost").model.strategy == "median"
    with pytest.raises(KeyError):
        store.load("nothing")
    with pytest.raises(KeyError):
        store.load_latest("other")
