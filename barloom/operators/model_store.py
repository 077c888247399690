"""Trained models on shared storage, with a record each, to be loaded again for scoring.

A model is saved first (Spark ML's own persistence), its record afterwards, as one
Parquet row. Only models with a record are seen, so a save that breaks off leaves
nothing that could be loaded.
"""

from __future__ import annotations

import json
import platform
import uuid
from dataclasses import asdict, dataclass
from datetime import datetime, timezone

import pyspark
from pyspark.ml.classification import GBTClassificationModel, LogisticRegressionModel, RandomForestClassificationModel
from pyspark.ml.regression import GBTRegressionModel, LinearRegressionModel, RandomForestRegressionModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.operators.ml import CLASSIFICATION, REGRESSION, Baseline, FittedModel
from barloom.operators.research import latest_model

RECORD = """experiment_id string, model_type string, task_type string, target_name string, seed long, feature_names array<string>,
scaling map<string, struct<mean: double, deviation: double>>, params string, baseline string,
periods map<string, struct<start: timestamp_ntz, end: timestamp_ntz, rows: long>>, versions map<string, string>,
metrics map<string, map<string, double>>, created_at timestamp"""

_CLASSES = {
    ("logistic_regression", CLASSIFICATION): LogisticRegressionModel, ("ridge_regression", REGRESSION): LinearRegressionModel,
    ("random_forest", CLASSIFICATION): RandomForestClassificationModel, ("random_forest", REGRESSION): RandomForestRegressionModel,
    **{(kind, CLASSIFICATION): GBTClassificationModel for kind in ("lightgbm", "xgboost")},
    **{(kind, REGRESSION): GBTRegressionModel for kind in ("lightgbm", "xgboost")},
}


def fold_periods(folded: DataFrame) -> dict:
    """First and last instant and row count per fold."""
    found = folded.groupBy("fold").agg(F.min("timestamp").alias("start"), F.max("timestamp").alias("end"), F.count(F.lit(1)).alias("rows"))
    return {r["fold"]: (r["start"], r["end"], r["rows"]) for r in found.collect()}  # a handful of folds


@dataclass(frozen=True)
class ModelStore:
    spark: SparkSession
    root: str

    def save(self, model: FittedModel, model_type: str, target: str, seed: int, params: dict | None = None,
             periods: dict | None = None, metrics: DataFrame | None = None) -> str:
        """Keep a model and its record; returns the new experiment id. `metrics` is long (fold, metric, value)."""
        name = f"{model_type}_{target}_{uuid.uuid4().hex[:12]}"
        baseline = None
        if isinstance(model.model, Baseline):
            baseline = json.dumps(asdict(model.model))
        else:
            model.model.write().save(self._weights(name))
        values: dict[str, dict[str, float]] = {}
        for row in metrics.select("fold", "metric", "value").collect() if metrics is not None else []:  # folds x metrics
            values.setdefault(row["fold"], {})[row["metric"]] = row["value"]
        record = (name, model_type, model.task, target, seed, list(model.features), model.scaling, json.dumps(params or {}, sort_keys=True),
                  baseline, periods or {}, {"spark": pyspark.__version__, "python": platform.python_version()}, values,
                  datetime.now(timezone.utc))
        self.spark.createDataFrame([record], RECORD).coalesce(1).write.mode("append").parquet(f"{self.root}/records")
        return name

    def records(self) -> DataFrame:
        """One row per stored model."""
        return self.spark.read.schema(RECORD).parquet(f"{self.root}/records")

    def load(self, experiment_id: str) -> FittedModel:
        """A stored model, ready to predict; raises KeyError if there is no record of it."""
        return self._open(self.records().filter(F.col("experiment_id") == experiment_id), experiment_id)

    def load_latest(self, target: str, model_type: str | None = None) -> FittedModel:
        """The newest model of a type for a target, or the newest of any type where there is none of this."""
        return self._open(latest_model(self.records(), target, model_type), target)

    def _weights(self, name: str) -> str:
        return f"{self.root}/weights/{name}"

    def _open(self, found: DataFrame, wanted: str) -> FittedModel:
        row = found.first()
        if row is None:
            raise KeyError(wanted)
        if row["baseline"] is not None:
            model = Baseline(**json.loads(row["baseline"]))
        else:
            model = _CLASSES[row["model_type"], row["task_type"]].load(self._weights(row["experiment_id"]))
        scaling = {c: (s["mean"], s["deviation"]) for c, s in row["scaling"].items()}
        return FittedModel(model, tuple(row["feature_names"]), row["task_type"], scaling)
