"""Model training and scoring with Spark ML."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark import StorageLevel
from pyspark.ml import Model
from pyspark.ml.classification import GBTClassifier, LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressor, LinearRegression, RandomForestRegressor
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barloom.functions.targets import REGISTRY as TARGETS
from barloom.operators import metrics
from barloom.operators.order_stats import exact_median
from barloom.operators.splits import panel_split
from barloom.panel import cut
from barloom.session import checkpoint_dir

MODEL_TYPES = ("baseline", "logistic_regression", "ridge_regression", "random_forest",
               "lightgbm", "xgboost")
CLASSIFICATION, REGRESSION = "classification", "regression"


def standardize(df: DataFrame, columns, fit_on: Column, by) -> DataFrame:
    """Subtract mean and divide by population deviation of the fitting rows, per group."""
    stats = df.filter(fit_on).groupBy(*by).agg(
        *[F.avg(c).alias(f"_m_{c}") for c in columns],
        *[F.stddev_pop(c).alias(f"_s_{c}") for c in columns])
    joined = df.join(stats, list(by))
    scaled = {c: (F.col(c) - F.col(f"_m_{c}")) / F.when(F.col(f"_s_{c}") > 0, F.col(f"_s_{c}")).otherwise(1.0)
              for c in columns}
    return joined.withColumns(scaled).select(*df.columns)


def check_target(rows: DataFrame, target: str, task: str) -> None:
    """Raise unless the target is complete and, for classification, 0 or 1."""
    found = rows.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col(target).isNull()).alias("missing"),
                     F.count_if(~F.col(target).isin(0, 1)).alias("other")).first()
    if found["n"] == 0:
        raise ValueError("no training rows")
    if found["missing"]:
        raise ValueError(f"target {target} has missing values")
    if task == CLASSIFICATION and found["other"]:
        raise ValueError(f"target {target} is not binary")


def infer_task(rows: DataFrame, target: str) -> tuple[str, int]:
    """(task, purge gap): from the target registry, else from the values."""
    try:
        known = TARGETS.get(target)
        return known.task, known.horizon
    except KeyError:
        other = rows.filter(F.col(target).isNotNull() & ~F.col(target).isin(0, 1)).isEmpty()
        return (CLASSIFICATION if other else REGRESSION), 1


def assemble(rows: DataFrame, features) -> DataFrame:
    """Adds the feature vector; a missing feature is an error at run time."""
    return VectorAssembler(inputCols=list(features), outputCol="features",
                           handleInvalid="error").transform(rows)


def train_stats(rows: DataFrame, target: str):
    return rows.agg(F.count(F.lit(1)).alias("n"), F.avg(target).alias("mean"),
                    F.stddev_pop(target).alias("std")).first()


def create_estimator(model_type: str, task: str, rows: DataFrame, target: str, params=None, seed: int = 42):
    """Spark ML estimator for a model type; both boosting types map to gradient-boosted trees.

    Regularisation is converted from the usual sum-of-losses form to Spark's
    mean-of-losses form, which needs the row count and target deviation.
    """
    p = dict(params or {})
    columns = {"featuresCol": "features", "labelCol": target, "predictionCol": "y_hat"}
    if model_type == "logistic_regression" and task == CLASSIFICATION:
        n = train_stats(rows, target)["n"]
        return LogisticRegression(regParam=1.0 / (p.get("C", 1.0) * n), elasticNetParam=0.0,
                                  maxIter=p.get("max_iter", 1000), standardization=False, **columns)
    if model_type == "ridge_regression" and task == REGRESSION:
        stats = train_stats(rows, target)
        return LinearRegression(solver="normal", standardization=False,
                                regParam=p.get("alpha", 1.0) * (stats["std"] or 1.0) / stats["n"], **columns)
    if model_type == "random_forest":
        make = RandomForestClassifier if task == CLASSIFICATION else RandomForestRegressor
        return make(numTrees=p.get("n_estimators", 100), maxDepth=p.get("max_depth", 5),
                    featureSubsetStrategy="sqrt", seed=seed, **columns)
    if model_type in ("lightgbm", "xgboost"):
        make = GBTClassifier if task == CLASSIFICATION else GBTRegressor
        # Boosting rounds build on each other; cutting lineage goes to shared storage.
        checkpoint_dir(rows.sparkSession)
        return make(maxIter=p.get("n_estimators", 100), stepSize=p.get("learning_rate", 0.05),
                    maxDepth=p.get("max_depth", 4), subsamplingRate=p.get("subsample", 0.8),
                    checkpointInterval=10, seed=seed, **columns)
    raise ValueError(f"unknown model type {model_type} for {task}")


@dataclass
class Baseline:
    """Constant predictor: training prior for classes, zero, mean or median for values.

    `stratified` draws classes from the prior with a seeded random column.
    """

    task: str
    value: float
    strategy: str
    seed: int = 42

    @classmethod
    def fit(cls, rows: DataFrame, target: str, task: str, strategy: str | None = None,
            constant: float = 0.0, seed: int = 42) -> Baseline:
        if task == CLASSIFICATION:
            prior = float(rows.agg(F.avg(target)).first()[0])
            return cls(task, constant if strategy == "constant" else prior, strategy or "majority", seed)
        strategy = strategy or "zero"
        if strategy == "mean":
            value = float(rows.agg(F.avg(target)).first()[0])
        elif strategy == "median":
            value = exact_median(rows, target)
        else:
            value = constant if strategy == "constant" else 0.0
        return cls(task, value, strategy, seed)

    def transform(self, rows: DataFrame) -> DataFrame:
        if self.task == REGRESSION:
            return rows.withColumn("y_hat", F.lit(self.value))
        if self.strategy == "stratified":
            label = (F.rand(self.seed) < self.value).cast("double")
        else:
            label = F.lit(1.0 if self.value >= 0.5 else 0.0)
        return rows.withColumns({"y_hat": label, "p": F.lit(self.value)})


def fit_model(rows: DataFrame, features, target: str, model_type: str, task: str, params=None,
              seed: int = 42, scale: bool = True):
    """Fit on complete rows; linear models see features scaled on these rows."""
    if model_type not in MODEL_TYPES:
        raise ValueError(f"unknown model type {model_type}")
    complete = rows.dropna(subset=[*features, target]).select(*features, target)
    # Iterative fits read the rows many times; lost blocks are rebuilt from the plan.
    complete = complete.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        check_target(complete, target, task)
        if model_type == "baseline":
            return FittedModel(Baseline.fit(complete, target, task, **(params or {})), tuple(features), task, {})
        scaling = {}
        if scale and model_type in ("logistic_regression", "ridge_regression"):
            stats = complete.agg(*[F.avg(c).alias(f"m{i}") for i, c in enumerate(features)],
                                 *[F.stddev_pop(c).alias(f"s{i}") for i, c in enumerate(features)]).first()
            scaling = {c: (stats[f"m{i}"], stats[f"s{i}"] or 1.0) for i, c in enumerate(features)}
        ready = assemble(scale_by(complete, scaling), features)
        model = create_estimator(model_type, task, complete, target, params, seed).fit(ready)
        return FittedModel(model, tuple(features), task, scaling)
    finally:
        complete.unpersist()


def scale_by(rows: DataFrame, scaling: dict) -> DataFrame:
    if not scaling:
        return rows
    return rows.withColumns({c: (F.col(c) - F.lit(m)) / F.lit(s) for c, (m, s) in scaling.items()})


@dataclass
class FittedModel:
    model: Model | Baseline
    features: tuple[str, ...]
    task: str
    scaling: dict

    def predict(self, rows: DataFrame) -> DataFrame:
        """Rows with `y_hat` and, for classification, `p`; feature columns must be complete."""
        absent = [c for c in self.features if c not in rows.columns]
        if absent:
            raise ValueError(f"features not in the table: {absent}")
        if isinstance(self.model, Baseline):
            return self.model.transform(rows)
        originals = rows.withColumns({f"_raw_{c}": F.col(c) for c in self.scaling})
        out = self.model.transform(assemble(scale_by(originals, self.scaling), self.features))
        if self.task == CLASSIFICATION:
            out = out.withColumn("p", vector_to_array("probability").getItem(1))
        restore = [F.col(f"_raw_{c}").alias(c) if c in self.scaling else F.col(c) for c in rows.columns]
        return out.select(*restore, "y_hat", *(["p"] if self.task == CLASSIFICATION else []))

    def importances(self) -> dict[str, float]:
        values = getattr(self.model, "featureImportances", None)
        if values is None:
            coefficients = getattr(self.model, "coefficients", None)
            values = [abs(v) for v in coefficients.toArray()] if coefficients is not None else []
        return dict(zip(self.features, [float(v) for v in (values.toArray() if hasattr(values, "toArray") else values)]))


def fit_experiment(labelled: DataFrame, features, target: str, model_type: str, params=None,
                   seed: int = 42, ratios=(0.6, 0.2, 0.2)) -> tuple[FittedModel, DataFrame]:
    """(model, folded rows): complete rows split on the common calendar, fitted on train."""
    task, gap = infer_task(labelled, target)
    rows = labelled.select("timestamp", "symbol", *features, target).dropna(subset=[*features, target])
    # Read by the fit and by every metric pass.
    folded = cut(panel_split(rows, *ratios, gap=gap))
    model = fit_model(folded.filter("fold = 'train'"), features, target, model_type, task, params, seed)
    return model, folded


def experiment_metrics(model: FittedModel, folded: DataFrame, target: str) -> DataFrame:
    """(fold, metric, value) of every fold."""
    scored = model.predict(folded.filter("fold IN ('train', 'validation', 'test')"))
    return metrics.evaluate(scored, model.task, ["fold"], y=target, y_hat="y_hat",
                            **({"p": "p"} if model.task == CLASSIFICATION else {}))


def run_experiment(labelled: DataFrame, features, target: str, model_type: str, params=None,
                   seed: int = 42, ratios=(0.6, 0.2, 0.2)) -> DataFrame:
    """Split on the common calendar, fit on train, and report metrics of every fold."""
    model, folded = fit_experiment(labelled, features, target, model_type, params, seed, ratios)
    return experiment_metrics(model, folded, target).select(
        F.lit(f"{model_type}_{target}").alias("experiment_id"),
        F.lit(model_type).alias("model_type"), F.lit(target).alias("target_name"),
        F.lit(model.task).alias("task_type"), F.lit(seed).alias("seed"), "fold", "metric", "value")


def compare_models(labelled: DataFrame, features, target: str, model_types, seed: int = 42,
                   params: dict | None = None) -> DataFrame:
    """Metrics of several model types on one target, in one table."""
    labelled = cut(labelled.select("timestamp", "symbol", *features, target))
    out = None
    for kind in model_types:
        one = run_experiment(labelled, features, target, kind, (params or {}).get(kind), seed)
        out = one if out is None else out.unionByName(one)
    return out


def wf_predict(rows: DataFrame, features, target: str, model_type: str, task: str, params=None,
               seed: int = 42) -> DataFrame:
    """Out-of-sample predictions of a walk-forward table (`fold_idx`, `part`), stitched together.

    One fit per fold, seeded with the fold number; `rows` needs imputed test features.
    """
    rows = cut(rows)
    folds = sorted(r[0] for r in rows.select("fold_idx").distinct().collect())  # at most n_folds
    out = None
    for fold in folds:
        part = rows.filter(F.col("fold_idx") == fold)
        model = fit_model(part.filter("part = 'train'"), features, target, model_type, task, params, seed + fold)
        scored = model.predict(part.filter("part = 'test'"))
        out = scored if out is None else out.unionByName(scored)
    return out


def uncertainty(p: Column) -> Column:
    return 1 - 2 * F.abs(p - 0.5)


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))

