"""Questions to the experiment and run tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.operators.normalize import latest_per_key


def experiments(table: DataFrame, text: str | None = None) -> DataFrame:
    """Experiments with their metrics as columns; `table` is long (experiment_id, metric, value)."""
    found = table if not text else table.filter(F.lower("experiment_id").contains(text.lower()))
    names = ("accuracy", "f1", "roc_auc", "brier_score")
    return found.groupBy("experiment_id").agg(
        *[F.max(F.when(F.col("metric") == m, F.col("value"))).alias(m) for m in names],
        F.count(F.lit(1)).alias("metrics"))


def compare_experiments(table: DataFrame, a: str, b: str, digits: int = 5) -> DataFrame:
    """Metrics of two experiments side by side with the difference."""
    def side(name, out):
        return table.filter(F.col("experiment_id") == name).select("metric", F.col("value").alias(out))

    return side(a, "value_a").join(side(b, "value_b"), "metric", "full_outer").withColumn(
        "delta", F.round(F.col("value_a") - F.col("value_b") + 1.3e-9, digits))


def latest_model(models: DataFrame, target: str, model_type: str | None = None) -> DataFrame:
    """Newest model of the wanted type for a target, else the newest of any type."""
    wanted = F.lit(0) if model_type is None else F.when(F.col("model_type") == model_type, 0).otherwise(1)
    return latest_per_key(models.filter(F.col("target_name") == target).withColumn("_w", wanted),
                          ["target_name"], [F.asc("_w"), F.desc("created_at"), F.asc("experiment_id")]).drop("_w")


def runs(metrics: DataFrame, catalog: DataFrame, name: str | None = None) -> DataFrame:
    """Runs newest first with trade counts and returns."""
    found = metrics.join(catalog, "run_id")
    if name:
        found = found.filter(F.lower("run_id").contains(name.lower()))
    return found.orderBy(F.desc("created_at"), F.asc("run_id"))


def evidence_bundle(experiment_table: DataFrame, run_table: DataFrame, bars: DataFrame, top: int = 3) -> DataFrame:
    """Best experiments, best runs and data set summary as (kind, name, value) rows."""
    best = experiment_table.orderBy(F.desc_nulls_last("accuracy"), "experiment_id").limit(top).select(
        F.lit("experiment").alias("kind"), F.col("experiment_id").alias("name"), F.col("accuracy").alias("value"))
    strong = run_table.orderBy(F.desc_nulls_last("win_rate"), "run_id").limit(top).select(
        F.lit("run").alias("kind"), F.col("run_id").alias("name"), F.col("win_rate").alias("value"))
    data = bars.agg(F.count(F.lit(1)).cast("double").alias("value")).select(
        F.lit("dataset").alias("kind"), F.lit("bars").alias("name"), "value")
    return best.unionByName(strong).unionByName(data)
