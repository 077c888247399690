"""Model metrics as grouped aggregates over prediction tables."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barloom.operators.order_stats import exact_medians
from barloom.panel import DAILY, running

CLIP = 1e-15
# Fine blocks keep crowded score ranges small; one row per block meets in a task.
SCORE_BLOCKS = 1 << 20


def _ratio(num: Column, den: Column) -> Column:
    return F.when(den > 0, num / den).otherwise(F.lit(0.0))


def classification(df: DataFrame, by, y="y", y_hat="y_hat", p="p") -> DataFrame:
    """Accuracy, precision, recall, F1, Brier score and log loss per group, one aggregation."""
    truth, guess, prob = F.col(y), F.col(y_hat), F.col(p)
    clipped = F.least(F.greatest(prob, F.lit(CLIP)), F.lit(1 - CLIP))
    sums = df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("rows"),
        F.count_if((truth == 1) & (guess == 1)).alias("_tp"),
        F.count_if((truth == 0) & (guess == 1)).alias("_fp"),
        F.count_if((truth == 1) & (guess == 0)).alias("_fn"),
        F.avg((truth == guess).cast("double")).alias("accuracy"),
        F.avg((prob - truth) * (prob - truth)).alias("brier_score"),
        F.avg(-F.when(truth == 1, F.log(clipped)).otherwise(F.log(1 - clipped))).alias("log_loss"),
    )
    tp, fp, fn = F.col("_tp"), F.col("_fp"), F.col("_fn")
    return sums.select(*by, "rows", "accuracy", _ratio(tp, tp + fp).alias("precision"),
                       _ratio(tp, tp + fn).alias("recall"), _ratio(2 * tp, 2 * tp + fp + fn).alias("f1"),
                       "brier_score", "log_loss")


def roc_auc(df: DataFrame, by, y="y", p="p") -> DataFrame:
    """Exact area under the ROC curve per group; missing when only one class occurs.

    Rows are combined per distinct score first. The cumulative negatives below a
    score come from a two-level running sum over score blocks, so one huge group
    is never sorted by one task. Ties count half.
    """
    keys = list(by) or ["_all"]
    base = df if by else df.withColumn("_all", F.lit(0))
    scores = base.groupBy(*keys, F.col(p).alias("_p")).agg(
        F.sum(F.col(y).cast("bigint")).alias("_pos"),
        F.sum(1 - F.col(y).cast("bigint")).alias("_neg"))
    ranked = running(scores, keys, ["_p"], F.floor(F.col("_p") * SCORE_BLOCKS), {"_below": ("sum", "_neg")})
    pos, neg = F.sum("_pos"), F.sum("_neg")
    won = F.sum(F.col("_pos") * (F.col("_below") - F.col("_neg") / 2))
    return ranked.groupBy(*keys).agg(
        F.when((pos > 0) & (neg > 0), won / (pos * neg)).alias("roc_auc")).select(*by, "roc_auc")


def regression(df: DataFrame, by, y="y", y_hat="y_hat") -> DataFrame:
    """MAE, RMSE, R2, share of equal signs and correlation per group.

    The correlation is built from moments: the built-in aggregate fails under
    ANSI rules when one side is constant.
    """
    truth, guess = F.col(y), F.col(y_hat)
    sums = df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("rows"), F.avg(F.abs(truth - guess)).alias("mae"),
        F.avg((truth - guess) * (truth - guess)).alias("_mse"), F.var_pop(truth).alias("_vy"),
        F.stddev_pop(guess).alias("_sg"),
        F.avg((F.signum(truth) == F.signum(guess)).cast("double")).alias("directional_accuracy"),
        F.covar_pop(truth, guess).alias("_cov"),
    )
    return sums.select(
        *by, "rows", "mae", F.sqrt("_mse").alias("rmse"),
        F.when(F.col("_vy") > 0, 1 - F.col("_mse") / F.col("_vy")).alias("r2"), "directional_accuracy",
        F.when((F.col("_vy") > 0) & (F.col("_sg") > 0),
               F.col("_cov") / (F.sqrt("_vy") * F.col("_sg"))).alias("pearson_corr"))


def evaluate(df: DataFrame, task: str, by=("model", "fold"), **columns) -> DataFrame:
    """Metrics of either task in long form: groups, metric, value."""
    if not by:
        return evaluate(df.withColumn("_all", F.lit(0)), task, ["_all"], **columns).drop("_all")
    by = list(by)
    if task == "classification":
        auc = roc_auc(df, by, columns.get("y", "y"), columns.get("p", "p"))
        wide = classification(df, by, **columns).join(auc, by)
        names = ["accuracy", "precision", "recall", "f1", "roc_auc", "brier_score", "log_loss"]
    elif task == "regression":
        wide = regression(df, by, **columns)
        names = ["mae", "rmse", "r2", "directional_accuracy", "pearson_corr"]
    else:
        raise ValueError(f"unknown task {task}")
    return wide.unpivot(by, names, "metric", "value")


def class_prior(df: DataFrame, by, y="y") -> DataFrame:
    """Share of ones and majority class per group."""
    return df.groupBy(*by).agg(F.avg(F.col(y)).alias("prior")).withColumn(
        "majority", (F.col("prior") >= 0.5).cast("int"))


def mean_median(df: DataFrame, by, y="y", grain: str = DAILY) -> DataFrame:
    """Mean and exact median per group; groups of a finer grain than days may have any size."""
    if grain == DAILY:
        return df.groupBy(*by).agg(F.avg(y).alias("mean"), F.percentile(y, F.lit(0.5)).alias("median"))
    medians = exact_medians(df, by, [y]).select(*[F.col(k).alias(f"_k_{k}") for k in by], F.col(f"{y}_median").alias("median"))
    same = reduce(and_, [F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in by])
    return df.groupBy(*by).agg(F.avg(y).alias("mean")).join(medians, same, "left").select(*by, "mean", "median")
