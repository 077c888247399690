"""Chronological splits and walk-forward folds.

Cut positions follow from the length of each series, so they are columns, and a
row finds its folds by arithmetic instead of a join.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.operators.order_stats import exact_medians
from barloom.panel import DAILY, cumulative, grain_block, row_index, series_index

MIN_ROWS = 3


def check_ratios(train: float, val: float, test: float) -> None:
    if abs(train + val + test - 1.0) > 1e-5:
        raise ValueError("split ratios must sum to 1")
    if train <= 0 or test <= 0:
        raise ValueError("train and test ratios must be positive")


def _fold(position, total, train, val, gap):
    """Fold name of a zero-based position in a series of `total` rows."""
    cut = F.floor(total * F.lit(train))
    stop = F.floor(total * F.lit(train + val))
    purged_val = (stop - cut > gap) & (position >= stop - gap) if gap else F.lit(False)
    return (F.when(total < MIN_ROWS, F.lit("insufficient"))
            .when(position < F.greatest(cut - gap, F.lit(1)), F.lit("train"))
            .when(position >= stop, F.lit("test"))
            .when((position >= cut) & ~purged_val, F.lit("validation"))
            .otherwise(F.lit("purged")))


def split_by_ratio(df: DataFrame, train: float = 0.6, val: float = 0.2, test: float = 0.2,
                   gap: int = 0, grain: str = DAILY) -> DataFrame:
    """Adds `fold` by position in each symbol's own history; rows before a cut are purged."""
    check_ratios(train, val, test)
    indexed = series_index(df, grain)
    return indexed.select(*df.columns, _fold(F.col("n") - 1, F.col("total"), train, val, gap).alias("fold"))


def split_by_date(df: DataFrame, train_end: str, val_end: str | None = None,
                  train_start: str | None = None, gap: int = 0, grain: str = DAILY) -> DataFrame:
    """Adds `fold` by inclusive cut dates; the last `gap` rows of train and validation are purged.

    Purging compares a row's position in its symbol's fold with the fold's length.
    """
    kind = df.schema["timestamp"].dataType.simpleString()
    ts, end = F.col("timestamp"), F.lit(train_end).cast(kind)
    fold = F.when(ts <= end, F.lit("train"))
    if train_start is not None:
        fold = F.when(ts < F.lit(train_start).cast(kind), F.lit("unused")).when(ts <= end, F.lit("train"))
    if val_end is not None:
        fold = fold.when(ts <= F.lit(val_end).cast(kind), F.lit("validation"))
    out = df.withColumn("fold", fold.otherwise(F.lit("test")))
    if not gap:
        return out
    placed = series_index(out, grain, ["symbol", "fold"])
    late = F.col("fold").isin("train", "validation") & (F.col("total") > gap) & (F.col("n") > F.col("total") - gap)
    return placed.select(*df.columns, F.when(late, F.lit("purged")).otherwise(F.col("fold")).alias("fold"))


def panel_split(df: DataFrame, train: float = 0.6, val: float = 0.2, test: float = 0.2,
                gap: int = 0, grain: str = DAILY) -> DataFrame:
    """Adds `fold` by position in the common calendar, so all symbols share the cut dates."""
    check_ratios(train, val, test)
    dates = df.select("timestamp").distinct().withColumn("_all", F.lit(0))
    ranked = row_index(dates, ["_all"], ["timestamp"], grain_block(grain))
    total = dates.groupBy("_all").agg(F.count(F.lit(1)).alias("total"))
    folds = ranked.join(total, "_all").select(
        "timestamp", _fold(F.col("n") - 1, F.col("total"), train, val, gap).alias("fold"))
    return df.join(folds, "timestamp").select(*df.columns, "fold")


def split_summary(df: DataFrame, *by: str) -> DataFrame:
    return df.groupBy(*by, "fold").agg(
        F.count(F.lit(1)).alias("rows"), F.min("timestamp").alias("start"),
        F.max("timestamp").alias("end"))


@dataclass(frozen=True)
class WalkForward:
    n_folds: int = 5
    min_train: int = 100
    gap: int = 5
    test_size: int | None = None
    train_size: int | None = None
    expanding: bool = True

    def bounds(self, total, fold):
        """(train_start, train_end, test_start, test_end) columns of a fold; ends are exclusive."""
        if self.test_size is not None:
            size = F.lit(self.test_size)
        else:
            size = F.greatest(F.lit(10), F.floor(
                (total - self.min_train - self.gap) / F.lit(self.n_folds)))
        test_end = total - (F.lit(self.n_folds - 1) - fold) * size
        test_start = test_end - size
        train_end = test_start - self.gap
        train_start = F.lit(0) if self.expanding else F.greatest(
            F.lit(0), train_end - (self.train_size or self.min_train))
        return train_start, train_end, test_start, test_end

    def folds(self, df: DataFrame) -> DataFrame:
        """One row per usable fold; `df` must have `total`."""
        total, fold = F.col("total"), F.col("fold_idx")
        start, train_end, test_start, test_end = self.bounds(total, fold)
        return (
            df.withColumn("fold_idx", F.explode(F.sequence(F.lit(0), F.lit(self.n_folds - 1))))
            .withColumns({"train_start": start.cast("bigint"), "train_end": train_end,
                          "test_start": test_start, "test_end": test_end})
            .filter((total >= self.min_train + self.gap + 10)
                    & (F.col("test_start") >= self.min_train + self.gap)
                    & (F.col("train_end") - F.col("train_start") >= self.min_train))
        )


def wf_windows(df: DataFrame, config: WalkForward) -> DataFrame:
    """Fold boundaries per symbol."""
    totals = df.groupBy("symbol").agg(F.count(F.lit(1)).alias("total"))
    return config.folds(totals).select("symbol", "fold_idx", "train_start", "train_end",
                                       "test_start", "test_end")


def fold_rows(df: DataFrame, config: WalkForward, grain: str = DAILY) -> DataFrame:
    """Rows of every fold with `part` train or test; a row appears once per fold it is in."""
    placed = config.folds(series_index(df, grain))
    pos = F.col("n") - 1
    part = (F.when((pos >= F.col("train_start")) & (pos < F.col("train_end")), F.lit("train"))
            .when((pos >= F.col("test_start")) & (pos < F.col("test_end")), F.lit("test")))
    return placed.withColumn("part", part).filter(F.col("part").isNotNull()).select(
        *df.columns, "fold_idx", "part")


def fold_medians(rows: DataFrame, columns, grain: str = DAILY) -> DataFrame:
    """Exact training medians per symbol and fold; folds without a training value in any column may be absent."""
    train = rows.filter(F.col("part") == "train")
    if grain != DAILY:
        return exact_medians(train, ["symbol", "fold_idx"], columns)
    return train.groupBy("symbol", "fold_idx").agg(
        *[F.percentile(c, F.lit(0.5)).alias(f"{c}_median") for c in columns])


def wf_impute(rows: DataFrame, columns, grain: str = DAILY) -> DataFrame:
    """Test rows filled forward inside their fold, then with training medians, then with zero."""
    test = cumulative(rows.filter(F.col("part") == "test"), {f"_f_{c}": ("last", c) for c in columns}, grain,
                      ("symbol", "fold_idx"))
    filled = test.join(fold_medians(rows, columns, grain), ["symbol", "fold_idx"], "left")
    return filled.select(
        *[c for c in rows.columns if c not in columns],
        *[F.coalesce(f"_f_{c}", f"{c}_median", F.lit(0.0)).alias(c) for c in columns])


def train_rows(rows: DataFrame, columns, minimum: int = 10) -> DataFrame:
    """Complete training rows of the folds that have at least `minimum` of them."""
    complete = rows.filter(F.col("part") == "train").dropna(subset=list(columns))
    enough = complete.groupBy("symbol", "fold_idx").agg(F.count(F.lit(1)).alias("_c")).filter(
        F.col("_c") >= minimum)
    return complete.join(enough.drop("_c"), ["symbol", "fold_idx"], "left_semi")
