"""Walk-forward evaluation: folds on one calendar, back-tests whose equity is carried from fold to fold.

All symbols share the folds' dates, so no training row of any symbol lies behind a test row's
date. Each fold starts flat with the equity that the fold before ended with; its high-water mark
starts there, too. Everything is keyed by (symbol, fold); the carry is a product over the few folds of a symbol.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from barloom.operators.performance import perf_metrics
from barloom.operators.signals import Costs, held_bars, round_trips, sell_price, signal_equity
from barloom.operators.splits import WalkForward
from barloom.panel import DAILY, cumulative, cut, grain_block, row_index

FOLD_KEYS = ("symbol", "fold_idx")
SUMMARY = ["run_id", "fold", "train_bars", "purge_gap", "test_bars", "test_start", "test_end", "total_return", "annualized_return",
           "sharpe_ratio", "max_drawdown", "win_rate", "profit_factor", "trade_count"]


def calendar_folds(df: DataFrame, config: WalkForward, grain: str = DAILY) -> DataFrame:
    """(timestamp, fold_idx, part) for every date of the folds; positions count the distinct dates of all symbols."""
    dates = df.select("timestamp").distinct().withColumn("_all", F.lit(0))
    placed = row_index(dates, ["_all"], ["timestamp"], grain_block(grain))
    total = dates.groupBy("_all").agg(F.count(F.lit(1)).alias("total"))          # one row
    folds = config.folds(placed.join(F.broadcast(total), "_all"))
    pos = F.col("n") - 1
    part = (F.when((pos >= F.col("train_start")) & (pos < F.col("train_end")), F.lit("train"))
            .when((pos >= F.col("test_start")) & (pos < F.col("test_end")), F.lit("test")))
    return folds.withColumn("part", part).filter(F.col("part").isNotNull()).select("timestamp", "fold_idx", "part")


def calendar_fold_rows(df: DataFrame, config: WalkForward, grain: str = DAILY) -> DataFrame:
    """Rows of every fold with `part` train or test; a row appears once per fold it is in.

    The gap between the last training date and the first test date is `config.gap` dates for all symbols.
    """
    return df.join(calendar_folds(df, config, grain), "timestamp").select(*df.columns, "fold_idx", "part")


def fold_positions(test: DataFrame, enter: float, leave: float, costs: Costs = Costs(), grain: str = DAILY) -> DataFrame:
    """`held_bars` of every (symbol, fold), each starting flat; `closing` marks a last bar that ends in a position."""
    held = held_bars(test, enter, leave, costs, grain=grain, keys=FOLD_KEYS)
    lasts = held.groupBy(*FOLD_KEYS).agg(F.max("n").alias("_last"))
    return held.join(lasts, list(FOLD_KEYS)).withColumn("closing", (F.col("n") == F.col("_last")) & (F.col("held") == 1)).drop("_last")


def carried_curve(positions: DataFrame, initial: float, costs: Costs = Costs(), fraction: float = 1.0, grain: str = DAILY) -> DataFrame:
    """Equity of each run (symbol) over all folds, continued from fold to fold.

    An open position is sold at the close of the fold's last bar, with slippage and commission, in that bar's
    return. `start_equity` is what the fold begins with; drawdowns count from the fold's own high-water mark.
    """
    sold = sell_price(F.col("close"), F.col("low"), costs) / F.col("close") * (1 - costs.commission)
    grown = signal_equity(positions, costs, fraction, grain, FOLD_KEYS, F.when(F.col("closing"), sold).otherwise(1.0))
    ends = grown.groupBy(*FOLD_KEYS).agg(F.max_by("log_equity", "n").alias("_own"))
    before = Window.partitionBy("symbol").orderBy("fold_idx").rowsBetween(Window.unboundedPreceding, -1)
    starts = ends.select(*FOLD_KEYS, (float(initial) * F.exp(F.coalesce(F.sum("_own").over(before), F.lit(0.0)))).alias("start_equity"))
    curve = grown.join(starts, list(FOLD_KEYS)).withColumn("portfolio_equity", F.col("start_equity") * F.col("equity"))
    peaked = cumulative(curve, {"_peak": ("max", "portfolio_equity")}, grain, FOLD_KEYS)
    mark = F.greatest("_peak", "start_equity")
    exposed = F.when(F.col("closing"), 0.0).otherwise(F.col("held") * F.col("portfolio_equity") * fraction)
    return peaked.select(F.col("symbol").alias("run_id"), "fold_idx", "timestamp", "start_equity", "portfolio_equity", "daily_return",
                         exposed.alias("gross_exposure"), mark.alias("high_water_mark"), ((F.col("portfolio_equity") - mark) / mark).alias("drawdown"))


def fold_equity(curve: DataFrame) -> DataFrame:
    """Bars, first and last equity of each fold; a fold starts with what the one before ended with."""
    return curve.groupBy("run_id", "fold_idx").agg(
        F.count(F.lit(1)).alias("bars"), F.max("start_equity").alias("start_equity"), F.max_by("portfolio_equity", "timestamp").alias("final_equity"))


def wf_summary(curve: DataFrame, trades: DataFrame, train: DataFrame, initial: float, gap: int) -> DataFrame:
    """One row per run and fold and an OVERALL row per run, with the columns of `SUMMARY`.

    `curve` is a `carried_curve`, `trades` carries run_id and fold_idx, `train` has a row (run_id, fold_idx, train_bars)
    per fold. A fold's returns are relative to its start equity, those of OVERALL to `initial`.
    """
    both = F.explode(F.array(F.col("fold_idx").cast("string"), F.lit("OVERALL")))
    key = F.to_json(F.struct("run_id", "fold"))

    def labelled(df):
        return df.withColumn("fold", both)

    points = labelled(curve).withColumn("_initial", F.when(F.col("fold") == "OVERALL", float(initial)).otherwise(F.col("start_equity")))
    points = points.withColumns({"_run": F.col("run_id"), "run_id": key})
    metrics = perf_metrics(points, labelled(trades).withColumn("run_id", key), "_initial")
    spans = points.groupBy("run_id").agg(F.first("_run").alias("_run"), F.first("fold").alias("fold"), F.count(F.lit(1)).alias("test_bars"),
                                         F.min("timestamp").alias("test_start"), F.max("timestamp").alias("test_end"))
    trained = labelled(train).withColumn("run_id", key).groupBy("run_id").agg(F.sum("train_bars").alias("train_bars"))
    out = metrics.join(spans, "run_id").join(trained, "run_id", "left").withColumns({
        "run_id": F.col("_run"), "train_bars": F.coalesce("train_bars", F.lit(0)), "purge_gap": F.lit(gap), "max_drawdown": F.col("maximum_drawdown")})
    return out.select(*SUMMARY)


def walk_forward(scored: DataFrame, config: WalkForward, enter: float, leave: float, initial: float, costs: Costs = Costs(),
                 fraction: float = 1.0, quantity: float = 100.0, grain: str = DAILY) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(curve, trades, train bars) of scored bars (`p`) back-tested on the test dates of every fold."""
    rows = calendar_fold_rows(scored, config, grain)
    train = rows.filter("part = 'train'").groupBy(F.col("symbol").alias("run_id"), "fold_idx").agg(F.count(F.lit(1)).alias("train_bars"))
    # Curve and trades come from the same positions, so these are written once.
    positions = cut(fold_positions(rows.filter("part = 'test'").drop("part"), enter, leave, costs, grain))
    trades = round_trips(positions, quantity, costs, FOLD_KEYS).withColumnRenamed("symbol", "run_id")
    return carried_curve(positions, initial, costs, fraction, grain), trades, train
