"""Performance and trade statistics over equity curves and trades, keyed by run."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barloom.operators.normalize import latest_per_key
from barloom.panel import DAILY, cumulative

TINY = 1e-8


def equity_returns(curve: DataFrame, initial: float, grain: str = DAILY) -> DataFrame:
    """Adds `daily_return`; the first row compares with the initial cash."""
    lagged = cumulative(curve, {"_prev": ("prev", "portfolio_equity")}, grain, ["run_id"])
    base = F.coalesce("_prev", F.lit(float(initial)))
    return lagged.withColumn("daily_return", F.when(
        base > 0, (F.col("portfolio_equity") - base) / base).otherwise(0.0)).drop("_prev")


def drawdown_curve(curve: DataFrame, initial: float, grain: str = DAILY) -> DataFrame:
    """Adds the high-water mark, which starts at the initial cash, and the drawdown from it."""
    peaked = cumulative(curve, {"_peak": ("max", "portfolio_equity")}, grain, ["run_id"])
    mark = F.greatest("_peak", F.lit(float(initial)))
    return peaked.withColumn("high_water_mark", mark).withColumn("drawdown", F.when(
        mark > 0, (F.col("portfolio_equity") - mark) / mark).otherwise(0.0)).drop("_peak")


def _safe(num: Column, den: Column, small: float = 0.0) -> Column:
    return F.when(den > small, num / den).otherwise(0.0)


def equity_metrics(curve: DataFrame, initial: float | str, periods: int = 252, risk_free: float = 0.02) -> DataFrame:
    """Return, volatility and drawdown statistics per run in one aggregation.

    `curve` needs portfolio_equity, daily_return, drawdown and gross_exposure. `initial` is the
    cash that all runs start with, or the name of a column that holds each run's own.
    """
    ret = F.col("daily_return")
    losses = F.when(ret < 0, ret)
    start, root = F.col("initial_cash"), math.sqrt(periods)
    sums = curve.groupBy("run_id").agg(
        F.count(F.lit(1)).alias("bars"), F.max_by("portfolio_equity", "timestamp").alias("final_equity"),
        F.stddev_samp("daily_return").alias("_std"), F.min("drawdown").alias("_dd"),
        F.count(losses).alias("_nl"), F.stddev_samp(losses).alias("_sl"), F.min(losses).alias("_l1"),
        F.avg("portfolio_equity").alias("mean_equity"),
        F.avg((F.abs("gross_exposure") > 1e-5).cast("double")).alias("exposure_time_pct"),
        F.max(initial if isinstance(initial, str) else F.lit(float(initial))).alias("initial_cash"))
    final = F.col("final_equity")
    down = (F.when(F.col("_nl") > 1, F.col("_sl")).when(F.col("_nl") == 1, F.abs("_l1")).otherwise(0.0)) * root
    return sums.withColumns({
        "total_return": F.when(start > 0, (final - start) / start).otherwise(0.0),
        "annualized_return": F.when((final > 0) & (start > 0), F.pow(final / start, periods / F.col("bars")) - 1)
        .when(final <= 0, -1.0).otherwise(0.0),
        "volatility": F.when(F.col("bars") > 1, F.col("_std") * root).otherwise(0.0),
        "maximum_drawdown": F.abs("_dd"), "_down": down,
    }).withColumns({
        "sharpe_ratio": _safe(F.col("annualized_return") - risk_free, F.col("volatility"), TINY),
        "sortino_ratio": _safe(F.col("annualized_return") - risk_free, F.col("_down"), TINY),
    }).drop("_std", "_dd", "_nl", "_sl", "_l1", "_down")


def trade_metrics(trades: DataFrame) -> DataFrame:
    """Win, loss and fee statistics per run in one aggregation."""
    net = F.col("net_pnl")
    wins, losses = F.when(net > 0, net), F.when(net < 0, net)
    sums = trades.groupBy("run_id").agg(
        F.count(F.lit(1)).alias("trade_count"), F.count(wins).alias("win_count"),
        F.count(losses).alias("loss_count"), F.coalesce(F.sum(wins), F.lit(0.0)).alias("gross_profit"),
        F.coalesce(-F.sum(losses), F.lit(0.0)).alias("gross_loss"),
        F.sum("total_fees").alias("total_fees"), F.sum("net_pnl").alias("net_profit"),
        F.sum((F.col("entry_price") + F.col("exit_price")) * F.col("quantity")).alias("traded_value"))
    gain, loss = F.col("gross_profit"), F.col("gross_loss")
    return sums.withColumns({
        "win_rate": _safe(F.col("win_count"), F.col("trade_count")),
        "average_win": _safe(gain, F.col("win_count")), "average_loss": -_safe(loss, F.col("loss_count")),
        # No losses: infinite, stored as missing.
        "profit_factor": F.when(loss > TINY, gain / loss).when(gain > TINY, F.lit(None)).otherwise(0.0),
    })


TRADE_DEFAULTS = ("trade_count", "win_count", "loss_count", "gross_profit", "gross_loss", "total_fees",
                  "net_profit", "win_rate", "average_win", "average_loss")


def perf_metrics(curve: DataFrame, trades: DataFrame, initial: float | str, periods: int = 252,
                 risk_free: float = 0.02) -> DataFrame:
    """The 21 run statistics: one aggregation over the curve, one over the trades, one join."""
    joined = equity_metrics(curve, initial, periods, risk_free).join(trade_metrics(trades), "run_id", "left")
    idle = F.col("trade_count").isNull()
    filled = joined.withColumns(
        {"profit_factor": F.when(idle, 0.0).otherwise(F.col("profit_factor")),
         "turnover": _safe(F.coalesce("traded_value", F.lit(0.0)), 2 * F.col("mean_equity"), TINY)}
        | {c: F.coalesce(c, F.lit(0)) for c in TRADE_DEFAULTS})
    return filled.select(
        "run_id", "total_return", "annualized_return", "volatility", "maximum_drawdown", "sharpe_ratio",
        "sortino_ratio", "win_rate", "average_win", "average_loss", "profit_factor", "turnover", "trade_count",
        "win_count", "loss_count", "total_fees", "gross_profit", "gross_loss", "net_profit",
        "exposure_time_pct", "initial_cash", "final_equity")


def exit_reason_mix(trades: DataFrame, *by: str) -> DataFrame:
    return trades.groupBy(*by, "exit_reason").agg(
        F.count(F.lit(1)).alias("trades"), F.sum("net_pnl").alias("net_pnl"))


def recent_trades(trades: DataFrame, rows: int = 5) -> DataFrame:
    """Last trades of each run."""
    return latest_per_key(trades, ["run_id"], [F.desc("exit_time"), F.desc("trip")], rows)


def leaderboard(metrics: DataFrame, runs: DataFrame, name: str | None = None, rows: int = 20) -> DataFrame:
    """Runs with their metrics, newest first, optionally only those whose id contains `name`."""
    found = metrics.join(runs, "run_id")
    if name:
        found = found.filter(F.lower("run_id").contains(name.lower()))
    return found.orderBy(F.desc("created_at"), "run_id").limit(rows)
