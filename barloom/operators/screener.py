"""One row per symbol: quote, risk regime, confluence score and trade plan.

Statistics run over the whole history of a symbol, as daily bars; where an answer
needs the newest rows alone, `recent` cuts them by a rank limit that Spark also
applies before the shuffle.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.operators.ml import uncertainty

MIN_HISTORY = 30
ROOT_YEAR = math.sqrt(252)


def recent(bars: DataFrame, depth: int | None = None) -> DataFrame:
    """Bars per symbol, or the last `depth` of them, with `age` (0 = newest), previous close and return."""
    newest = Window.partitionBy("symbol").orderBy(F.desc("timestamp"))
    cut = bars.withColumn("_rank", F.row_number().over(newest))
    if depth is not None:
        cut = cut.filter(F.col("_rank") <= depth)
    aged = cut.withColumn("age", F.col("_rank") - 1).drop("_rank")
    back = Window.partitionBy("symbol").orderBy(F.desc("timestamp"))
    return aged.withColumn("prev_close", F.lead("close", 1).over(back)).withColumn(
        "ret", F.when(F.col("prev_close") != 0, F.col("close") / F.col("prev_close") - 1))


def latest_quote(bars: DataFrame, spread_bps: float = 2.5) -> DataFrame:
    """Last bar with change against the previous close and a synthetic bid and ask."""
    rows = recent(bars, 2).filter("age = 0")
    half, prev = spread_bps / 10_000, F.coalesce("prev_close", "close")
    return rows.select(
        "symbol", "timestamp", "open", "high", "low", "close", "volume", prev.alias("prev_close"),
        (F.col("close") - prev).alias("change"),
        F.when(prev != 0, (F.col("close") - prev) / prev * 100).otherwise(0.0).alias("change_pct"),
        (F.col("close") * (1 - half)).alias("bid"), (F.col("close") * (1 + half)).alias("ask"))


def regime(volatility: Column) -> Column:
    return (F.when(volatility < 0.15, "LOW").when(volatility < 0.28, "NORMAL")
            .when(volatility < 0.45, "HIGH").otherwise("EXTREME"))


def _ema(span: int) -> Column:
    """Recursive average at the newest bar as a weighted sum; the oldest bar is the seed."""
    alpha = 2.0 / (span + 1)
    weight = F.pow(F.lit(1 - alpha), F.col("age"))
    seed = F.col("age") == F.col("_bars") - 1
    return F.sum(F.col("close") * weight * F.when(seed, 1.0).otherwise(alpha))


def indicators(bars: DataFrame, horizon: int = 5) -> DataFrame:
    """All per-symbol statistics of the screener in one aggregation."""
    aged = recent(bars)
    rows = aged.withColumn("_bars", F.count(F.lit(1)).over(Window.partitionBy("symbol")))
    step = F.col("close") - F.col("prev_close")
    month, fortnight = F.col("age") < 20, (F.col("age") < 14) & F.col("prev_close").isNotNull()
    true_range = F.greatest(F.col("high") - F.col("low"), F.abs(F.col("high") - F.col("prev_close")),
                            F.abs(F.col("low") - F.col("prev_close")))
    newest = F.col("age") == 0
    monthly = F.when(month, F.col("ret"))
    out = rows.groupBy("symbol").agg(
        F.max("_bars").alias("bars"), F.max(F.when(newest, F.col("timestamp"))).alias("timestamp"),
        F.max(F.when(newest, F.col("close"))).alias("price"),
        F.max(F.when(newest, F.col("volume"))).alias("_vol"),
        _ema(9).alias("ema_9"), _ema(21).alias("ema_21"),
        F.avg(F.when(fortnight, F.greatest(step, F.lit(0.0)))).alias("_gain"),
        F.avg(F.when(fortnight, F.greatest(-step, F.lit(0.0)))).alias("_loss"),
        F.avg(F.when(fortnight, true_range)).alias("_atr"),
        F.min(F.when(month, F.col("low"))).alias("support"),
        F.max(F.when(month, F.col("high"))).alias("resistance"),
        F.avg(F.when(month, F.col("volume"))).alias("_avg_vol"),
        F.count(monthly).alias("_nr"), F.stddev_samp(monthly).alias("_sd"),
        F.percentile(monthly, F.lit(0.05)).alias("_q05"))
    price = F.col("price")
    vol = F.when(F.col("_nr") > 1, F.col("_sd")).otherwise(0.01) * ROOT_YEAR
    return out.select(
        "symbol", "timestamp", "bars", "price", "ema_9", "ema_21",
        (100 - 100 / (1 + F.coalesce("_gain", F.lit(0.0)) / (F.coalesce("_loss", F.lit(0.0)) + 1e-9))).alias("rsi_14"),
        F.greatest(F.coalesce(F.col("_atr"), price * 0.015), price * 0.005).alias("atr_14"),
        "support", "resistance", (F.col("_vol") / (F.col("_avg_vol") + 1e-9)).alias("volume_ratio"),
        vol.alias("annual_volatility"), regime(vol).alias("vol_regime"),
        (F.abs(F.when(F.col("_nr") >= 10, F.col("_q05")).otherwise(-0.02)) * math.sqrt(horizon)).alias("var_horizon"),
        F.when(F.col("bars") < MIN_HISTORY, "INSUFFICIENT_EVIDENCE").otherwise("VALIDATED").alias("status"))


def confluence(table: DataFrame, model_p: str | None = None) -> DataFrame:
    """Adds four evidence scores, the bullish probability and the action."""
    price, rsi, ratio = F.col("price"), F.col("rsi_14"), F.col("volume_ratio")
    fast, slow = F.col("ema_9"), F.col("ema_21")
    span = F.greatest(F.col("resistance") - F.col("support"), F.col("atr_14"))
    scored = table.withColumns({
        "trend_score": F.when((price >= slow) & (fast >= slow), 18.0)
        .when((price < slow) & (fast < slow), -18.0).otherwise(4.0),
        "rsi_score": F.when(rsi.between(45, 65), 16.0).when(rsi < 35, 14.0).when(rsi > 72, -15.0).otherwise(6.0),
        "volume_score": F.when(ratio >= 1.15, 14.0).when(ratio >= 0.85, 10.0).otherwise(2.0),
        "structure_score": F.when((price - F.col("support")) / span <= 0.65, 12.0).otherwise(-4.0),
    })
    total = 50 + F.col("trend_score") + F.col("rsi_score") + F.col("volume_score") + F.col("structure_score")
    technical = F.least(F.lit(88.0), F.greatest(F.lit(18.0), total)) / 100
    p = technical if model_p is None else F.when(
        F.col(model_p).isNotNull(), 0.5 * F.col(model_p) + 0.5 * technical).otherwise(technical)
    return scored.withColumn("probability_up", p).withColumns({
        "action": F.when(p >= 0.52, "BUY").otherwise("SELL"),
        "confluence_pct": F.greatest(p, 1 - p) * 100,
        "uncertainty": uncertainty(p)})


def _cents(x: Column) -> Column:
    return F.round(x + 1.3e-9, 2)


def trade_plan(scored: DataFrame) -> DataFrame:
    """Adds setup, entry zone, stop and two targets for the chosen action."""
    price, atr, buy = F.col("price"), F.col("atr_14"), F.col("action") == "BUY"
    side = F.when(buy, 1.0).otherwise(-1.0)
    stop = F.when(buy, F.greatest(price - 1.5 * atr, F.col("support") - 0.1 * atr)).otherwise(
        F.least(price + 1.5 * atr, F.col("resistance") + 0.1 * atr))
    setup = (F.when(buy & (F.col("rsi_14") < 38), "rebound").when(buy & (price >= F.col("resistance") * 0.985), "breakout")
             .when(buy, "pullback").when(F.col("rsi_14") > 70, "reversal").otherwise("defensive"))
    planned = scored.withColumns({
        "setup": setup,
        "grade": F.when(setup.isin("rebound", "breakout", "reversal"), "A").when(buy, "A-").otherwise("B"),
        "entry_low": _cents(price - atr * F.when(buy, 0.25).otherwise(0.10)),
        "entry_high": _cents(price + atr * F.when(buy, 0.10).otherwise(0.25)),
        "stop_loss": _cents(stop),
    }).withColumn("risk", F.greatest((price - F.col("stop_loss")) * side, F.lit(0.01)))
    return planned.withColumns({
        "target_1": _cents(price + side * 2.0 * F.col("risk")),
        "target_2": _cents(price + side * 3.5 * F.col("risk"))})


def trigger_state(planned: DataFrame) -> DataFrame:
    """Adds where the price stands against the plan and how far it is from the entry zone."""
    price, buy = F.col("price"), F.col("action") == "BUY"
    low, high, stop = F.col("entry_low"), F.col("entry_high"), F.col("stop_loss")
    broken = F.when(buy, price < stop).otherwise(price > stop)
    away = F.when(buy, price > high).otherwise(price < low)
    state = (F.when(broken, "INVALIDATED").when(price.between(low, high), "TRIGGERED")
             .when(away, "ARMED").otherwise("SCANNING"))
    # A broken buy is measured from the zone's low end, a broken sale from its high end.
    gap = (F.when(broken & buy, price - low).when(broken, price - high)
           .when(away & buy, price - high).when(away, low - price))
    return planned.withColumn("trigger_state", state).withColumn(
        "distance_pct", F.when(F.col("trigger_state").isin("INVALIDATED", "ARMED"), gap / price * 100).otherwise(0.0))


def risk_rating(vol_regime: Column, p: Column | None = None, test_samples: Column | None = None) -> Column:
    """Rating from regime, forecast uncertainty and sample size, or from the regime alone."""
    if p is None:
        return F.when(vol_regime.isin("LOW", "NORMAL"), "MODERATE").otherwise("HIGH")
    u = uncertainty(p)
    return (F.when(test_samples < 10, "INSUFFICIENT EVIDENCE")
            .when((vol_regime == "EXTREME") | (u > 0.85), "VERY HIGH")
            .when((vol_regime == "HIGH") | (u > 0.60), "HIGH")
            .when((vol_regime == "NORMAL") & (u < 0.40), "LOW").otherwise("MODERATE"))


def direction(p: Column) -> Column:
    return F.when(p >= 0.55, "UPWARD").when(p <= 0.45, "DOWNWARD").otherwise("NEUTRAL")


def screen(bars: DataFrame, horizon: int = 5) -> DataFrame:
    """The whole screener table."""
    return trigger_state(trade_plan(confluence(indicators(bars, horizon)))).withColumn(
        "risk_rating", risk_rating(F.col("vol_regime")))


def score_latest(features: DataFrame, model, columns, minimum: float = 0.7) -> DataFrame:
    """Model output on the last feature row per symbol.

    A symbol needs `minimum` of the features; missing ones count as zero.
    """
    newest = Window.partitionBy("symbol").orderBy(F.desc("timestamp"))
    last = features.withColumn("_r", F.row_number().over(newest)).filter("_r = 1").drop("_r")
    present = sum((F.col(c).isNotNull().cast("int") for c in columns), F.lit(0))
    usable = last.filter(present >= minimum * len(columns)).fillna(0.0, subset=list(columns))
    scored = model.predict(usable)
    p = F.col("p") if "p" in scored.columns else 1 / (1 + F.exp(-F.col("y_hat")))
    return scored.select("symbol", "timestamp", p.alias("probability_up"), direction(p).alias("direction"))
