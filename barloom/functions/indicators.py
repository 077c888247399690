"""Chart indicators: partial warm-up instead of missing values."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.panel import DAILY, open_frame
from barloom.sources.bars import CHART_PERIODS, resample_bars

# Rows in which the recursion is one weighted sum; powers of the smallest weight (1/3) stay finite.
EMA_BLOCK = 400
_SMALLEST = -330.0     # power of ten below which a weight is no double


def _fold(decay: float):
    return lambda total, last: total * F.lit(decay) + last


def with_ema(df: DataFrame, column: str, spans: dict[str, int], key: str = "symbol",
             index: str = "n") -> DataFrame:
    """Exponential averages of any span from 1, seeded with the first value, as a scan in two levels.

    Inside a block of `EMA_BLOCK` rows the recursion is a weighted running sum. A whole block maps what comes
    before it to decay * before + sum; these pairs are combined over one row per block and joined back. Blocks so far back
    that their weight is below the smallest double are left out, so a block combines a fixed number of pairs.
    """
    if any(span < 1 for span in spans.values()):
        raise ValueError("a span is 1 at least")
    pos = (F.col(index) - 1) % EMA_BLOCK
    inside = Window.partitionBy(key, "_eb").orderBy(index).rowsBetween(Window.unboundedPreceding, 0)
    df = df.withColumns({"_ep": pos, "_eb": F.floor((F.col(index) - 1) / F.lit(EMA_BLOCK))})
    local, plain, carries = {}, {}, {}
    for name, span in spans.items():
        if span == 1:
            plain[name] = F.col(column).cast("double")
            continue
        alpha = 2.0 / (span + 1)
        keep = 1.0 - alpha
        weight = F.when(F.col(index) == 1, F.lit(1.0)).otherwise(F.lit(alpha))
        scaled = F.col(column) * weight * F.pow(F.lit(keep), -F.col("_ep"))
        local[f"_el_{name}"] = F.sum(scaled).over(inside) * F.pow(F.lit(keep), F.col("_ep"))
        decay = keep ** EMA_BLOCK
        reach = 1 if decay == 0.0 else math.ceil(_SMALLEST / math.log10(decay))
        recent = Window.partitionBy(key).orderBy("_eb").rowsBetween(-(reach - 1), 0)
        carries[f"_ec_{name}"] = F.aggregate(F.collect_list(f"_el_{name}").over(recent), F.lit(0.0), _fold(decay))
        plain[name] = F.col(f"_el_{name}") + F.pow(F.lit(keep), F.col("_ep") + 1) * F.coalesce(f"_ec_{name}", F.lit(0.0))
    df = df.withColumns(local)
    if carries:
        ends = df.filter(F.col("_ep") == EMA_BLOCK - 1).select(F.col(key).alias("_ek"), "_eb", *local)
        ends = ends.withColumnRenamed("_ek", key).withColumns(carries).select(key, (F.col("_eb") + 1).alias("_eb"), *carries)
        df = df.join(ends, [key, "_eb"], "left")
    return df.withColumns(plain).drop("_ep", "_eb", *local, *carries)


def rsi(window, column: str = "_step", period: int = 14) -> Column:
    """Simple-mean relative strength; 50 during warm-up or without losses."""
    span = window.rowsBetween(-(period - 1), 0)
    gain = F.avg(F.greatest(F.col(column), F.lit(0.0))).over(span)
    loss = F.avg(F.greatest(-F.col(column), F.lit(0.0))).over(span)
    return F.when((F.col("n") > period) & (loss > 0), 100 - 100 / (1 + gain / loss)).otherwise(50.0)


def candles(bars: DataFrame, digits: int | None = 2, grain: str = DAILY) -> DataFrame:
    """Bars of any grain with moving averages and RSI for charts."""
    frame = open_frame(bars, 50, 0, grain)
    staged = frame.df.withColumn("_step", F.col("close") - F.lag("close", 1).over(frame.window)).withColumns({
        "sma_20": F.avg("close").over(frame.rows(-19, 0)),
        "sma_50": F.avg("close").over(frame.rows(-49, 0)),
        "rsi_14": rsi(frame.window),
    })
    full = with_ema(frame.close(staged), "close", {"ema_20": 20})
    if digits is None:
        return full.select(*bars.columns, "sma_20", "sma_50", "ema_20", "rsi_14")
    two = [F.round(F.col(c) + 1.3e-9, digits).alias(c) for c in ("open", "high", "low", "close")]
    return full.select("timestamp", "symbol", *two, F.col("volume").cast("bigint").alias("volume"),
                       *[F.round(F.col(c) + 1.3e-9, digits).alias(c) for c in ("sma_20", "sma_50", "ema_20")],
                       F.round(F.col("rsi_14") + 1.3e-9, 1).alias("rsi_14"))


def look_back(bars: DataFrame, period: str) -> DataFrame:
    """Bars of the chart period up to each symbol's last bar: so many trading days, or calendar months."""
    _, days, months = CHART_PERIODS[period]
    if months:
        last = bars.groupBy("symbol").agg(F.max("timestamp").alias("_last"))
        since = F.col("_last") - F.make_ym_interval(F.lit(0), F.lit(months))
        return bars.join(last, "symbol").filter(F.col("timestamp") > since).select(*bars.columns)
    dates = bars.select("symbol", F.to_date("timestamp").alias("_date")).distinct()
    newest = Window.partitionBy("symbol").orderBy(F.desc("_date"))
    recent = dates.withColumn("_rank", F.row_number().over(newest)).filter(F.col("_rank") <= days).groupBy("symbol").agg(F.min("_date").alias("_since"))
    return bars.join(recent, "symbol").filter(F.to_date("timestamp") >= F.col("_since")).select(*bars.columns)


def chart(ticks: DataFrame, period: str, symbol: Column, time: Column, price: Column, volume: Column | None, seq: Column,
          digits: int | None = 2) -> DataFrame:
    """Candles of a chart period (1D, 1W, 1M, 3M, 6M, 1Y, 5Y) at its own interval; averages start with the period's first bar."""
    grain = CHART_PERIODS[period][0]
    return candles(look_back(resample_bars(ticks, symbol, time, price, volume, seq, grain), period), digits, grain)
