"""Ticks to open/high/low/close/volume bars."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Chart periods (fixed values): bar interval, trading days, calendar months.
CHART_PERIODS = {
    "1D": ("5 minutes", 1, 0), "1W": ("15 minutes", 5, 0), "1M": ("day", 0, 1), "3M": ("day", 0, 3),
    "6M": ("day", 0, 6), "1Y": ("day", 0, 12), "5Y": ("week", 0, 60),
}

HOT_TICKS = 1 << 18    # ticks of a symbol above which they are combined before they move
TASK_TICKS = 1 << 19   # ticks of a task


def bar_start(time: Column, grain: str) -> Column:
    """Start of the bar an instant belongs to, without a time zone."""
    if grain == "day":
        return F.to_date(time).cast("timestamp_ntz")
    if grain == "week":
        return F.trunc(F.to_date(time), "week").cast("timestamp_ntz")
    width = {"hour": "1 hour"}.get(grain, grain)
    return F.window(time.cast("timestamp_ntz"), width).getField("start")


def resample_bars(ticks: DataFrame, symbol: Column, time: Column, price: Column,
                  volume: Column | None, seq: Column, grain: str = "day", prefix: str = "") -> DataFrame:
    """One bar per symbol and interval.

    Open and close are the prices of the lowest and highest `seq` in the bar;
    `seq` should be a unique bigint, which keeps the aggregation hash-based and
    combinable before the shuffle, so a symbol holding most ticks is reduced
    where it is read. Volume is the tick count when none is given. A numeric
    `symbol` is grouped as a number and becomes text with `prefix` afterwards.
    """
    bars = _combined(_trimmed(ticks, symbol, time, price, volume, seq, grain), volume is not None)
    return named(bars, prefix) if prefix else bars


def _trimmed(ticks: DataFrame, symbol, time, price, volume, seq, grain: str) -> DataFrame:
    return ticks.select(
        symbol.alias("symbol"), (F.to_date(time) if grain == "day" else bar_start(time, grain)).alias("timestamp"),
        price.cast("double").alias("_p"), seq.alias("_s"),
        *([] if volume is None else [volume.cast("double").alias("_v")]),
    )


def _combined(trimmed: DataFrame, with_volume: bool) -> DataFrame:
    vol = F.sum("_v") if with_volume else F.count(F.lit(1)).cast("double")
    return (
        trimmed.groupBy("symbol", "timestamp")
        .agg(F.min_by("_p", "_s").alias("open"), F.max("_p").alias("high"),
             F.min("_p").alias("low"), F.max_by("_p", "_s").alias("close"), vol.alias("volume"))
        .select(F.col("timestamp").cast("timestamp_ntz").alias("timestamp"), "symbol",
                "open", "high", "low", "close", "volume")
    )


def named(bars: DataFrame, prefix: str) -> DataFrame:
    """Numeric symbols become text."""
    return bars.withColumn("symbol", F.concat(F.lit(prefix), F.col("symbol").cast("string")))


def resample_series(ticks: DataFrame, symbol: Column, time: Column, price: Column,
                    volume: Column | None, seq: Column, grain: str = "day",
                    hot_ticks: int = HOT_TICKS, task_ticks: int = TASK_TICKS) -> tuple[DataFrame, int]:
    """`resample_bars` with a symbol's bars in one partition, and the number of partitions.

    Ticks move once, by symbol, and windows over symbols need no other exchange; give them the number of
    partitions. Where a symbol has few ticks a bar, combining them before they move saves nothing, and moving
    the bars again would double what lies on disk. Symbols with more than `hot_ticks` ticks are combined
    where they are read, as in `resample_bars`, so no task reads more ticks of a symbol. The ticks are counted at once.
    """
    trimmed = _trimmed(ticks, symbol, time, price, volume, seq, grain)
    counts = trimmed.groupBy("symbol").agg(F.count(F.lit(1)).alias("_ticks"))
    total, n_hot = counts.agg(F.coalesce(F.sum("_ticks"), F.lit(0)), F.count_if(F.col("_ticks") > hot_ticks)).first()
    parts = max(int(ticks.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-total // task_ticks))
    if not n_hot:
        return _combined(trimmed.repartition(parts, "symbol"), volume is not None), parts
    # At most one row for every `hot_ticks` ticks.
    hot = F.broadcast(counts.filter(F.col("_ticks") > hot_ticks).select(F.col("symbol").alias("_hot")))
    is_hot = F.col("symbol").eqNullSafe(F.col("_hot"))
    few = _combined(trimmed.join(hot, is_hot, "left_anti").repartition(parts, "symbol"), volume is not None)
    many = _combined(trimmed.join(hot, is_hot, "left_semi"), volume is not None)
    return few.unionByName(many.repartition(parts, "symbol")), parts


def _supplier_ticks(lineitem: DataFrame) -> tuple:
    seq = ((F.col("l_orderkey") * 8 + F.col("l_linenumber")) * 65536
           + F.pmod(F.col("l_partkey"), F.lit(65536)))
    return (lineitem, F.col("l_suppkey"), F.col("l_shipdate"),
            F.col("l_extendedprice") / F.col("l_quantity"), F.col("l_quantity"), seq)


def supplier_bars(lineitem: DataFrame) -> DataFrame:
    """Daily unit-price bars per supplier."""
    return resample_bars(*_supplier_ticks(lineitem), prefix="S")


def supplier_series(lineitem: DataFrame) -> tuple[DataFrame, int]:
    """The same, numeric symbols, a supplier's bars in one partition; and the number of partitions."""
    return resample_series(*_supplier_ticks(lineitem))


def nation_bars(orders: DataFrame, customer: DataFrame, nation: DataFrame) -> DataFrame:
    """Daily order-value bars per customer nation.

    The nation table has 25 rows by definition and is broadcast; the customer
    table grows with the data and is joined by shuffle unless AQE finds it small.
    """
    home = customer.join(F.broadcast(nation), F.col("c_nationkey") == F.col("n_nationkey"))
    joined = orders.join(home.select("c_custkey", "n_name"),
                         F.col("o_custkey") == F.col("c_custkey"))
    return resample_bars(joined, F.col("n_name"), F.col("o_orderdate"), F.col("o_totalprice"),
                         None, F.col("o_orderkey"))


def event_bars(events: DataFrame, grain: str = "hour") -> DataFrame:
    """Intraday value bars per event type."""
    return resample_bars(events, F.upper("event_type"), F.col("ts"), F.col("value"), None,
                         F.col("event_id"), grain)
