"""Signals, fills and trades as set operations over all symbols.

Rules: a decision at the close of bar T is filled at the open of bar T+1 with
slippage, clamped to the bar; exits are checked at closes in the order stop
loss, take profit, holding period, exit signal; an open trade is closed at the
last close of its series.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barloom.operators.passage import PassageIndex, first_passage, passage_index
from barloom.panel import DAILY, cumulative, cut, open_frame


@dataclass(frozen=True)
class Costs:
    commission_bps: float = 5.0
    fixed_fee: float = 1.0
    slippage_bps: float = 5.0
    max_volume_pct: float = 0.10

    @property
    def commission(self) -> float:
        return self.commission_bps / 10_000

    @property
    def slippage(self) -> float:
        return self.slippage_bps / 10_000


@dataclass(frozen=True)
class Barriers:
    stop_loss: float | None = None
    take_profit: float | None = None
    holding: int | None = None


def entries_exits(scored: DataFrame, enter: float, leave: float, score: str = "p") -> DataFrame:
    return scored.withColumns({
        "enter": F.coalesce(F.col(score) >= enter, F.lit(False)).cast("int"),
        "leave": F.coalesce(F.col(score) <= leave, F.lit(False)).cast("int")})


def position_state(scored: DataFrame, enter: float, leave: float, score: str = "p",
                   grain: str = DAILY, keys=("symbol",)) -> DataFrame:
    """Long or flat after each close; the state holds between signals."""
    if enter <= leave:
        raise ValueError("the entry threshold must be above the exit threshold")
    marked = scored.withColumn("_mark", F.when(F.col(score) >= enter, 1).when(F.col(score) <= leave, 0))
    state = cumulative(marked, {"position": ("last", "_mark")}, grain, keys)
    return state.withColumn("position", F.coalesce("position", F.lit(0))).drop("_mark")


def buy_price(open_: Column, high: Column, costs: Costs) -> Column:
    return F.least(open_ * (1 + costs.slippage), high)


def sell_price(open_: Column, low: Column, costs: Costs) -> Column:
    return F.greatest(open_ * (1 - costs.slippage), low)


def next_bar_fill(bars: DataFrame, costs: Costs = Costs(), grain: str = DAILY) -> DataFrame:
    """Fill prices an order decided on this bar gets on the next one; missing on the last bar."""
    frame = open_frame(bars, 0, 1, grain)
    nxt = {c: F.lead(c, 1).over(frame.window) for c in ("timestamp", "open", "high", "low", "volume")}
    led = frame.df.withColumns({f"_next_{c}": v for c, v in nxt.items()})
    out = led.withColumns({
        "fill_time": F.col("_next_timestamp"), "base_price": F.col("_next_open"),
        "fill_volume": F.col("_next_volume"),
        "buy_fill": F.when(F.col("_next_open").isNotNull(),
                           buy_price(F.col("_next_open"), F.col("_next_high"), costs)),
        "sell_fill": F.when(F.col("_next_open").isNotNull(),
                            sell_price(F.col("_next_open"), F.col("_next_low"), costs)),
    })
    return frame.close(out).select(*bars.columns, "fill_time", "base_price", "fill_volume",
                                   "buy_fill", "sell_fill")


def fill_costs(fills: DataFrame, quantity: Column, price: Column, base: Column, volume: Column,
               costs: Costs = Costs()) -> DataFrame:
    """Filled quantity under the volume cap with fee, slippage cost and traded value."""
    filled = F.least(quantity, volume * costs.max_volume_pct)
    return fills.withColumn("filled_quantity", filled).withColumns({
        "traded_value": F.col("filled_quantity") * price,
        "slippage_cost": F.col("filled_quantity") * F.abs(price - base),
    }).withColumn("fee", F.col("traded_value") * costs.commission + costs.fixed_fee)


def held_bars(scored: DataFrame, enter: float, leave: float, costs: Costs = Costs(), score: str = "p",
              grain: str = DAILY, keys=("symbol",)) -> DataFrame:
    """Bars with the position held during them, fills at their open and a trip number.

    `held` is 1 while in a trade; `action` is BUY or SELL on the bars whose open
    fills an order. `trip` counts entries so far.
    """
    if enter <= leave:
        raise ValueError("the entry threshold must be above the exit threshold")
    keys = list(keys)
    marked = scored.withColumns({
        "_mark": F.when(F.col(score) >= enter, 1).when(F.col(score) <= leave, 0),
        "_one": F.lit(1).cast("bigint")})
    # Held in this bar is the state after the previous one.
    state = cumulative(marked, {"held": ("prev", "_mark"), "prev_close": ("prev", "close"),
                                "n": ("sum", "_one")}, grain, keys)
    state = state.withColumn("held", F.coalesce("held", F.lit(0)))
    before = cumulative(state, {"_before": ("prev", "held")}, grain, keys).withColumn(
        "_before", F.coalesce("_before", F.lit(0)))
    entry, leaving = (F.col("held") == 1) & (F.col("_before") == 0), (F.col("held") == 0) & (F.col("_before") == 1)
    acted = before.withColumns({
        "action": F.when(entry, "BUY").when(leaving, "SELL"),
        "fill": F.when(entry, buy_price(F.col("open"), F.col("high"), costs))
        .when(leaving, sell_price(F.col("open"), F.col("low"), costs)),
        "_entry": entry.cast("bigint"),
    })
    counted = cumulative(acted, {"trip": ("sum", "_entry")}, grain, keys)
    return counted.drop("_before", "_entry", "_one", "_mark")


def round_trips(held: DataFrame, quantity: float = 100.0, costs: Costs = Costs(),
                keys=("symbol",)) -> DataFrame:
    """One row per trade of `held_bars`, an open one closed at the last close of its key."""
    keys = list(keys)
    lasts = held.groupBy(*keys).agg(
        F.max_by(F.struct("timestamp", "close", "low", "n", "held"), "n").alias("_last"))
    moved = held.filter((F.col("trip") > 0) & F.col("action").isNotNull())
    buy, sell = F.col("action") == "BUY", F.col("action") == "SELL"
    trips = moved.groupBy(*keys, "trip").agg(
        F.max(F.when(buy, F.col("timestamp"))).alias("entry_time"),
        F.max(F.when(buy, F.col("fill"))).alias("entry_price"), F.max(F.when(buy, F.col("n"))).alias("_in"),
        F.max(F.when(sell, F.col("timestamp"))).alias("_out_time"),
        F.max(F.when(sell, F.col("fill"))).alias("_out_price"), F.max(F.when(sell, F.col("n"))).alias("_out"),
    ).join(lasts, keys)
    last_price = sell_price(F.col("_last.close"), F.col("_last.low"), costs)
    closed = F.col("_out").isNotNull()
    full = trips.withColumns({
        "exit_time": F.when(closed, F.col("_out_time")).otherwise(F.col("_last.timestamp")),
        "exit_price": F.when(closed, F.col("_out_price")).otherwise(last_price),
        "holding_bars": F.coalesce("_out", F.col("_last.n")) - F.col("_in"),
        "exit_reason": F.when(closed, F.lit("signal_exit")).otherwise(F.lit("end_of_simulation")),
        "quantity": F.lit(float(quantity)),
    })
    return trade_result(full, costs).select(
        *keys, "trip", "entry_time", "exit_time", "quantity", "entry_price", "exit_price", "gross_pnl",
        "total_fees", "net_pnl", "pnl_pct", "holding_bars", "exit_reason")


def trade_result(trades: DataFrame, costs: Costs) -> DataFrame:
    """Gross and net result from quantity, entry and exit price."""
    q, a, z = F.col("quantity"), F.col("entry_price"), F.col("exit_price")
    fees = q * (a + z) * costs.commission + 2 * costs.fixed_fee
    return trades.withColumns({"gross_pnl": q * (z - a), "total_fees": fees}).withColumn(
        "net_pnl", F.col("gross_pnl") - F.col("total_fees")).withColumn(
        "pnl_pct", F.when(q * a > 0, F.col("net_pnl") / (q * a)).otherwise(0.0))


def _pnl(close: Column) -> Column:
    return (close - F.col("entry_price")) / F.col("entry_price")


def _asked(rule: dict, child: Column) -> list[tuple[str, Column]]:
    """Reasons for which a close asks for an exit, in their order; also for the extremes of many bars."""
    return [("stop_loss", _pnl(child["least"]) <= -rule["stop_loss"]), ("take_profit", _pnl(child["most"]) >= rule["take_profit"]),
            ("max_holding_period", child["last"] >= F.col("_from") + rule["holding"]), ("signal_exit", child["p"] <= rule["leave"])]


def _any_asked(rule: dict, child: Column) -> Column:
    hit = F.lit(False)
    for _, cond in _asked(rule, child):
        hit = hit | F.coalesce(cond, F.lit(False))
    return hit


def _entries(scored: DataFrame, enter: float, costs: Costs, grain: str) -> tuple[DataFrame, PassageIndex]:
    """Rows whose score asks for an entry, with the next bar's fill, and the tree over the closes behind them."""
    frame = open_frame(scored.select("timestamp", "symbol", "open", "high", "low", "close", "p"), 0, 1, grain)
    nxt = F.struct("timestamp", "open", "high", "low")
    led = frame.close(frame.df.withColumns({"_next": F.lead(nxt, 1).over(frame.window)}))
    bars = cut(led.withColumns({"least": F.col("close"), "most": F.col("close")}))
    index = passage_index(bars, ["least", "p"], ["most"], ["n", "timestamp", "low", "close", "p", "_next"])
    entry = bars.filter((F.col("p") >= enter) & F.col("_next").isNotNull())
    lasts = bars.groupBy("symbol").agg(F.max_by(F.struct("n", "timestamp", "low", "close"), "n").alias("_end"))
    rows = entry.join(lasts, "symbol").select(
        "symbol", F.col("timestamp").alias("signal_time"), F.col("p").alias("_score"), (F.col("n") + 1).alias("_from"), F.col("_next.timestamp").alias("entry_time"),
        buy_price(F.col("_next.open"), F.col("_next.high"), costs).alias("entry_price"), "_end")
    return rows, index


def _barrier_trades(entries: DataFrame, index: PassageIndex, rule: dict, costs: Costs) -> DataFrame:
    """Exit of each entry: the first close that asks for one, filled at the next open; else the last close of the series."""
    found = first_passage(entries, index, F.col("_from"), lambda c: _any_asked(rule, c), "_ask")
    ask, end, out = F.col("_ask"), F.col("_end"), F.col("_ask._next")
    filled = out.isNotNull()
    reason = F.when(~filled, F.lit("end_of_simulation"))
    at = {"least": ask["close"], "most": ask["close"], "last": ask["n"], "p": ask["p"]}
    for name, cond in _asked(rule, at):
        reason = reason.when(cond, F.lit(name))
    return found.withColumns({
        "exit_time": F.when(filled, out["timestamp"]).otherwise(end["timestamp"]),
        "exit_price": F.when(filled, sell_price(out["open"], out["low"], costs)).otherwise(sell_price(end["close"], end["low"], costs)),
        "exit_reason": reason,
        "holding_bars": F.when(filled, ask["n"] + 1).otherwise(end["n"]) - F.col("_from"),
    })


def _limit(value, kind: str) -> Column:
    return F.lit(value).cast(kind)


def barrier_exits(scored: DataFrame, enter: float, leave: float, rule: Barriers = Barriers(),
                  costs: Costs = Costs(), grain: str = DAILY, quantity: float = 100.0) -> DataFrame:
    """Outcome of entering at every signal: first barrier hit, its price and reason. A barrier that is None never hits."""
    rows, index = _entries(scored, enter, costs, grain)
    limits = {"stop_loss": _limit(rule.stop_loss, "double"), "take_profit": _limit(rule.take_profit, "double"),
              "holding": _limit(rule.holding, "int"), "leave": _limit(leave, "double")}
    trades = _barrier_trades(rows, index, limits, costs).withColumn("quantity", F.lit(float(quantity)))
    return trade_result(trades, costs).select(
        "symbol", "signal_time", "entry_time", "exit_time", "quantity", "entry_price", "exit_price", "gross_pnl",
        "total_fees", "net_pnl", "pnl_pct", "holding_bars", "exit_reason")


def threshold_sweep(scored: DataFrame, enters: list[float], leaves: list[float], grid: list[Barriers],
                    costs: Costs = Costs(), grain: str = DAILY) -> DataFrame:
    """Trade statistics for every entry threshold, exit threshold and barrier set, from one pass over the signals.

    A signal's outcome does not depend on the entry threshold, so each is worked out once for an exit threshold and barrier set and
    counted in the interval between two entry thresholds that its score lies in; sums over the intervals above give each threshold's row.
    """
    levels = sorted(set(enters))
    rows, index = _entries(scored, levels[0], costs, grain)
    kind = "stop_loss double, take_profit double, holding int, leave double"
    sets = F.array(*[F.struct(_limit(g.stop_loss, "double").alias("stop_loss"), _limit(g.take_profit, "double").alias("take_profit"),
                              _limit(g.holding, "int").alias("holding"), _limit(v, "double").alias("leave")) for g in grid for v in sorted(set(leaves))])
    each = rows.withColumn("g", F.explode(sets.cast(f"array<struct<{kind.replace(' ', ':')}>>".replace(",:", ","))))
    limits = {c: F.col(f"g.{c}") for c in ("stop_loss", "take_profit", "holding", "leave")}
    trades = trade_result(_barrier_trades(each, index, limits, costs).withColumn("quantity", F.lit(100.0)), costs)
    interval = F.lit(0)
    for i, level in enumerate(levels):
        interval = F.when(F.col("_score") >= level, i).otherwise(interval)
    by = [F.col(f"g.{c}").alias(c) for c in ("leave", "stop_loss", "take_profit", "holding")]
    sums = trades.groupBy(interval.alias("_interval"), *by).agg(
        F.count(F.lit(1)).alias("trades"), F.sum("pnl_pct").alias("_pnl"), F.sum((F.col("net_pnl") > 0).cast("long")).alias("_wins"),
        F.sum("holding_bars").alias("_held"))
    below = F.explode(F.slice(F.array(*[F.lit(float(v)) for v in levels]), F.lit(1), F.col("_interval") + 1)).alias("enter")
    total = sums.select("*", below).groupBy("enter", "leave", "stop_loss", "take_profit", "holding").agg(
        *[F.sum(c).alias(c) for c in ("trades", "_pnl", "_wins", "_held")])
    n = F.col("trades")
    return total.select("enter", "leave", "stop_loss", "take_profit", "holding", "trades", (F.col("_pnl") / n).alias("avg_pnl_pct"),
                        (F.col("_wins") / n).alias("win_rate"), (F.col("_held") / n).alias("avg_holding"))


def param_sweep(scored: DataFrame, enter: float, leave: float, grid: list[Barriers],
                costs: Costs = Costs(), grain: str = DAILY) -> DataFrame:
    """Trade statistics for each barrier set at one pair of thresholds."""
    return threshold_sweep(scored, [enter], [leave], grid, costs, grain).drop("enter", "leave")


def signal_equity(held: DataFrame, costs: Costs = Costs(), fraction: float = 1.0, grain: str = DAILY,
                  keys=("symbol",), factor: Column | None = None) -> DataFrame:
    """Growth of one unit of capital with `fraction` of it in the held positions.

    The entry bar earns close over fill, held bars close over the previous
    close, the exit bar fill over the previous close; each fill pays commission.
    `factor` is a further growth factor of a bar.
    """
    buy, sell, held_on = F.col("action") == "BUY", F.col("action") == "SELL", F.col("held") == 1
    gross = (F.when(buy, F.col("close") / F.col("fill")).when(sell, F.col("fill") / F.col("prev_close"))
             .when(held_on, F.col("close") / F.col("prev_close")).otherwise(1.0))
    fee = F.when(F.col("action").isNotNull(), 1 - costs.commission).otherwise(1.0)
    growth = gross * fee if factor is None else gross * fee * factor
    grown = held.withColumn("daily_return", (growth - 1) * fraction).withColumn(
        "_log", F.log1p("daily_return"))
    summed = cumulative(grown, {"log_equity": ("sum", "_log")}, grain, keys)
    return summed.withColumn("equity", F.exp("log_equity")).drop("_log")
