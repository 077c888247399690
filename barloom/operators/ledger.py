"""Orders, fills and positions of accounts as log queries.

Running balances use `panel.running`, so one account may hold any share of the
log; `block` cuts the fill sequence into ranges of bounded size.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barloom.panel import cut, running

COMMISSION_BPS, SLIPPAGE_BPS = 10.0, 5.0
# Flat fee per order and names traded in rupees without a suffix.
FLAT_FEE = {"INR": 20.0, "USD": 1.0}
INR_NAMES = ("NIFTY50", "BANKNIFTY", "SENSEX")


def symbol_currency(symbol: Column) -> Column:
    s = F.upper(F.trim(symbol))
    rupee = (s.endswith(".NS") | s.endswith(".BO") | s.startswith("^NSE") | s.startswith("^BSE")
             | s.isin(*INR_NAMES))
    return F.when(rupee, F.lit("INR")).otherwise(F.lit("USD"))


def order_fees(notional: Column, currency: Column, digits: int | None = 2) -> Column:
    flat = F.when(currency == "INR", FLAT_FEE["INR"]).otherwise(FLAT_FEE["USD"])
    fee = notional * (COMMISSION_BPS / 10_000) + flat
    return F.round(fee, digits) if digits is not None else fee


def slippage_price(price: Column, action: Column, digits: int | None = 4) -> Column:
    slip = SLIPPAGE_BPS / 10_000
    moved = price * F.when(action == "BUY", 1 + slip).otherwise(1 - slip)
    return F.round(moved, digits) if digits is not None else moved


def estimate_orders(orders: DataFrame) -> DataFrame:
    """Costs and sufficiency before trading; needs symbol, action, quantity, price, cash, held_quantity."""
    buy = F.col("action") == "BUY"
    return orders.withColumns({
        "currency": symbol_currency(F.col("symbol")),
        "fill_price": slippage_price(F.col("price"), F.col("action")),
    }).withColumn("notional", F.col("quantity") * F.col("fill_price")).withColumn(
        "fees", order_fees(F.col("notional"), F.col("currency"))
    ).withColumns({
        "slippage": F.abs(F.col("fill_price") - F.col("price")) * F.col("quantity"),
        "capital_required": F.when(buy, F.col("notional") + F.col("fees")).otherwise(0.0),
        "sufficient": F.when(buy, F.col("cash") >= F.col("notional") + F.col("fees"))
        .otherwise(F.col("held_quantity") >= F.col("quantity")).cast("int"),
    })


_SPREAD = 300.0  # log-scale width of a segment; beyond two segments weights are below 1e-130


def position_path(fills: DataFrame, block: Column, seq: str = "seq") -> DataFrame:
    """Every fill with quantity held, average cost and realised result after it.

    Needs account, symbol, seq, action, quantity, price and fee; sells never
    exceed the holding. Buys add to cost, a sell keeps the same share of cost as
    of quantity, so cost is a product of kept shares times a sum of purchases
    each divided by the product at its time. Shares are summed as logarithms,
    positions that were closed start afresh, and long sequences of partial sells
    are rebased in segments, so the sums stay in range.
    """
    key = ["account", "symbol"]
    buy = F.col("action") == "BUY"
    signed = F.when(buy, F.col("quantity")).otherwise(-F.col("quantity"))
    df = fills.withColumn("_signed", signed)
    df = running(cut(df), key, [seq], block, {"held": ("sum", "_signed")})
    df = df.withColumn("held", F.when(F.abs("held") <= 1e-7, 0.0).otherwise(F.col("held")))
    df = df.withColumns({
        "_before": F.col("held") - F.col("_signed"),
        "_flat": (F.col("held") == 0).cast("bigint"),
    })
    df = running(cut(df), key, [seq], block, {"_closed": ("sum", "_flat")})
    # A fill that closes a position still belongs to it.
    df = df.withColumn("_round", F.col("_closed") - F.col("_flat"))
    kept = F.when(buy | (F.col("_flat") == 1), 0.0).otherwise(F.log(F.col("held") / F.col("_before")))
    df = df.withColumns({"_kept": kept, "_cost": F.when(buy, F.col("quantity") * F.col("price")).otherwise(0.0)})
    rounds = [*key, "_round"]
    df = running(cut(df), rounds, [seq], block, {"_log": ("sum", "_kept")})
    df = df.withColumn("_seg", F.floor(-F.col("_log") / _SPREAD))
    df = df.withColumn("_scaled", F.col("_cost") * F.exp(-F.col("_log") - F.col("_seg") * _SPREAD))
    df = cut(df)
    carried = df.groupBy(*rounds, (F.col("_seg") + 1).alias("_seg")).agg(
        (F.sum("_scaled") * F.exp(F.lit(-_SPREAD))).alias("_carry"))
    df = running(df, [*rounds, "_seg"], [seq], block, {"_sum": ("sum", "_scaled")})
    df = df.join(carried, [*rounds, "_seg"], "left")
    cost = (F.col("_sum") + F.coalesce("_carry", F.lit(0.0))) * F.exp(F.col("_log") + F.col("_seg") * _SPREAD)
    # On a closing fill the shares stop before it, so its cost is that of the quantity sold.
    base = F.when(F.col("_flat") == 1, F.col("_before")).otherwise(F.col("held"))
    df = df.withColumn("average_cost", cost / base)
    return df.withColumn("realized_pnl", F.when(buy, 0.0).otherwise(
        F.col("quantity") * (F.col("price") - F.col("average_cost")) - F.col("fee"))).select(
        *fills.columns, "held", "average_cost", "realized_pnl")


def positions(path: DataFrame, seq: str = "seq") -> DataFrame:
    """Closing state per account and symbol."""
    return path.groupBy("account", "symbol").agg(
        F.max_by("held", seq).alias("quantity"), F.max_by("average_cost", seq).alias("_avg"),
        F.sum("realized_pnl").alias("realized_pnl"), F.sum("fee").alias("total_fees"),
        F.count(F.lit(1)).alias("fills"),
    ).withColumn("average_cost", F.when(F.col("quantity") > 0, F.col("_avg")).otherwise(0.0)).drop("_avg")


def latest_prices(bars: DataFrame) -> DataFrame:
    """Last positive close per symbol; combined before the shuffle."""
    return bars.filter(F.col("close") > 0).groupBy("symbol").agg(
        F.max_by("close", "timestamp").alias("current_price"))


def mark_positions(held: DataFrame, prices: DataFrame) -> DataFrame:
    """Market value and unrealised result; positions without a price keep their cost."""
    joined = held.join(prices, "symbol", "left").withColumn(
        "current_price", F.coalesce("current_price", "average_cost"))
    cost = F.col("quantity") * F.col("average_cost")
    return joined.withColumns({
        "market_value": F.col("quantity") * F.col("current_price"), "total_cost": cost,
    }).withColumn("unrealized_pnl", F.col("market_value") - F.col("total_cost")).withColumn(
        "unrealized_pct", F.when(cost > 0, F.col("unrealized_pnl") / cost * 100).otherwise(0.0))


def cash_ledger(fills: DataFrame, initial: float, block: Column, seq: str = "seq") -> DataFrame:
    """Running cash and fees per account after every fill."""
    value = F.col("quantity") * F.col("price")
    moved = fills.withColumn("cash_change", F.when(
        F.col("action") == "BUY", -value - F.col("fee")).otherwise(value - F.col("fee")))
    summed = running(cut(moved), ["account"], [seq], block,
                     {"_cash": ("sum", "cash_change"), "total_fees": ("sum", "fee")})
    return summed.withColumn("cash", F.col("_cash") + initial).drop("_cash")


def equity_history(snapshots: DataFrame, initial: float, block: Column, seq: str = "timestamp") -> DataFrame:
    """Peak and drawdown in percent for account equity snapshots."""
    peaked = running(snapshots, ["account"], [seq], block, {"_peak": ("max", "equity")})
    peak = F.greatest("_peak", F.lit(float(initial)))
    return peaked.withColumn("peak_equity", peak).withColumn(
        "drawdown_pct", F.when(peak > 0, (peak - F.col("equity")) / peak * 100).otherwise(0.0)).drop("_peak")


def wallet_totals(marked: DataFrame, cash: DataFrame, initial: float) -> DataFrame:
    """Per currency: market value, cost, equity and return; `cash` has currency and cash."""
    held = marked.groupBy("currency").agg(
        F.sum("market_value").alias("market_value"), F.sum("total_cost").alias("total_cost"),
        F.sum("realized_pnl").alias("realized_pnl"), F.count_if(F.col("quantity") > 0).alias("open_positions"))
    money = cash.groupBy("currency").agg(F.sum("cash").alias("cash"), F.count(F.lit(1)).alias("wallets"))
    out = money.join(held, "currency", "left").withColumn("total_equity", F.col("cash") + F.coalesce(
        "market_value", F.lit(0.0)))
    start = F.col("wallets") * float(initial)
    return out.withColumn("return_pct", (F.col("total_equity") - start) / start * 100)


def consolidate(totals: DataFrame, usd_inr: float | None) -> DataFrame:
    """Total equity in both currencies, or UNAVAILABLE without a rate."""
    by = {c: F.coalesce(F.sum(F.when(F.col("currency") == c, F.col("total_equity"))), F.lit(0.0))
          for c in ("USD", "INR")}
    known = usd_inr is not None and usd_inr > 0
    rate = F.lit(float(usd_inr) if known else None).cast("double")
    return totals.agg(
        F.lit("CALCULATED" if known else "UNAVAILABLE").alias("status"),
        (by["USD"] + by["INR"] / rate).alias("combined_usd"), (by["INR"] + by["USD"] * rate).alias("combined_inr"))


def order_status_mix(orders: DataFrame) -> DataFrame:
    return orders.groupBy("status", "order_type", "action").agg(F.count(F.lit(1)).alias("orders"))
