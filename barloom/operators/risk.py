"""Pre-trade risk checks and position sizing over order tables."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

NOTHING = 1e-7


@dataclass(frozen=True)
class RiskLimits:
    max_position_exposure: float | None = None
    max_position_concentration: float = 0.25
    max_portfolio_exposure: float = 1.0
    max_drawdown: float | None = 0.20
    cash_buffer: float = 0.02
    allow_shorting: bool = False

    def __post_init__(self):
        if not 0 < self.max_position_concentration <= 1:
            raise ValueError("max_position_concentration must be in (0, 1]")
        if self.max_portfolio_exposure <= 0:
            raise ValueError("max_portfolio_exposure must be positive")
        if self.max_position_exposure is not None and self.max_position_exposure <= 0:
            raise ValueError("max_position_exposure must be positive")
        if self.max_drawdown is not None and not 0 < self.max_drawdown <= 1:
            raise ValueError("max_drawdown must be in (0, 1]")
        if not 0 <= self.cash_buffer < 1:
            raise ValueError("cash_buffer must be in [0, 1)")


def snapshot(orders: DataFrame) -> DataFrame:
    """Adds position value, exposure and concentration at the order's price.

    `gross_value` is the value of all holdings at their own prices.
    """
    equity = F.col("equity")
    position = F.col("held_quantity") * F.col("price")
    return orders.withColumns({
        "requested_value": F.col("quantity") * F.col("price"), "position_value": position,
        "portfolio_exposure_pct": F.when(equity > 0, F.col("gross_value") / equity).otherwise(0.0),
        "position_concentration_pct": F.when(equity > 0, position / equity).otherwise(0.0),
    })


def evaluate_orders(orders: DataFrame, limits: RiskLimits = RiskLimits()) -> DataFrame:
    """Decision per order: ACCEPTED, REDUCED or REJECTED with approved quantity and constraint.

    Needs order_id, timestamp, symbol, action, quantity, price, held_quantity,
    gross_value, equity, cash and drawdown. Every buy cap leaves room for some
    quantity, whatever the other caps do, so the approved quantity is the least
    of the request and all rooms; the last cap that lowered it is reported, and
    the first one without room rejects.
    """
    df = snapshot(orders)
    price, req, held = F.col("price"), F.col("quantity"), F.col("held_quantity")
    caps: dict[str, Column] = {}
    if limits.max_position_exposure is not None:
        caps["max_position_exposure"] = limits.max_position_exposure - F.col("position_value")
    caps["max_position_concentration"] = (
        F.col("equity") * limits.max_position_concentration - F.col("position_value"))
    caps["max_portfolio_exposure"] = F.col("equity") * limits.max_portfolio_exposure - F.col("gross_value")
    caps["cash_buffer"] = F.col("cash") * (1 - limits.cash_buffer)
    df = df.withColumns({f"_room_{n}": F.when(price > 0, F.greatest(F.lit(0.0), left) / price)
                         for n, left in caps.items()})

    insane = (req <= 0) | (price <= 0)
    unknown = F.lit(False)
    for name in ("action", "quantity", "price", "held_quantity", "gross_value", "equity", "cash", "drawdown"):
        unknown |= F.col(name).isNull()
    sell = F.col("action") == "SELL"
    stop = F.when(unknown, "missing_state").when(insane, "order_sanity")
    if not limits.allow_shorting:
        stop = stop.when(sell & (held <= 0), "short_selling_disabled")
    if limits.max_drawdown is not None:
        stop = stop.when(~sell & (F.abs("drawdown") >= limits.max_drawdown), "max_drawdown_limit")
    hit = F.lit(None).cast("string")
    why, left = [], req
    for name in caps:
        room = F.col(f"_room_{name}")
        stop = stop.when(~sell & (room <= NOTHING), name)
        hit = F.when(room < left, name).otherwise(hit)
        why.append(F.when(room < left, F.lit(name)))
        left = F.least(left, room)
    over = F.lit(False) if limits.allow_shorting else sell & (req > held) & (held > 0)
    df = df.withColumns({
        "_stop": stop, "_q": F.when(over, held).when(sell, req).otherwise(left),
        "_hit": F.when(over, "held_position_limit").when(~sell, hit),
        "_why": F.array_compact(F.array(*why))})
    stopped = F.col("_stop").isNotNull()
    reduced = ~stopped & F.when(sell, over).otherwise(F.col("_q") < req - NOTHING)
    status = F.when(stopped, "REJECTED").when(reduced, "REDUCED").otherwise("ACCEPTED")
    approved = F.when(stopped, 0.0).otherwise(F.col("_q"))
    reason = (F.when(stopped, F.concat(F.lit("rejected: "), F.col("_stop")))
              .when(reduced & sell, F.lit("reduced: held_position_limit"))
              .when(reduced, F.concat(F.lit("reduced: "), F.array_join("_why", ", ")))
              .when(sell, F.lit("accepted: reduces risk")).otherwise(F.lit("accepted: within limits")))
    return df.select(
        F.col("order_id").alias("decision_id"), "timestamp", "symbol", "action", status.alias("status"),
        F.col("quantity").alias("requested_quantity"), approved.alias("approved_quantity"), "requested_value",
        (approved * price).alias("approved_value"), "price", reason.alias("reason"),
        F.when(stopped, F.col("_stop")).when(reduced, F.col("_hit")).alias("constraint_triggered"),
        F.col("equity").alias("current_equity"), F.col("drawdown").alias("current_drawdown"),
        "portfolio_exposure_pct", "position_concentration_pct")


def decision_counts(decisions: DataFrame, *by: str) -> DataFrame:
    return decisions.groupBy(*by).agg(
        *[F.count_if(F.col("status") == s).alias(s.lower()) for s in ("ACCEPTED", "REDUCED", "REJECTED")])


@dataclass(frozen=True)
class Sizing:
    fixed_cash: float = 10_000.0
    target_risk: float = 0.01
    atr_multiplier: float = 2.0
    target_volatility: float = 0.15
    target_position: float = 0.10
    max_concentration: float = 0.25
    cash_buffer: float = 0.02

    def quantity(self, method: str, price: Column, equity: Column, cash: Column,
                 atr: Column | None = None, volatility: Column | None = None) -> Column:
        """Order quantity by one of four rules; zero without price or equity."""
        zero = F.lit(0.0)
        spendable = cash * (1 - self.cash_buffer)
        fallback = equity * self.target_position
        if method == "fixed_cash":
            value = F.least(F.lit(self.fixed_cash), spendable)
        elif method == "atr_risk":
            raw = equity * self.target_risk / (atr * self.atr_multiplier)
            value = F.when(atr > 0, F.least(raw * price, spendable)).otherwise(fallback)
        elif method == "volatility_target":
            weight = F.least(F.lit(self.target_volatility) / volatility, F.lit(self.max_concentration))
            value = F.when(volatility > 0, F.least(equity * weight, spendable)).otherwise(fallback)
        elif method == "fractional_equity":
            value = F.least(fallback, spendable)
        else:
            raise ValueError(f"unknown sizing method {method}")
        return F.when((price > 0) & (equity > 0), F.greatest(zero, value / price)).otherwise(zero)


def signal_quantity(price: Column, cash: Column, equity: Column, kind: str = "fractional_equity",
                    value: float = 0.95) -> Column:
    """Strategy-level size: share of equity or fixed cash, at most 99 % of the cash."""
    target = equity * value if kind == "fractional_equity" else (
        F.least(F.lit(value), cash * 0.99) if kind == "fixed_cash" else cash * 0.95)
    bounded = F.least(target, cash * 0.99)
    return F.when((price > 0) & (bounded > 0), bounded / price).otherwise(0.0)
