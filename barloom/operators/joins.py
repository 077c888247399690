"""Look-ups between tables: instruments, as-of quotes and first limit touches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barloom.operators.ledger import symbol_currency
from barloom.operators.passage import WIDTH, first_passage, passage_index
from barloom.panel import DAILY, cut, running, series_index, time_block

UNIVERSE_COLUMNS = ("symbol", "name", "exchange", "currency", "asset_type", "country", "sector")


def fallback_instrument(symbol: Column) -> dict[str, Column]:
    """Rule-based fields of a symbol that is not listed."""
    s = F.upper(F.trim(symbol))
    rupee = s.endswith(".NS") | s.endswith(".BO") | s.startswith("^NSE") | s.startswith("^BSE")
    return {
        "name": s,
        "exchange": F.when(s.endswith(".NS"), "NSE").when(s.endswith(".BO"), "BSE").otherwise("US"),
        "currency": F.when(rupee, "INR").otherwise("USD"), "asset_type": F.lit("EQUITY"),
        "country": F.when(rupee, "IN").otherwise("US"), "sector": F.lit("Unspecified"),
    }


def enrich_instruments(rows: DataFrame, universe: DataFrame) -> DataFrame:
    """Adds instrument fields: exact match, then with a caret, then by rule.

    The universe answers to each symbol and, for carets, to the bare code; one
    left join then covers both steps. Its size is left to the optimiser.
    """
    listed = F.upper(F.trim("symbol"))
    answers = universe.select(
        F.explode(F.array_compact(F.array(
            F.struct(listed.alias("key"), F.lit(0).alias("rank")),
            F.when(listed.startswith("^"), F.struct(
                F.substring(listed, 2, 1000).alias("key"), F.lit(1).alias("rank")))))).alias("k"),
        F.struct(*UNIVERSE_COLUMNS).alias("info"))
    lookup = answers.groupBy(F.col("k.key").alias("_key")).agg(
        F.min_by("info", "k.rank").alias("_info"))
    joined = rows.withColumn("_key", F.upper(F.trim("symbol"))).join(lookup, "_key", "left")
    rule = fallback_instrument(F.col("symbol"))
    return joined.select(
        *rows.columns, F.coalesce(F.col("_info.symbol"), F.col("_key")).alias("instrument"),
        *[F.coalesce(F.col(f"_info.{c}"), rule[c]).alias(c) for c in UNIVERSE_COLUMNS[1:]])


def search_universe(universe: DataFrame, text: str, limit: int = 20, position: str = "position") -> DataFrame:
    """Exact symbol, then prefix, then name, sector or exchange; listed order inside a tier."""
    q = text.strip().upper()
    symbol = F.upper("symbol")
    tier = (F.when(symbol == q, 1).when(symbol.startswith(q), 2)
            .when(F.upper("name").contains(q) | F.upper("sector").contains(q)
                  | F.upper("exchange").contains(q), 3))
    if not q:
        tier = F.lit(0)
    return (universe.withColumn("tier", tier).filter(F.col("tier").isNotNull())
            .orderBy("tier", position).limit(limit))


def asof_join(left: DataFrame, right: DataFrame, key: str, left_time: str, right_time: str,
              values: list[str], block_seconds: int) -> DataFrame:
    """Latest `right` row at or before each `left` row of the same key.

    The distinct left instants and the right rows are laid on one time line and
    the last right row is carried forward in two levels, so nothing is paired, a
    huge key is cut by time and left rows sharing an instant enter once. Of right
    rows at the same instant the one with the greatest values is taken. The
    result joins the left rows back one-to-many.
    """
    quotes = right.groupBy(key, right_time).agg(F.max(F.struct(*values)).alias("_v")).select(
        F.col(key).alias("_key"), F.col(right_time).alias("_t"), F.lit(0).alias("_side"),
        F.struct(F.col(right_time), *[F.col(f"_v.{v}").alias(v) for v in values]).alias("_hit"))
    asked = left.select(F.col(key).alias("_key"), F.col(left_time).alias("_t")).distinct().withColumn(
        "_side", F.lit(1))
    line = quotes.unionByName(asked, allowMissingColumns=True)
    done = running(line, ["_key"], ["_t", "_side"], time_block("_t", block_seconds),
                   {"_found": ("last", "_hit")}).filter("_side = 1").select("_key", "_t", "_found")
    joined = left.join(done, (left[key] == done["_key"]) & (left[left_time] == done["_t"]), "left")
    return joined.select(*[left[c] for c in left.columns],
                         *[F.col(f"_found.{c}").alias(f"asof_{c}") for c in [right_time, *values]])


def limit_first_touch(orders: DataFrame, bars: DataFrame, grain: str = DAILY,
                      block_seconds: int = 86400, rows: int = WIDTH) -> DataFrame:
    """First bar at or after its creation that reaches each limit order.

    The search starts behind the last bar before the order and goes through a tree of lowest lows and highest highs
    (`first_passage`, nodes of `rows`, two at least), whatever lies between order and touch.
    """
    # Read for the tree and for the orders' places, so it is written once.
    placed = cut(series_index(bars.select("symbol", "timestamp", "low", "high"), grain))
    index = passage_index(placed, ["low"], ["high"], ["timestamp"], width=max(rows, 2))
    # Position of the last bar before the order: the search starts right after it.
    eve = orders.withColumn("_eve", F.expr("created_at - INTERVAL 1 MICROSECOND"))
    df = asof_join(eve, placed, "symbol", "_eve", "timestamp", ["n"], block_seconds)
    found = first_passage(df, index, F.coalesce("asof_n", F.lit(0)) + 1, lambda c: F.when(
        F.col("action") == "BUY", c["low"] <= F.col("limit_price")).otherwise(c["high"] >= F.col("limit_price")), "_touch")
    return found.select(*orders.columns, F.col("_touch.timestamp").alias("filled_at"),
                        F.when(F.col("_touch").isNotNull(), F.col("limit_price")).alias("filled_price"))


def limit_fills(touches: DataFrame) -> DataFrame:
    """Cash effect of touched orders: filled at the limit, with fee and cash reserve released."""
    from barloom.operators.ledger import order_fees

    notional = F.col("quantity") * F.col("limit_price")
    return touches.withColumn("currency", symbol_currency(F.col("symbol"))).withColumn(
        "fees", order_fees(notional, F.col("currency"))).withColumns({
            "status": F.when(F.col("filled_at").isNotNull(), "FILLED").otherwise("PENDING"),
            "reserved_cash": F.when(F.col("action") == "BUY", notional + F.col("fees")).otherwise(0.0)})
