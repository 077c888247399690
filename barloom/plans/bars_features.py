"""Queries over bars, features and targets."""

from __future__ import annotations

from functools import partial

from pyspark.sql import functions as F

from barloom.functions import features as FT
from barloom.functions import targets as TG
from barloom.functions import indicators as IND
from barloom.plans.core import SQL_PARTS, query, rounded, rounded_sql
from barloom.sources import bars as B

KEYS = "timestamp, symbol"
_K = ("timestamp", "symbol")


def _bar_sql(part):
    return f"WITH {{{part}}} {rounded_sql(part, *_K)}"


query("resample_bars", _bar_sql("bars_s"))(lambda t: rounded(t.bars_s))
query("resample_bars_nation", _bar_sql("bars_n"))(lambda t: rounded(t.bars_n))
query("resample_bars_hour", _bar_sql("bars_e"))(lambda t: rounded(t.bars_e))

query("resample_bars_15m", """SELECT time_bucket(INTERVAL 15 MINUTE, ts) AS timestamp, upper(event_type) AS symbol,
  min_by(value, event_id) AS open, max(value) AS high, min(value) AS low, max_by(value, event_id) AS close,
  CAST(count(*) AS DOUBLE) AS volume FROM events GROUP BY 1, 2""")(
    lambda t: B.event_bars(t.events, "15 minutes"))
query("resample_bars_5m", """SELECT time_bucket(INTERVAL 5 MINUTE, ts) AS timestamp, upper(event_type) AS symbol,
  min_by(value, event_id) AS open, max(value) AS high, min(value) AS low, max_by(value, event_id) AS close,
  CAST(count(*) AS DOUBLE) AS volume FROM events GROUP BY 1, 2""")(
    lambda t: B.event_bars(t.events, "5 minutes"))
query("resample_bars_week", """SELECT CAST(date_trunc('week', ts) AS TIMESTAMP) AS timestamp, upper(event_type) AS symbol,
  min_by(value, event_id) AS open, max(value) AS high, min(value) AS low, max_by(value, event_id) AS close,
  CAST(count(*) AS DOUBLE) AS volume FROM events GROUP BY 1, 2""")(
    lambda t: B.event_bars(t.events, "week"))

# ---------------------------------------------------------------- features


def feature_sql(part: str) -> str:
    """All features in SQL over the bars named `part`, as table `feats`."""
    def lagged(col, ks):
        return ", ".join(f"lag({col}, {k}) OVER w AS {col[0]}l{k}" for k in ks)

    frames = ", ".join(
        f"f{k} AS (PARTITION BY symbol ORDER BY timestamp ROWS BETWEEN {k - 1} PRECEDING AND CURRENT ROW)"
        for k in (10, 14, 20, 21, 50, 60))
    out = []
    for k in (1, 3, 5, 10, 21):
        out.append(f"CASE WHEN cl{k} > 0 THEN (close - cl{k}) / cl{k} END AS return_{k}d")
    for k in (1, 5, 21):
        out.append(f"CASE WHEN cl{k} > 0 AND close > 0 THEN ln(close / cl{k}) END AS log_return_{k}d")
    for k in (5, 10, 21):
        out.append(f"close - cl{k} AS momentum_{k}d")
        out.append(f"CASE WHEN cl{k} > 0 THEN 100 * (close - cl{k}) / cl{k} END AS roc_{k}d")
    for k in (10, 20, 50):
        out.append(f"CASE WHEN n >= {k} AND sma{k} > 0 THEN (close - sma{k}) / sma{k} END AS price_to_sma_{k}d")
    out.append("CASE WHEN n >= 50 AND sma50 > 0 THEN (sma10 - sma50) / sma50 END AS sma_ratio_10_50")
    for k in (10, 20, 60):
        out.append(f"CASE WHEN n >= {k} THEN sd{k} END AS vol_std_{k}d")
        out.append(f"CASE WHEN n >= {k} THEN sd{k} * sqrt(252) END AS realized_vol_{k}d")
        out.append(f"CASE WHEN n >= {k} AND hi{k} > 0 THEN (close - hi{k}) / hi{k} END AS dist_high_{k}d")
        out.append(f"CASE WHEN n >= {k} AND lo{k} > 0 THEN (close - lo{k}) / lo{k} END AS dist_low_{k}d")
        out.append(f"CASE WHEN n < {k} THEN NULL WHEN hi{k} - lo{k} <= 1e-8 THEN 0.5 ELSE "
                   f"least(1, greatest(0, (close - lo{k}) / (hi{k} - lo{k}))) END AS range_pos_{k}d")
    for k in (14, 21):
        out.append(f"CASE WHEN n >= {k} THEN atr{k} END AS atr_{k}d")
        out.append(f"CASE WHEN n >= {k} AND close > 0 THEN 100 * atr{k} / close END AS natr_{k}d")
    for k in (1, 5):
        out.append(f"CASE WHEN vl{k} > 0 THEN (volume - vl{k}) / vl{k} END AS volume_change_{k}d")
    for k in (10, 20):
        out.append(f"CASE WHEN n >= {k} AND vm{k} > 0 THEN volume / vm{k} END AS volume_to_sma_{k}d")
        out.append(f"CASE WHEN n >= {k} THEN (volume - vm{k}) / (vs{k} + 1e-8) END AS volume_zscore_{k}d")
    rolls = []
    for k in (10, 20, 50):
        rolls.append(f"avg(close) OVER f{k} AS sma{k}")
    for k in (10, 20, 60):
        rolls += [f"stddev_samp(r1) OVER f{k} AS sd{k}", f"max(high) OVER f{k} AS hi{k}",
                  f"min(low) OVER f{k} AS lo{k}"]
    for k in (14, 21):
        rolls.append(f"avg(tr) OVER f{k} AS atr{k}")
    for k in (10, 20):
        rolls += [f"avg(volume) OVER f{k} AS vm{k}", f"stddev_samp(volume) OVER f{k} AS vs{k}"]
    return f"""lagged AS (SELECT *, row_number() OVER w AS n, {lagged('close', (1, 3, 5, 10, 21))},
  {lagged('volume', (1, 5))} FROM {part} WINDOW w AS (PARTITION BY symbol ORDER BY timestamp)),
valued AS (SELECT *, CASE WHEN cl1 > 0 THEN (close - cl1) / cl1 END AS r1,
  CASE WHEN cl1 IS NULL THEN high - low
       ELSE greatest(high - low, abs(high - cl1), abs(low - cl1)) END AS tr FROM lagged),
rolled AS (SELECT *, {', '.join(rolls)} FROM valued WINDOW {frames}),
feats AS (SELECT timestamp, symbol, {', '.join(out)} FROM rolled)"""


for _part in ("bars_s", "bars_n", "bars_e"):
    SQL_PARTS[f"feats_{_part[-1]}"] = feature_sql(_part)


def _over(t, part, grain, use):
    """`use` of the bars; suppliers' daily ones, which are the largest, lie by symbol already."""
    return t.over_bars_s(use) if (part, grain) == ("bars_s", "day") else use(getattr(t, part))


def _features(name, columns, part="bars_s", grain="day"):
    cols = ", ".join(columns)
    sql = (f"WITH {{{part}}}, {{feats_{part[-1]}}}, picked AS (SELECT {KEYS}, {cols} FROM feats) "
           + rounded_sql("picked", *_K))
    use = partial(FT.compute_features, names=columns, grain=grain)
    query(name, sql)(lambda t: rounded(_over(t, part, grain, use)))


for _f in FT.REGISTRY.select():
    _features(_f.name, [_f.name])

ALL_FEATURES = [f.name for f in FT.REGISTRY.select()]
_features("feature_matrix", ALL_FEATURES)
_features("feature_matrix_nation", ALL_FEATURES, "bars_n")
_features("feature_matrix_hourly", ALL_FEATURES, "bars_e", "hour")
_features("select_features", [f.name for f in FT.REGISTRY.select(groups=["VOLUME", "PRICE"])], "bars_n")

query("multi_period_returns", """WITH {bars_n}, picked AS (SELECT timestamp, symbol,
  """ + ", ".join(f"CASE WHEN lag(close, {k}) OVER w > 0 THEN close / lag(close, {k}) OVER w - 1 END AS return_{k}d"
                  for k in (2, 4, 7)) + """
  FROM bars_n WINDOW w AS (PARTITION BY symbol ORDER BY timestamp)) """ + rounded_sql("picked", *_K))(
    lambda t: rounded(FT.compute_features(t.bars_n, features=FT.multi_period_returns([2, 4, 7]))))

query("custom_feature", """WITH {bars_n}, picked AS (SELECT timestamp, symbol,
  CASE WHEN row_number() OVER w >= 5 THEN max(high) OVER f - min(low) OVER f END AS band_width_5d
  FROM bars_n WINDOW w AS (PARTITION BY symbol ORDER BY timestamp),
  f AS (PARTITION BY symbol ORDER BY timestamp ROWS BETWEEN 4 PRECEDING AND CURRENT ROW)) """
      + rounded_sql("picked", *_K))(
    lambda t: rounded(FT.compute_features(t.bars_n, features=[FT.Feature(
        "band_width_5d", "CUSTOM", ("high", "low"), 5,
        lambda b: b.roll("max", "high", 5) - b.roll("min", "low", 5), custom=True)])))

query("nan_policy_keep", "WITH {bars_n}, {feats_n}, p AS (SELECT timestamp, symbol, return_21d, vol_std_60d FROM feats) "
      + rounded_sql("p", *_K))(
    lambda t: rounded(FT.apply_nan_policy(
        FT.compute_features(t.bars_n, ["return_21d", "vol_std_60d"]), ["return_21d", "vol_std_60d"], "keep")))
query("nan_policy_drop", "WITH {bars_n}, {feats_n}, p AS (SELECT timestamp, symbol, return_21d, vol_std_60d FROM feats "
      "WHERE return_21d IS NOT NULL AND vol_std_60d IS NOT NULL) " + rounded_sql("p", *_K))(
    lambda t: rounded(FT.apply_nan_policy(
        FT.compute_features(t.bars_n, ["return_21d", "vol_std_60d"]), ["return_21d", "vol_std_60d"], "drop")))
query("nan_policy_error", "WITH {bars_n}, p AS (SELECT timestamp, symbol, close, volume FROM bars_n) "
      + rounded_sql("p", *_K))(
    lambda t: rounded(FT.apply_nan_policy(
        t.bars_n.select("timestamp", "symbol", "close", "volume"), ["close", "volume"], "error")))

query("feature_report", "WITH {bars_s}, {feats_s} " + " UNION ALL ".join(
    f"SELECT '{c}' AS feature, count(*) AS rows, count(*) - count({c}) AS missing, "
    f"count(*) FILTER (WHERE isinf({c})) AS infinite FROM feats" for c in ALL_FEATURES))(
    lambda t: FT.feature_report(t.over_bars_s(FT.compute_features), ALL_FEATURES))

query("missing_counts", "WITH {bars_n}, {feats_n} SELECT " + ", ".join(
    f"count(*) - count({c}) AS {c}" for c in ALL_FEATURES) + " FROM feats")(
    lambda t: FT.compute_features(t.bars_n).agg(
        *[F.count_if(F.col(c).isNull()).alias(c) for c in ALL_FEATURES]))


@query("leakage_check")
def _leakage(t):
    """Rows at or before the cut whose features change when the future is scaled."""
    bars = t.bars_n
    cut = F.lit("1998-06-30").cast("timestamp_ntz")
    late = F.col("timestamp") > cut
    factors = {"open": 5.0, "high": 10.0, "low": 0.1, "close": 8.0, "volume": 100.0}
    bent = bars.withColumns({c: F.when(late, F.col(c) * k).otherwise(F.col(c))
                             for c, k in factors.items()})
    base = rounded(FT.compute_features(bars), 9).filter(~late)
    return base.exceptAll(rounded(FT.compute_features(bent), 9).filter(~late)).agg(
        F.count(F.lit(1)).alias("changed_rows"))


# ---------------------------------------------------------------- helpers and chart indicators

query("sma", "WITH {bars_s}, p AS (SELECT timestamp, symbol, " + ", ".join(
    f"CASE WHEN row_number() OVER w >= {k} THEN avg(close) OVER (w ROWS BETWEEN {k - 1} PRECEDING AND CURRENT ROW) END AS sma_{k}"
    for k in (10, 20, 50)) + " FROM bars_s WINDOW w AS (PARTITION BY symbol ORDER BY timestamp)) "
      + rounded_sql("p", *_K))(
    lambda t: rounded(t.over_bars_s(partial(FT.compute_features, features=[
        FT.Feature(f"sma_{k}", "MOMENTUM", ("close",), k, lambda b, k=k: b.roll("avg", "close", k))
        for k in (10, 20, 50)]))))
query("true_range", "WITH {bars_s}, {feats_s}, p AS (SELECT timestamp, symbol, tr AS true_range FROM valued) "
      + rounded_sql("p", *_K))(
    lambda t: rounded(t.over_bars_s(partial(FT.compute_features, features=[FT.Feature(
        "true_range", "VOLATILITY", ("high", "low", "close"), 1, lambda b: b.true_range())]))))

_CANDLE_SQL = """, steps AS (SELECT *, row_number() OVER w AS n, close - lag(close) OVER w AS d FROM bars_n
  WINDOW w AS (PARTITION BY symbol ORDER BY timestamp)),
candle AS (SELECT timestamp, symbol, open, high, low, close, volume,
  CASE WHEN n >= 15 AND avg(greatest(-d, 0)) OVER f14 > 0
       THEN 100 - 100 / (1 + avg(greatest(d, 0)) OVER f14 / avg(greatest(-d, 0)) OVER f14) ELSE 50 END AS rsi_14,
  avg(close) OVER f20 AS sma_20, avg(close) OVER f50 AS sma_50,
  list_reduce(list(close) OVER (PARTITION BY symbol ORDER BY timestamp ROWS UNBOUNDED PRECEDING),
              lambda a, x: a + (2.0::DOUBLE / 21) * (x - a)) AS ema_20
  FROM steps WINDOW f14 AS (PARTITION BY symbol ORDER BY timestamp ROWS BETWEEN 13 PRECEDING AND CURRENT ROW),
  f20 AS (PARTITION BY symbol ORDER BY timestamp ROWS BETWEEN 19 PRECEDING AND CURRENT ROW),
  f50 AS (PARTITION BY symbol ORDER BY timestamp ROWS BETWEEN 49 PRECEDING AND CURRENT ROW))"""
SQL_PARTS["candle"] = _CANDLE_SQL.lstrip(", ")

for _name, _cols in {"rsi_14": ["rsi_14"], "candle_sma": ["sma_20", "sma_50"], "candle_ema_20": ["ema_20"]}.items():
    query(_name, "WITH {bars_n}, {candle}, p AS (SELECT timestamp, symbol, " + ", ".join(_cols) + " FROM candle) "
          + rounded_sql("p", *_K))(
        lambda t, cols=_cols: rounded(IND.candles(t.bars_n, digits=None).select("timestamp", "symbol", *cols)))
_CANDLE_OUT = """SELECT timestamp, symbol, round(open + 1.3e-9, 2) AS open, round(high + 1.3e-9, 2) AS high,
  round(low + 1.3e-9, 2) AS low, round(close + 1.3e-9, 2) AS close, CAST(trunc(volume) AS BIGINT) AS volume,
  round(sma_20 + 1.3e-9, 2) AS sma_20, round(sma_50 + 1.3e-9, 2) AS sma_50, round(ema_20 + 1.3e-9, 2) AS ema_20, round(rsi_14 + 1.3e-9, 1) AS rsi_14
  FROM candle"""
query("candles", "WITH {bars_n}, {candle} " + _CANDLE_OUT)(lambda t: IND.candles(t.bars_n))


def _ticks_sql(start, table):
    """Bars of another interval, under the name that the candle SQL reads."""
    symbol, price, seq, source = {
        "events": ("upper(event_type)", "value", "event_id", "events"),
        "orders": ("n_name", "o_totalprice", "o_orderkey", "orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey")}[table]
    return (f"all_bars AS (SELECT CAST({start} AS TIMESTAMP) AS timestamp, {symbol} AS symbol, min_by({price}, {seq}) AS open, max({price}) AS high, min({price}) AS low, "
            f"max_by({price}, {seq}) AS close, CAST(count(*) AS DOUBLE) AS volume FROM {source} GROUP BY 1, 2)")


def _event_chart(t, period):
    return IND.chart(t.events, period, F.upper("event_type"), F.col("ts"), F.col("value"), None, F.col("event_id"))


def _order_chart(t, period):
    home = t.customer.join(F.broadcast(t.nation), F.col("c_nationkey") == F.col("n_nationkey"))
    ticks = t.orders.join(home, F.col("o_custkey") == F.col("c_custkey"))
    return IND.chart(ticks, period, F.col("n_name"), F.col("o_orderdate"), F.col("o_totalprice"), None, F.col("o_orderkey"))


_DAYS = "bars_n AS (SELECT * FROM all_bars QUALIFY dense_rank() OVER (PARTITION BY symbol ORDER BY CAST(timestamp AS DATE) DESC) <= {0})"
_MONTHS = "bars_n AS (SELECT * FROM all_bars QUALIFY timestamp > max(timestamp) OVER (PARTITION BY symbol) - INTERVAL {0} MONTH)"
for _name, _period, _start, _table, _span, _chart in (
        ("candles_1d_5m", "1D", "time_bucket(INTERVAL 5 MINUTE, ts)", "events", _DAYS.format(1), _event_chart),
        ("candles_1w_15m", "1W", "time_bucket(INTERVAL 15 MINUTE, ts)", "events", _DAYS.format(5), _event_chart),
        ("candles_3m_daily", "3M", "CAST(o_orderdate AS DATE)", "orders", _MONTHS.format(3), _order_chart),
        ("candles_5y_weekly", "5Y", "date_trunc('week', o_orderdate)", "orders", _MONTHS.format(60), _order_chart)):
    query(_name, f"WITH {_ticks_sql(_start, _table)}, {_span}, {{candle}} " + _CANDLE_OUT)(
        lambda t, chart=_chart, period=_period: chart(t, period))
query("candles_15m", f"WITH {_ticks_sql('time_bucket(INTERVAL 15 MINUTE, ts)', 'events')}, bars_n AS (SELECT * FROM all_bars), {{candle}}, p AS "
      "(SELECT timestamp, symbol, sma_20, sma_50, ema_20, rsi_14 FROM candle) " + rounded_sql("p", *_K))(
    lambda t: rounded(IND.candles(B.event_bars(t.events, "15 minutes"), None, "15 minutes").select("timestamp", "symbol", "sma_20", "sma_50", "ema_20", "rsi_14")))

# ---------------------------------------------------------------- targets


def target_sql(part: str) -> str:
    ahead = ", ".join(f"lead(close, {h}) OVER w AS f{h}" for h in (1, 3, 5, 10, 20, 21))
    out = []
    for h in (1, 3, 5, 10, 20, 21):
        out.append(f"CASE WHEN close > 0 THEN (f{h} - close) / close END AS target_fwd_ret_{h}d")
        out.append(f"CASE WHEN close > 0 AND f{h} > 0 THEN ln(f{h} / close) END AS target_fwd_logret_{h}d")
        out.append(f"CASE WHEN close > 0 AND f{h} IS NOT NULL THEN CASE WHEN (f{h} - close) / close > 0 "
                   f"THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END END AS target_binary_up_{h}d")
    for h in (5, 10):
        out.append(f"CASE WHEN close > 0 AND f{h} IS NOT NULL THEN CASE WHEN (f{h} - close) / close > 0.01 "
                   f"THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END END AS target_binary_gt1pct_{h}d")
    for h in (5, 10, 20, 21):
        out.append(f"CASE WHEN f{h} IS NOT NULL THEN stddev_samp(r1) OVER (PARTITION BY symbol ORDER BY timestamp "
                   f"ROWS BETWEEN 1 FOLLOWING AND {h} FOLLOWING) * sqrt(252) END AS target_fwd_vol_{h}d")
    return f"""led AS (SELECT *, close / nullif(lag(close) OVER w, 0) - 1 AS r1, {ahead}
  FROM {part} WINDOW w AS (PARTITION BY symbol ORDER BY timestamp)),
labels_t AS (SELECT timestamp, symbol, {', '.join(out)} FROM led)"""


for _part in ("bars_s", "bars_n", "bars_e"):
    SQL_PARTS[f"targets_{_part[-1]}"] = target_sql(_part)

ALL_TARGETS = [x.name for x in TG.REGISTRY.select()]


def _targets(name, columns, part="bars_s", grain="day", targets=None):
    sql = (f"WITH {{{part}}}, {{targets_{part[-1]}}}, p AS (SELECT {KEYS}, {', '.join(columns)} FROM labels_t) "
           + rounded_sql("p", *_K))
    use = partial(TG.compute_targets, names=columns, targets=targets, grain=grain, keep_bars=False)
    query(name, sql)(lambda t: rounded(_over(t, part, grain, use)))


for _t in ALL_TARGETS:
    _targets(_t, [_t])
_targets("target_matrix", ALL_TARGETS)
_targets("target_matrix_hourly", ALL_TARGETS, "bars_e", "hour")
_targets("target_fwd_logret", ["target_fwd_logret_1d", "target_fwd_logret_5d"], targets=[
    TG.Target("target_fwd_logret_1d", "forward_log_return", 1),
    TG.Target("target_fwd_logret_5d", "forward_log_return", 5)])
_targets("target_shorthand", [TG.resolve_target("binary_up", 5), TG.resolve_target("fwd_vol", 10)], "bars_n")

query("target_report", "WITH {bars_s}, {targets_s} " + " UNION ALL ".join(
    f"SELECT count(*) AS rows, count(DISTINCT symbol) AS symbols, '{c}' AS target, "
    f"count(*) - count({c}) AS missing FROM labels_t" for c in ALL_TARGETS))(
    lambda t: TG.target_report(t.over_bars_s(partial(TG.compute_targets, keep_bars=False)), ALL_TARGETS))
query("drop_unavailable", "WITH {bars_n}, {targets_n}, p AS (SELECT timestamp, symbol, target_fwd_ret_5d, target_fwd_vol_21d "
      "FROM labels_t WHERE target_fwd_ret_5d IS NOT NULL AND target_fwd_vol_21d IS NOT NULL) " + rounded_sql("p", *_K))(
    lambda t: rounded(TG.compute_targets(t.bars_n, ["target_fwd_ret_5d", "target_fwd_vol_21d"], keep_bars=False)
                      .dropna(subset=["target_fwd_ret_5d", "target_fwd_vol_21d"])))
