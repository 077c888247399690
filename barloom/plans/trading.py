"""Queries over signals, performance, risk checks and account ledgers."""

from __future__ import annotations

from pyspark.sql import functions as F

from barloom.functions.features import compute_features
from barloom.operators import ledger as L
from barloom.operators import performance as P
from barloom.operators import risk as K
from barloom.operators import signals as S
from barloom.operators import splits as SP
from barloom.operators import walkforward as WF
from barloom.panel import cut, time_block
from barloom.plans.core import SQL_PARTS, query, rounded, rounded_sql

ENTER, LEAVE, CASH, SHARE = 0.8, 0.3, 100_000.0, 0.005
COSTS = S.Costs()


def sig(t, part="bars_n", grain="day"):
    """Bars with a stored score: closeness to the low of the last 20 bars."""
    f = compute_features(getattr(t, part), ["range_pos_20d"], grain=grain, keep_bars=True)
    return f.withColumn("p", 1 - F.col("range_pos_20d")).drop("range_pos_20d")


def held(t, part="bars_n", grain="day", enter=ENTER, leave=LEAVE):
    return S.held_bars(sig(t, part, grain), enter, leave, COSTS, grain=grain)


def _chain(x, enter=ENTER, leave=LEAVE):
    b = f"bars_{x}"
    return f"""{{{b}}}, sig AS (SELECT *, 1 - CASE WHEN row_number() OVER w < 20 THEN NULL
    WHEN max(high) OVER f - min(low) OVER f <= 1e-8 THEN 0.5
    ELSE least(1, greatest(0, (close - min(low) OVER f) / (max(high) OVER f - min(low) OVER f))) END AS p FROM {b}
  WINDOW w AS (PARTITION BY symbol ORDER BY timestamp),
    f AS (PARTITION BY symbol ORDER BY timestamp ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)),
st AS (SELECT *, coalesce(last_value(CASE WHEN p >= {enter} THEN 1 WHEN p <= {leave} THEN 0 END IGNORE NULLS) OVER
  (PARTITION BY symbol ORDER BY timestamp ROWS UNBOUNDED PRECEDING), 0) AS position FROM sig),
h1 AS (SELECT *, coalesce(lag(position) OVER w, 0) AS held, lag(close) OVER w AS prev_close, row_number() OVER w AS n,
  count(*) OVER (PARTITION BY symbol) AS total FROM st WINDOW w AS (PARTITION BY symbol ORDER BY timestamp)),
h2 AS (SELECT *, coalesce(lag(held) OVER (PARTITION BY symbol ORDER BY timestamp), 0) AS hb FROM h1),
h3 AS (SELECT *, CASE WHEN held > hb THEN 'BUY' WHEN held < hb THEN 'SELL' END AS action,
  CASE WHEN held > hb THEN least(open * 1.0005, high) WHEN held < hb THEN greatest(open * 0.9995, low) END AS fill FROM h2),
held AS (SELECT *, sum(CASE WHEN action = 'BUY' THEN 1 ELSE 0 END) OVER
  (PARTITION BY symbol ORDER BY timestamp ROWS UNBOUNDED PRECEDING) AS trip FROM h3),
last_bar AS (SELECT symbol, timestamp AS lt, close AS lc, low AS ll, n AS ln FROM held WHERE n = total),
tr0 AS (SELECT symbol, trip, max(timestamp) FILTER (action = 'BUY') AS entry_time, max(fill) FILTER (action = 'BUY') AS entry_price,
  max(n) FILTER (action = 'BUY') AS ni, max(timestamp) FILTER (action = 'SELL') AS xt, max(fill) FILTER (action = 'SELL') AS xp,
  max(n) FILTER (action = 'SELL') AS nx FROM held WHERE trip > 0 AND action IS NOT NULL GROUP BY 1, 2),
tr1 AS (SELECT symbol, trip, entry_time, coalesce(xt, lt) AS exit_time, 100.0::DOUBLE AS quantity, entry_price,
  coalesce(xp, greatest(lc * 0.9995, ll)) AS exit_price, coalesce(nx, ln) - ni AS holding_bars,
  CASE WHEN xt IS NULL THEN 'end_of_simulation' ELSE 'signal_exit' END AS exit_reason FROM tr0 JOIN last_bar USING (symbol)),
tr2 AS (SELECT *, quantity * (exit_price - entry_price) AS gross_pnl,
  quantity * (entry_price + exit_price) * 0.0005 + 2 AS total_fees FROM tr1),
trips AS (SELECT *, gross_pnl - total_fees AS net_pnl, (gross_pnl - total_fees) / (quantity * entry_price) AS pnl_pct FROM tr2),
eq0 AS (SELECT *, ((CASE WHEN action = 'BUY' THEN close / fill WHEN action = 'SELL' THEN fill / prev_close
  WHEN held = 1 THEN close / prev_close ELSE 1 END) * (CASE WHEN action IS NULL THEN 1 ELSE 0.9995 END) - 1) * {SHARE} AS daily_return FROM held),
eq AS (SELECT *, sum(ln(1 + daily_return)) OVER (PARTITION BY symbol ORDER BY timestamp ROWS UNBOUNDED PRECEDING) AS log_equity FROM eq0),
curve AS (SELECT symbol AS run_id, timestamp, {CASH} * exp(log_equity) AS portfolio_equity, daily_return,
  held * {CASH} * exp(log_equity) * {SHARE} AS gross_exposure FROM eq),
dd AS (SELECT *, greatest(max(portfolio_equity) OVER (PARTITION BY run_id ORDER BY timestamp ROWS UNBOUNDED PRECEDING), {CASH}) AS high_water_mark FROM curve),
curved AS (SELECT *, (portfolio_equity - high_water_mark) / high_water_mark AS drawdown FROM dd)"""


for _x in ("n", "s", "e"):
    SQL_PARTS[f"chain_{_x}"] = _chain(_x)

_C = "WITH {chain_n} "
_KS = ("timestamp", "symbol")
query("signal_entries_exits", _C + f"SELECT timestamp, symbol, CASE WHEN p >= {ENTER} THEN 1 ELSE 0 END AS enter, "
      f"CASE WHEN p <= {LEAVE} THEN 1 ELSE 0 END AS leave FROM sig")(
    lambda t: S.entries_exits(sig(t), ENTER, LEAVE).select("timestamp", "symbol", "enter", "leave"))
query("signal_position", _C + "SELECT timestamp, symbol, position FROM st")(
    lambda t: S.position_state(sig(t), ENTER, LEAVE).select("timestamp", "symbol", "position"))
query("signal_position_hourly", "WITH {chain_e} SELECT timestamp, symbol, position FROM st")(
    lambda t: S.position_state(sig(t, "bars_e", "hour"), ENTER, LEAVE, grain="hour").select(
        "timestamp", "symbol", "position"))
query("next_bar_fill", "WITH {bars_s}, p AS (SELECT timestamp, symbol, lead(timestamp) OVER w AS fill_time, lead(open) OVER w AS base_price, "
      "least(lead(open) OVER w * 1.0005, lead(high) OVER w) AS buy_fill, greatest(lead(open) OVER w * 0.9995, lead(low) OVER w) AS sell_fill "
      "FROM bars_s WINDOW w AS (PARTITION BY symbol ORDER BY timestamp)) " + rounded_sql("p", "timestamp", "symbol", "fill_time"))(
    lambda t: rounded(S.next_bar_fill(t.bars_s).select(
        "timestamp", "symbol", "fill_time", "base_price", "buy_fill", "sell_fill")))
query("fill_costs", """WITH {bars_n}, f AS (SELECT timestamp, symbol, lead(open) OVER w AS o, lead(high) OVER w AS h, lead(volume) OVER w AS v
  FROM bars_n WINDOW w AS (PARTITION BY symbol ORDER BY timestamp)),
  g AS (SELECT *, least(o * 1.0005, h) AS px, least(0.5, v * 0.1) AS q FROM f WHERE o IS NOT NULL)
  SELECT timestamp, symbol, round(q + 1.3e-9, 6) AS filled_quantity, round(q * px + 1.3e-9, 6) AS traded_value,
  round(q * abs(px - o) + 1.3e-9, 6) AS slippage_cost, round(q * px * 0.0005 + 1 + 1.3e-9, 6) AS fee FROM g""")(
    lambda t: rounded(S.fill_costs(
        S.next_bar_fill(t.bars_n).filter(F.col("base_price").isNotNull()), F.lit(0.5), F.col("buy_fill"),
        F.col("base_price"), F.col("fill_volume")).select(
            "timestamp", "symbol", "filled_quantity", "traded_value", "slippage_cost", "fee")))
query("held_bars", _C + "SELECT timestamp, symbol, held, action, round(fill + 1.3e-9, 6) AS fill, CAST(trip AS BIGINT) AS trip FROM held")(
    lambda t: rounded(held(t).select("timestamp", "symbol", "held", "action", "fill", "trip")))

_TRIP = ("SELECT symbol, CAST(trip AS BIGINT) AS trip, entry_time, exit_time, " + ", ".join(
    f"round({c} + 1.3e-9, 4) AS {c}" for c in ("entry_price", "exit_price", "gross_pnl", "total_fees", "net_pnl", "pnl_pct"))
    + ", holding_bars, exit_reason FROM trips")
_TRIP_COLS = ["symbol", "trip", "entry_time", "exit_time", "entry_price", "exit_price", "gross_pnl", "total_fees",
              "net_pnl", "pnl_pct", "holding_bars", "exit_reason"]
query("round_trips", _C + _TRIP)(lambda t: rounded(S.round_trips(held(t)).select(*_TRIP_COLS), 4))
query("round_trips_hourly", "WITH {chain_e} " + _TRIP)(
    lambda t: rounded(S.round_trips(held(t, "bars_e", "hour")).select(*_TRIP_COLS), 4))

_SL, _TP, _H = 0.05, 0.10, 21
SQL_PARTS["barrier"] = """bx AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY timestamp) AS i,
  count(*) OVER (PARTITION BY symbol) AS m FROM sig),
en AS (SELECT a.symbol, a.timestamp AS signal_time, b.timestamp AS entry_time, b.i AS e, b.m AS m,
  least(b.open * 1.0005, b.high) AS entry_price FROM bx a JOIN bx b ON a.symbol = b.symbol AND b.i = a.i + 1 WHERE a.p >= 0.8),
grid AS (SELECT * FROM (VALUES (0.05::DOUBLE, 0.10::DOUBLE, 21), (0.02, 0.04, 5), (0.10, 0.30, 10)) v(sl, tp, hz)),
ask AS (SELECT en.symbol, signal_time, sl, tp, hz, min(b.i) AS j FROM en CROSS JOIN grid JOIN bx b ON en.symbol = b.symbol
  AND b.i BETWEEN e AND e + hz AND b.i < b.m WHERE (b.close - entry_price) / entry_price <= -sl
  OR (b.close - entry_price) / entry_price >= tp OR b.i - e >= hz OR b.p <= 0.3 GROUP BY ALL),
res AS (SELECT en.*, grid.*, j, coalesce(j + 1, m) AS x FROM en CROSS JOIN grid LEFT JOIN ask USING (symbol, signal_time, sl, tp, hz)),
bt AS (SELECT r.symbol, r.signal_time, r.entry_time, b.timestamp AS exit_time, r.entry_price, sl, tp, hz, x - e AS holding_bars,
  greatest(CASE WHEN j IS NULL THEN b.close ELSE b.open END * 0.9995, b.low) AS exit_price,
  CASE WHEN j IS NULL THEN 'end_of_simulation' WHEN (q.close - r.entry_price) / r.entry_price <= -sl THEN 'stop_loss'
    WHEN (q.close - r.entry_price) / r.entry_price >= tp THEN 'take_profit' WHEN j - e >= hz THEN 'max_holding_period'
    ELSE 'signal_exit' END AS exit_reason
  FROM res r JOIN bx b ON r.symbol = b.symbol AND b.i = x LEFT JOIN bx q ON r.symbol = q.symbol AND q.i = j),
bp AS (SELECT *, (100 * (exit_price - entry_price) - 100 * (entry_price + exit_price) * 0.0005 - 2) AS net_pnl FROM bt)"""
_BARRIER = """SELECT symbol, signal_time, entry_time, exit_time, round(entry_price + 1.3e-9, 4) AS entry_price,
  round(exit_price + 1.3e-9, 4) AS exit_price, round(net_pnl + 1.3e-9, 4) AS net_pnl, holding_bars, exit_reason FROM bp WHERE hz = 21"""
_BCOLS = ["symbol", "signal_time", "entry_time", "exit_time", "entry_price", "exit_price", "net_pnl", "holding_bars", "exit_reason"]
query("barrier_exit", _C + ", {barrier} " + _BARRIER)(
    lambda t: rounded(S.barrier_exits(sig(t), ENTER, LEAVE, S.Barriers(_SL, _TP, _H)).select(*_BCOLS)
                      .withColumn("holding_bars", F.col("holding_bars").cast("bigint")), 4))
query("barrier_exit_hourly", "WITH {chain_e}, {barrier} " + _BARRIER)(
    lambda t: rounded(S.barrier_exits(sig(t, "bars_e", "hour"), ENTER, LEAVE, S.Barriers(_SL, _TP, _H), grain="hour")
                      .select(*_BCOLS).withColumn("holding_bars", F.col("holding_bars").cast("bigint")), 4))
GRID = [S.Barriers(0.05, 0.10, 21), S.Barriers(0.02, 0.04, 5), S.Barriers(0.10, 0.30, 10)]
query("param_sweep", _C + """, {barrier} SELECT sl AS stop_loss, tp AS take_profit, hz AS holding, count(*) AS trades,
  round(avg(net_pnl / (100 * entry_price)) + 1.3e-9, 6) AS avg_pnl_pct,
  round(avg(CASE WHEN net_pnl > 0 THEN 1.0 ELSE 0 END) + 1.3e-9, 6) AS win_rate, round(avg(holding_bars) + 1.3e-9, 6) AS avg_holding
  FROM bp GROUP BY 1, 2, 3""")(lambda t: rounded(S.param_sweep(sig(t), ENTER, LEAVE, GRID)))
ENTERS, LEAVES = [0.8, 0.9, 0.97], [0.1, 0.3]
OPEN_GRID = [S.Barriers(), S.Barriers(stop_loss=0.08), S.Barriers(take_profit=0.2, holding=40)]
SQL_PARTS["sweep"] = SQL_PARTS["barrier"].replace("(0.05::DOUBLE, 0.10::DOUBLE, 21), (0.02, 0.04, 5), (0.10, 0.30, 10)) v(sl, tp, hz))",
    "(NULL::DOUBLE, NULL::DOUBLE, NULL::INT), (0.08, NULL, NULL), (NULL, 0.2, 40)) v(sl, tp, hz)), lv AS (SELECT * FROM (VALUES (0.1::DOUBLE), (0.3)) v(lv))").replace(
    "en.symbol, signal_time, sl, tp, hz, min", "en.symbol, signal_time, e, sl, tp, hz, lv, min").replace("CROSS JOIN grid JOIN bx b", "CROSS JOIN grid CROSS JOIN lv JOIN bx b").replace(
    "AND b.i BETWEEN e AND e + hz AND", "AND b.i >= e AND").replace("b.p <= 0.3", "b.p <= lv").replace("SELECT en.*, grid.*, j", "SELECT en.*, grid.*, lv.lv, j").replace(
    "FROM en CROSS JOIN grid LEFT JOIN ask USING (symbol, signal_time, sl, tp, hz))",
    "FROM en CROSS JOIN grid CROSS JOIN lv LEFT JOIN ask ON en.symbol = ask.symbol AND en.signal_time = ask.signal_time AND grid.sl IS NOT DISTINCT FROM ask.sl "
    "AND grid.tp IS NOT DISTINCT FROM ask.tp AND grid.hz IS NOT DISTINCT FROM ask.hz AND lv.lv = ask.lv)").replace(
    "r.entry_price, sl, tp, hz,", "r.entry_price, r.score, sl, tp, hz, lv,").replace("SELECT a.symbol, a.timestamp", "SELECT a.p AS score, a.symbol, a.timestamp")
query("threshold_sweep", _C + """, {sweep}, ev AS (SELECT * FROM (VALUES (0.8::DOUBLE), (0.9), (0.97)) v(enter))
  SELECT enter, lv AS leave, sl AS stop_loss, tp AS take_profit, CAST(hz AS DOUBLE) AS holding, count(*) AS trades,
  round(avg(net_pnl / (100 * entry_price)) + 1.3e-9, 6) AS avg_pnl_pct, round(avg(CASE WHEN net_pnl > 0 THEN 1.0 ELSE 0 END) + 1.3e-9, 6) AS win_rate,
  round(avg(holding_bars) + 1.3e-9, 6) AS avg_holding FROM bp JOIN ev ON score >= enter GROUP BY ALL""")(
    lambda t: rounded(S.threshold_sweep(sig(t), ENTERS, LEAVES, OPEN_GRID).withColumn("holding", F.col("holding").cast("double"))))
query("barrier_exit_open", _C + """, {sweep} SELECT symbol, signal_time, entry_time, exit_time, round(entry_price + 1.3e-9, 4) AS entry_price,
  round(exit_price + 1.3e-9, 4) AS exit_price, round(net_pnl + 1.3e-9, 4) AS net_pnl, holding_bars, exit_reason FROM bp
  WHERE hz IS NULL AND sl = 0.08 AND lv = 0.1""")(
    lambda t: rounded(S.barrier_exits(sig(t), ENTER, 0.1, S.Barriers(stop_loss=0.08)).select(*_BCOLS)
                      .withColumn("holding_bars", F.col("holding_bars").cast("bigint")), 4))
query("oos_only", _C + """, f AS (SELECT *, CASE WHEN n - 1 >= CAST(floor(total * 0.8::DOUBLE) AS BIGINT) THEN 1 ELSE 0 END AS oos FROM h1)
  SELECT timestamp, symbol, round(p + 1.3e-9, 6) AS p, position FROM f WHERE oos = 1""")(
    lambda t: rounded(SP.split_by_ratio(S.position_state(sig(t), ENTER, LEAVE)).filter("fold = 'test'").select(
        "timestamp", "symbol", "p", "position")))
query("signal_equity", _C + "SELECT timestamp, symbol, round(daily_return + 1.3e-9, 6) AS daily_return, "
      "round(log_equity + 1.3e-9, 6) AS log_equity FROM eq")(
    lambda t: rounded(S.signal_equity(held(t), fraction=SHARE).select(
        "timestamp", "symbol", "daily_return", "log_equity")))
query("signal_equity_hourly", "WITH {chain_e} SELECT timestamp, symbol, round(log_equity + 1.3e-9, 6) AS log_equity FROM eq")(
    lambda t: rounded(S.signal_equity(held(t, "bars_e", "hour"), fraction=SHARE, grain="hour").select(
        "timestamp", "symbol", "log_equity")))

# ---------------------------------------------------------------- performance


def curve(t, positions=None):
    """Equity curve per run (one run per symbol)."""
    eq = S.signal_equity(positions or held(t), fraction=SHARE)
    return eq.select(
        F.col("symbol").alias("run_id"), "timestamp", (F.col("equity") * CASH).alias("portfolio_equity"),
        "daily_return", (F.col("held") * F.col("equity") * CASH * SHARE).alias("gross_exposure"))


def curved(t, positions=None):
    return P.drawdown_curve(curve(t, positions), CASH)


def trips(t, positions=None):
    return S.round_trips(positions or held(t), quantity=1.0).withColumnRenamed("symbol", "run_id")


query("equity_returns", _C + f""", r AS (SELECT run_id, timestamp, coalesce(lag(portfolio_equity) OVER (PARTITION BY run_id ORDER BY timestamp), {CASH}) AS b,
  portfolio_equity FROM curve) SELECT run_id, timestamp, round((portfolio_equity - b) / b + 1.3e-9, 6) AS daily_return FROM r""")(
    lambda t: rounded(P.equity_returns(curve(t).drop("daily_return"), CASH).select("run_id", "timestamp", "daily_return")))
query("drawdown_curve", _C + "SELECT run_id, timestamp, round(drawdown + 1.3e-9, 6) AS drawdown FROM curved")(
    lambda t: rounded(curved(t).select("run_id", "timestamp", "drawdown")))

SQL_PARTS["perf"] = f"""pe AS (SELECT run_id, count(*) AS bars, max_by(portfolio_equity, timestamp) AS final_equity, stddev_samp(daily_return) * sqrt(252) AS volatility,
  abs(min(drawdown)) AS maximum_drawdown, coalesce(CASE WHEN count(*) FILTER (daily_return < 0) = 1 THEN abs(min(daily_return))
    ELSE stddev_samp(daily_return) FILTER (daily_return < 0) END, 0) * sqrt(252) AS down,
  avg(portfolio_equity) AS mean_equity, avg(CASE WHEN abs(gross_exposure) > 1e-5 THEN 1.0 ELSE 0 END) AS exposure_time_pct FROM curved GROUP BY 1),
pt AS (SELECT symbol AS run_id, count(*) AS trade_count, count(*) FILTER (pnl > 0) AS win_count, count(*) FILTER (pnl < 0) AS loss_count,
  coalesce(sum(pnl) FILTER (pnl > 0), 0) AS gross_profit, coalesce(-sum(pnl) FILTER (pnl < 0), 0) AS gross_loss, sum(fees) AS total_fees,
  sum(pnl) AS net_profit, sum(entry_price + exit_price) AS traded FROM
  (SELECT *, (entry_price + exit_price) * 0.0005 + 2 AS fees, exit_price - entry_price - ((entry_price + exit_price) * 0.0005 + 2) AS pnl FROM trips) GROUP BY 1),
pc AS (SELECT *, (final_equity - {CASH}) / {CASH} AS total_return, (final_equity / {CASH}) ** (252.0 / bars) - 1 AS annualized_return FROM pe),
perf AS (SELECT run_id, total_return, annualized_return, volatility, maximum_drawdown,
  CASE WHEN volatility > 1e-8 THEN (annualized_return - 0.02) / volatility ELSE 0 END AS sharpe_ratio,
  CASE WHEN down > 1e-8 THEN (annualized_return - 0.02) / down ELSE 0 END AS sortino_ratio, win_count / trade_count AS win_rate,
  coalesce(gross_profit / nullif(win_count, 0), 0) AS average_win, coalesce(-gross_loss / nullif(loss_count, 0), 0) AS average_loss,
  CASE WHEN gross_loss > 1e-8 THEN gross_profit / gross_loss WHEN gross_profit > 1e-8 THEN NULL ELSE 0 END AS profit_factor,
  traded / (2 * mean_equity) AS turnover, trade_count, win_count, loss_count, total_fees, gross_profit, gross_loss, net_profit,
  exposure_time_pct, {CASH}::DOUBLE AS initial_cash, final_equity FROM pc JOIN pt USING (run_id))"""
_INTS = ("trade_count", "win_count", "loss_count")
_PF = _C + ", {perf} "


def metrics(t):
    """Curve and trades come from the same positions, so these are written once."""
    positions = cut(held(t))
    return P.perf_metrics(curved(t, positions), trips(t, positions), CASH)


query("perf_metrics", _PF + rounded_sql("perf", "run_id", *_INTS, digits=4))(lambda t: rounded(metrics(t), 4))
for _name, _cols in {
        "total_return": ["total_return", "initial_cash", "final_equity"], "annualized_return": ["annualized_return"],
        "volatility": ["volatility"], "max_drawdown": ["maximum_drawdown"], "sharpe": ["sharpe_ratio"], "sortino": ["sortino_ratio"],
        "win_rate": ["win_rate", "win_count", "loss_count", "trade_count"],
        "average_win_loss": ["average_win", "average_loss", "gross_profit", "gross_loss"], "profit_factor": ["profit_factor"],
        "turnover": ["turnover"], "fees_exposure": ["total_fees", "net_profit", "exposure_time_pct"]}.items():
    query(_name, _PF + f"SELECT run_id, {', '.join(c if c in _INTS else f'round({c} + 1.3e-9, 4) AS {c}' for c in _cols)} FROM perf")(
        lambda t, cols=_cols: rounded(metrics(t).select("run_id", *cols), 4))
query("exit_reason_mix", _C + "SELECT exit_reason, count(*) AS trades, round(sum(net_pnl) + 1.3e-6, 2) AS net_pnl FROM trips GROUP BY 1")(
    lambda t: rounded(P.exit_reason_mix(S.round_trips(held(t))), 2))
query("topk_recent_trades", _C + """SELECT symbol AS run_id, CAST(trip AS BIGINT) AS trip, entry_time, exit_time FROM trips
  QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY exit_time DESC, trip DESC) <= 5""")(
    lambda t: P.recent_trades(trips(t)).select("run_id", "trip", "entry_time", "exit_time"))
query("run_inspect", _PF + """SELECT run_id, CAST(trip AS BIGINT) AS trip, exit_time, round(sharpe_ratio + 1.3e-9, 4) AS sharpe_ratio, trade_count
  FROM (SELECT *, symbol AS run_id FROM trips QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY exit_time DESC, trip DESC) <= 5)
  JOIN perf USING (run_id) WHERE run_id = 'NATION_3'""")(
    lambda t: rounded(P.recent_trades(trips(t).filter("run_id = 'NATION_3'")).join(
        metrics(t).filter("run_id = 'NATION_3'"), "run_id").select(
            "run_id", "trip", "exit_time", "sharpe_ratio", "trade_count"), 4))


def run_catalog(t):
    return curve(t).groupBy("run_id").agg(F.max("timestamp").alias("created_at"))


query("run_leaderboard", _PF + """SELECT run_id, created_at, round(total_return + 1.3e-9, 4) AS total_return, trade_count FROM perf
  JOIN (SELECT run_id, max(timestamp) AS created_at FROM curve GROUP BY 1) USING (run_id) WHERE contains(lower(run_id), 'nation_1')
  ORDER BY created_at DESC, run_id LIMIT 5""")(
    lambda t: rounded(P.leaderboard(metrics(t), run_catalog(t), "Nation_1", 5).select(
        "run_id", "created_at", "total_return", "trade_count"), 4))


# Walk-forward over the stored scores: folds on the calendar of all symbols.
WALK = SP.WalkForward(n_folds=4, min_train=60, gap=5)
SQL_PARTS["walk"] = f"""cal AS (SELECT timestamp, row_number() OVER (ORDER BY timestamp) - 1 AS pos, count(*) OVER () AS dates FROM (SELECT DISTINCT timestamp FROM sig)),
wd AS (SELECT *, greatest(10, (dates - {WALK.min_train} - {WALK.gap}) // {WALK.n_folds}) AS size FROM cal),
wk AS (SELECT *, dates - ({WALK.n_folds - 1} - fold_idx) * size AS test_end FROM wd, range({WALK.n_folds}) r(fold_idx)),
wp AS (SELECT timestamp, fold_idx, CASE WHEN pos < test_end - size - {WALK.gap} THEN 'train' WHEN pos >= test_end - size AND pos < test_end THEN 'test' END AS part FROM wk
  WHERE test_end - size >= {WALK.min_train + WALK.gap}),
wr AS (SELECT * FROM sig JOIN wp USING (timestamp) WHERE part IS NOT NULL),
wtrain AS (SELECT symbol AS run_id, fold_idx, count(*) AS train_bars FROM wr WHERE part = 'train' GROUP BY ALL),
w1 AS (SELECT * EXCLUDE (part), coalesce(last_value(CASE WHEN p >= {ENTER} THEN 1 WHEN p <= {LEAVE} THEN 0 END IGNORE NULLS) OVER
  (w ROWS UNBOUNDED PRECEDING), 0) AS position FROM wr WHERE part = 'test' WINDOW w AS (PARTITION BY symbol, fold_idx ORDER BY timestamp)),
w2 AS (SELECT *, coalesce(lag(position) OVER w, 0) AS held, lag(close) OVER w AS prev_close, row_number() OVER w AS n,
  count(*) OVER (PARTITION BY symbol, fold_idx) AS m FROM w1 WINDOW w AS (PARTITION BY symbol, fold_idx ORDER BY timestamp)),
w3 AS (SELECT *, coalesce(lag(held) OVER w, 0) AS hb FROM w2 WINDOW w AS (PARTITION BY symbol, fold_idx ORDER BY timestamp)),
w4 AS (SELECT *, CASE WHEN held > hb THEN 'BUY' WHEN held < hb THEN 'SELL' END AS action, n = m AND held = 1 AS closing,
  CASE WHEN held > hb THEN least(open * 1.0005, high) WHEN held < hb THEN greatest(open * 0.9995, low) END AS fill FROM w3),
wheld AS (SELECT *, sum(CASE WHEN action = 'BUY' THEN 1 ELSE 0 END) OVER (PARTITION BY symbol, fold_idx ORDER BY timestamp ROWS UNBOUNDED PRECEDING) AS trip FROM w4),
wt AS (SELECT symbol AS run_id, fold_idx, trip, max(fill) FILTER (action = 'BUY') AS a, coalesce(max(fill) FILTER (action = 'SELL'),
  any_value(lc)) AS z FROM wheld JOIN (SELECT symbol, fold_idx, greatest(close * 0.9995, low) AS lc FROM wheld WHERE n = m) USING (symbol, fold_idx)
  WHERE trip > 0 AND action IS NOT NULL GROUP BY 1, 2, 3),
wpnl AS (SELECT run_id, fold_idx, z - a - ((a + z) * 0.0005 + 2) AS pnl FROM wt),
we AS (SELECT *, ((CASE WHEN action = 'BUY' THEN close / fill WHEN action = 'SELL' THEN fill / prev_close WHEN held = 1 THEN close / prev_close ELSE 1 END)
  * (CASE WHEN action IS NULL THEN 1 ELSE 0.9995 END) * (CASE WHEN closing THEN greatest(close * 0.9995, low) / close * 0.9995 ELSE 1 END) - 1) * {SHARE} AS daily_return FROM wheld),
wl AS (SELECT *, sum(ln(1 + daily_return)) OVER (PARTITION BY symbol, fold_idx ORDER BY timestamp ROWS UNBOUNDED PRECEDING) AS own,
  sum(ln(1 + daily_return)) OVER (PARTITION BY symbol ORDER BY fold_idx, timestamp ROWS UNBOUNDED PRECEDING) AS carried FROM we),
wc AS (SELECT symbol AS run_id, fold_idx, timestamp, daily_return, {CASH} * exp(carried - own) AS start_equity, {CASH} * exp(carried) AS portfolio_equity FROM wl),
wcurve AS (SELECT *, portfolio_equity / greatest(start_equity, max(portfolio_equity) OVER (PARTITION BY run_id, fold_idx ORDER BY timestamp ROWS UNBOUNDED PRECEDING)) - 1 AS drawdown FROM wc)"""


def walked(t):
    return WF.walk_forward(sig(t), WALK, ENTER, LEAVE, CASH, COSTS, SHARE, 1.0)


query("oos_stitch", _C + """, {walk} SELECT run_id, CAST(fold_idx AS INT) AS fold_idx, count(*) AS bars, round(max(start_equity) + 1.3e-9, 4) AS start_equity,
  round(max_by(portfolio_equity, timestamp) + 1.3e-9, 4) AS final_equity FROM wcurve GROUP BY 1, 2""")(
    lambda t: rounded(WF.fold_equity(walked(t)[0]), 4))
query("wf_curve", _C + """, {walk} SELECT run_id, CAST(fold_idx AS INT) AS fold_idx, timestamp, round(portfolio_equity + 1.3e-9, 4) AS portfolio_equity,
  round(drawdown + 1.3e-9, 6) AS drawdown FROM wcurve""")(
    lambda t: rounded(walked(t)[0].select("run_id", "fold_idx", "timestamp", "portfolio_equity", "drawdown"), 6, {"portfolio_equity": 4}))
query("wf_summary", _C + f""", {{walk}}, wf AS (SELECT *, CAST(fold_idx AS VARCHAR) AS fold, start_equity AS base FROM wcurve UNION ALL
    SELECT *, 'OVERALL', {CASH}::DOUBLE FROM wcurve),
  a AS (SELECT run_id, fold, count(*) AS test_bars, min(timestamp) AS test_start, max(timestamp) AS test_end, max_by(portfolio_equity, timestamp) / max(base) AS growth,
    stddev_samp(daily_return) * sqrt(252) AS vol, -min(drawdown) AS max_drawdown FROM wf GROUP BY 1, 2),
  b AS (SELECT run_id, fold, count(*) AS trade_count, count(*) FILTER (pnl > 0) AS wins, coalesce(sum(pnl) FILTER (pnl > 0), 0) AS gain,
    coalesce(-sum(pnl) FILTER (pnl < 0), 0) AS loss FROM (SELECT run_id, CAST(fold_idx AS VARCHAR) AS fold, pnl FROM wpnl UNION ALL SELECT run_id, 'OVERALL', pnl FROM wpnl) GROUP BY 1, 2),
  c AS (SELECT run_id, fold, sum(train_bars) AS train_bars FROM (SELECT run_id, CAST(fold_idx AS VARCHAR) AS fold, train_bars FROM wtrain
    UNION ALL SELECT run_id, 'OVERALL', train_bars FROM wtrain) GROUP BY 1, 2),
  d AS (SELECT *, growth ** (252.0 / test_bars) - 1 AS ann FROM a)
  SELECT run_id, fold, CAST(coalesce(train_bars, 0) AS BIGINT) AS train_bars, {WALK.gap} AS purge_gap, test_bars, test_start, test_end, round(growth - 1 + 1.3e-9, 4) AS total_return,
  round(ann + 1.3e-9, 4) AS annualized_return, round(CASE WHEN vol > 1e-8 THEN (ann - 0.02) / vol ELSE 0 END + 1.3e-9, 4) AS sharpe_ratio,
  round(max_drawdown + 1.3e-9, 4) AS max_drawdown, round(coalesce(wins / trade_count, 0) + 1.3e-9, 4) AS win_rate,
  round(CASE WHEN trade_count IS NULL THEN 0 WHEN loss > 1e-8 THEN gain / loss WHEN gain > 1e-8 THEN NULL ELSE 0 END + 1.3e-9, 4) AS profit_factor,
  coalesce(trade_count, 0) AS trade_count FROM d LEFT JOIN b USING (run_id, fold) LEFT JOIN c USING (run_id, fold)""")(
    lambda t: rounded(WF.wf_summary(*walked(t), CASH, WALK.gap), 4))

# ---------------------------------------------------------------- risk

SQL_PARTS["ords"] = """ords AS (SELECT o_orderkey AS order_id, o_orderdate AS timestamp, n_name AS symbol,
  CASE WHEN o_orderkey % 3 = 0 THEN 'SELL' ELSE 'BUY' END AS action, CAST(o_orderkey % 40 AS DOUBLE) AS quantity,
  o_totalprice / 100 AS price, CAST(o_custkey % 12 AS DOUBLE) AS held_quantity, c_acctbal * 10 AS gross_value,
  30000.0 + c_acctbal * 8 AS equity, c_acctbal * 4 AS cash, (o_orderkey % 23) / 100.0 AS drawdown
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey)"""


def orders(t):
    """Orders with the portfolio state of their customer."""
    home = t.customer.join(F.broadcast(t.nation), F.col("c_nationkey") == F.col("n_nationkey"))
    return t.orders.join(home, F.col("o_custkey") == F.col("c_custkey")).select(
        F.col("o_orderkey").alias("order_id"), F.col("o_orderdate").alias("timestamp"), F.col("n_name").alias("symbol"),
        F.when(F.col("o_orderkey") % 3 == 0, "SELL").otherwise("BUY").alias("action"),
        (F.col("o_orderkey") % 40).cast("double").alias("quantity"), (F.col("o_totalprice") / 100).alias("price"),
        (F.col("o_custkey") % 12).cast("double").alias("held_quantity"), (F.col("c_acctbal") * 10).alias("gross_value"),
        (F.col("c_acctbal") * 8 + 30000.0).alias("equity"), (F.col("c_acctbal") * 4).alias("cash"),
        ((F.col("o_orderkey") % 23) / 100.0).alias("drawdown"))


LIMITS = K.RiskLimits(max_position_exposure=20_000.0, max_position_concentration=0.25, max_portfolio_exposure=1.0,
                      max_drawdown=0.20, cash_buffer=0.05)


def _cap(prev, nxt, name, cap, cur):
    return (f"{nxt} AS (SELECT * EXCLUDE (bind, room) REPLACE (CASE WHEN bind AND room <= 1e-7 THEN '{name}' ELSE stop END AS stop, "
            f"CASE WHEN bind AND room > 1e-7 THEN '{name}' ELSE hit END AS hit, "
            f"CASE WHEN bind AND room > 1e-7 THEN least(q, room) ELSE q END AS q) FROM "
            f"(SELECT *, stop IS NULL AND action = 'BUY' AND {cur} + q * price > {cap} AS bind, "
            f"greatest(0, {cap} - {cur}) / price AS room FROM {prev}))")


SQL_PARTS["risk"] = "{ords}, k0 AS (SELECT *, held_quantity * price AS pv, CASE WHEN quantity <= 0 OR price <= 0 THEN 'order_sanity' " \
    "WHEN action = 'SELL' AND held_quantity <= 0 THEN 'short_selling_disabled' WHEN action = 'BUY' AND drawdown >= 0.20 THEN 'max_drawdown_limit' END AS stop, " \
    "CASE WHEN action = 'SELL' AND held_quantity > 0 THEN least(quantity, held_quantity) ELSE quantity END AS q, " \
    "CASE WHEN action = 'SELL' AND held_quantity > 0 AND quantity > held_quantity THEN 'held_position_limit' END AS hit FROM ords), " + ", ".join([
        _cap("k0", "k1", "max_position_exposure", "20000.0", "pv"), _cap("k1", "k2", "max_position_concentration", "equity * 0.25", "pv"),
        _cap("k2", "k3", "max_portfolio_exposure", "equity * 1.0", "gross_value"), _cap("k3", "k4", "cash_buffer", "cash * 0.95", "0")]) + """,
decided AS (SELECT *, CASE WHEN stop IS NOT NULL THEN 'REJECTED' WHEN q < quantity - 1e-7 THEN 'REDUCED' ELSE 'ACCEPTED' END AS status,
  CASE WHEN stop IS NOT NULL THEN 0 ELSE q END AS approved, coalesce(stop, CASE WHEN q < quantity - 1e-7 THEN hit END) AS constraint_triggered FROM k4)"""
_RK = "WITH {risk} "
query("risk_decisions", _RK + """SELECT order_id AS decision_id, timestamp, symbol, action, status, quantity AS requested_quantity,
  round(approved + 1.3e-9, 6) AS approved_quantity, round(quantity * price + 1.3e-9, 4) AS requested_value, round(approved * price + 1.3e-9, 4) AS approved_value,
  constraint_triggered, round(gross_value / equity + 1.3e-9, 6) AS portfolio_exposure_pct, round(pv / equity + 1.3e-9, 6) AS position_concentration_pct FROM decided""")(
    lambda t: rounded(K.evaluate_orders(orders(t), LIMITS), 6, {"requested_value": 4, "approved_value": 4}).select(
        "decision_id", "timestamp", "symbol", "action", "status", "requested_quantity", "approved_quantity", "requested_value",
        "approved_value", "constraint_triggered", "portfolio_exposure_pct", "position_concentration_pct"))
for _name, _constraint in {"risk_sanity": "order_sanity", "risk_sell": "held_position_limit", "risk_drawdown": "max_drawdown_limit",
                           "risk_position_cap": "max_position_exposure", "risk_concentration": "max_position_concentration",
                           "risk_gross": "max_portfolio_exposure", "risk_cash": "cash_buffer"}.items():
    query(_name, _RK + f"SELECT order_id AS decision_id, status, round(approved + 1.3e-9, 6) AS approved_quantity FROM decided "
          f"WHERE constraint_triggered = '{_constraint}'")(
        lambda t, c=_constraint: rounded(K.evaluate_orders(orders(t), LIMITS).filter(F.col("constraint_triggered") == c)
                                         .select("decision_id", "status", "approved_quantity")))
query("risk_outcome", _RK + "SELECT status, action, constraint_triggered, count(*) AS orders FROM decided GROUP BY ALL")(
    lambda t: K.evaluate_orders(orders(t), LIMITS).groupBy("status", "action", "constraint_triggered").agg(
        F.count(F.lit(1)).alias("orders")))
query("risk_snapshot", "WITH {ords} SELECT order_id, round(quantity * price + 1.3e-9, 4) AS requested_value, round(held_quantity * price + 1.3e-9, 4) AS position_value, "
      "round(gross_value / equity + 1.3e-9, 4) AS portfolio_exposure_pct, round(held_quantity * price / equity + 1.3e-9, 4) AS position_concentration_pct FROM ords")(
    lambda t: rounded(K.snapshot(orders(t)).select("order_id", "requested_value", "position_value", "portfolio_exposure_pct",
                                                   "position_concentration_pct"), 4))
query("decision_counts", _RK + "SELECT symbol, count(*) FILTER (status = 'ACCEPTED') AS accepted, count(*) FILTER (status = 'REDUCED') AS reduced, "
      "count(*) FILTER (status = 'REJECTED') AS rejected FROM decided GROUP BY 1")(
    lambda t: K.decision_counts(K.evaluate_orders(orders(t), LIMITS), "symbol"))

_SIZE = {
    "size_fixed_cash": ("fixed_cash", "least(10000, cash * 0.98)"),
    "size_atr": ("atr_risk", "CASE WHEN atr > 0 THEN least(equity * 0.01 / (atr * 2) * price, cash * 0.98) ELSE equity * 0.1 END"),
    "size_vol_target": ("volatility_target", "CASE WHEN vol > 0 THEN least(equity * least(0.15 / vol, 0.25), cash * 0.98) ELSE equity * 0.1 END"),
    "size_fractional": ("fractional_equity", "least(equity * 0.1, cash * 0.98)"),
}


def _sized(t, method):
    rows = orders(t).withColumns({"atr": F.when(F.col("order_id") % 5 > 0, F.col("price") * 0.03),
                                  "vol": F.when(F.col("order_id") % 7 > 0, (F.col("order_id") % 7) * 0.1)})
    return rounded(rows.select("order_id", K.Sizing().quantity(
        method, F.col("price"), F.col("equity"), F.col("cash"), F.col("atr"), F.col("vol")).alias("size")))


for _name, (_method, _value) in _SIZE.items():
    query(_name, "WITH {ords}, s AS (SELECT *, CASE WHEN order_id % 5 > 0 THEN price * 0.03 END AS atr, "
          "CASE WHEN order_id % 7 > 0 THEN (order_id % 7) * 0.1::DOUBLE END AS vol FROM ords) "
          f"SELECT order_id, round(CASE WHEN price > 0 AND equity > 0 THEN greatest(0, ({_value}) / price) ELSE 0 END + 1.3e-9, 6) AS size FROM s")(
        lambda t, m=_method: _sized(t, m))
query("size_signal", "WITH {ords} SELECT order_id, round(CASE WHEN least(equity * 0.95, cash * 0.99) > 0 THEN least(equity * 0.95, cash * 0.99) / price ELSE 0 END "
      "+ 1.3e-9, 6) AS size FROM ords")(
    lambda t: rounded(orders(t).select("order_id", K.signal_quantity(F.col("price"), F.col("cash"), F.col("equity")).alias("size"))))

# ---------------------------------------------------------------- ledger

def _block(column="seq"):
    """Ten-year ranges of daily bars: at most 3 653 fills of a position per range."""
    return time_block(column, 86400 * 3650)



def fills(t):
    """Executed orders of one account per symbol: entries, additions, partial and full exits."""
    bars = held(t)
    acted = bars.filter("held = 1 OR action = 'SELL'").withColumns({
        "_add": F.when(F.col("action") == "BUY", 100.0).when((F.col("held") == 1) & (F.col("n") % 5 == 0), 10.0),
        "_cut": F.when((F.col("held") == 1) & F.col("action").isNull() & (F.col("n") % 5 != 0) & (F.col("n") % 7 == 0), 5.0)})
    sums = acted.groupBy("symbol", "trip").agg(
        (F.sum(F.coalesce("_add", F.lit(0.0))) - F.sum(F.coalesce("_cut", F.lit(0.0)))).alias("_left"))
    done = acted.join(sums, ["symbol", "trip"]).withColumn(
        "quantity", F.when(F.col("action") == "SELL", F.col("_left")).otherwise(F.coalesce("_add", "_cut")))
    return done.filter("quantity > 0").select(
        F.concat(F.lit("acct_"), F.col("symbol")).alias("account"),
        "symbol", F.col("timestamp").alias("seq"),
        F.when(F.col("_add").isNotNull(), "BUY").otherwise("SELL").alias("action"), "quantity",
        F.coalesce("fill", "close").alias("price"),
    ).withColumn("fee", F.col("quantity") * F.col("price") * 0.001 + 1.0)


SQL_PARTS["fills"] = """{chain_n}, f0 AS (SELECT *, CASE WHEN action = 'BUY' THEN 100.0::DOUBLE WHEN held = 1 AND n % 5 = 0 THEN 10.0::DOUBLE END AS a,
  CASE WHEN held = 1 AND action IS NULL AND n % 5 <> 0 AND n % 7 = 0 THEN 5.0::DOUBLE END AS c FROM held WHERE held = 1 OR action = 'SELL'),
f1 AS (SELECT *, CASE WHEN action = 'SELL' THEN sum(coalesce(a, 0) - coalesce(c, 0)) OVER (PARTITION BY symbol, trip) ELSE coalesce(a, c) END AS quantity FROM f0),
fills AS (SELECT 'acct_' || symbol AS account, symbol, timestamp AS seq, CASE WHEN a IS NOT NULL THEN 'BUY' ELSE 'SELL' END AS act, quantity,
  coalesce(fill, close) AS price, quantity * coalesce(fill, close) * 0.001 + 1 AS fee FROM f1 WHERE quantity > 0),
folded AS (SELECT account, symbol, count(*) AS fills, sum(fee) AS fees, list_reduce(list_prepend(
    {'buy': true, 'q': 0.0::DOUBLE, 'px': 0.0::DOUBLE, 'fee': 0.0::DOUBLE, 'held': 0.0::DOUBLE, 'avg': 0.0::DOUBLE, 'pnl': 0.0::DOUBLE},
    list({'buy': act = 'BUY', 'q': quantity, 'px': price, 'fee': fee, 'held': 0.0::DOUBLE, 'avg': 0.0::DOUBLE, 'pnl': 0.0::DOUBLE} ORDER BY seq)),
  lambda s, x: {'buy': x.buy, 'q': x.q, 'px': x.px, 'fee': x.fee,
    'held': CASE WHEN x.buy THEN s.held + x.q WHEN abs(s.held - x.q) <= 1e-7 THEN 0 ELSE s.held - x.q END,
    'avg': CASE WHEN x.buy THEN (s.held * s.avg + x.q * x.px) / (s.held + x.q) ELSE s.avg END,
    'pnl': s.pnl + CASE WHEN x.buy THEN 0 ELSE x.q * (x.px - s.avg) - x.fee END}) AS z FROM fills GROUP BY 1, 2)"""


def book(t):
    return L.positions(L.position_path(fills(t), _block()))


query("positions_from_fills", "WITH {fills} SELECT account, symbol, fills, round(z.held + 1.3e-9, 4) AS quantity, "
      "round(CASE WHEN z.held > 0 THEN z.avg ELSE 0 END + 1.3e-9, 4) AS average_cost, round(z.pnl + 1.3e-6, 2) AS realized_pnl, "
      "round(fees + 1.3e-6, 2) AS total_fees FROM folded")(
    lambda t: rounded(book(t), 4, {"realized_pnl": 2, "total_fees": 2}))
query("latest_price", "WITH {bars_s} SELECT symbol, round(max_by(close, timestamp) + 1.3e-9, 6) AS current_price FROM bars_s GROUP BY 1")(
    lambda t: rounded(L.latest_prices(t.bars_s)))
SQL_PARTS["marked"] = """px AS (SELECT symbol, max_by(close, timestamp) AS cp FROM bars_n GROUP BY 1),
marked AS (SELECT account, symbol, z.held AS quantity, CASE WHEN z.held > 0 THEN z.avg ELSE 0 END AS average_cost, cp, z.pnl AS realized_pnl,
  CASE WHEN substr(symbol, 8)::INT % 2 = 0 THEN 'INR' ELSE 'USD' END AS currency FROM folded JOIN px USING (symbol))"""


def marked(t):
    number = F.regexp_extract("symbol", r"(\d+)$", 1).cast("int")
    return L.mark_positions(book(t), L.latest_prices(t.bars_n)).withColumn(
        "currency", F.when(number % 2 == 0, "INR").otherwise("USD"))


query("mark_positions", """WITH {fills}, {marked} SELECT symbol, round(quantity * cp + 1.3e-6, 2) AS market_value,
  round(quantity * (cp - average_cost) + 1.3e-6, 2) AS unrealized_pnl,
  round(CASE WHEN quantity * average_cost > 0 THEN (cp - average_cost) / average_cost * 100 ELSE 0 END + 1.3e-9, 4) AS unrealized_pct FROM marked""")(
    lambda t: rounded(marked(t).select("symbol", "market_value", "unrealized_pnl", "unrealized_pct"), 4,
                      {"market_value": 2, "unrealized_pnl": 2}))
query("cash_ledger", """WITH {fills} SELECT account, symbol, seq, round(1000000 + sum(CASE WHEN act = 'BUY' THEN -quantity * price ELSE quantity * price END - fee)
  OVER w + 1.3e-6, 2) AS cash, round(sum(fee) OVER w + 1.3e-6, 2) AS total_fees FROM fills WINDOW w AS (PARTITION BY account ORDER BY seq ROWS UNBOUNDED PRECEDING)""")(
    lambda t: rounded(L.cash_ledger(fills(t), 1e6, _block()).select("account", "symbol", "seq", "cash", "total_fees"), 2))
query("wallet_equity_history", _C + f"""SELECT run_id AS account, timestamp, round(high_water_mark + 1.3e-9, 4) AS peak_equity,
  round(-drawdown * 100 + 1.3e-9, 4) AS drawdown_pct FROM curved""")(
    lambda t: rounded(L.equity_history(curve(t).select(
        F.col("run_id").alias("account"), "timestamp", F.col("portfolio_equity").alias("equity")), CASH,
        _block("timestamp")).select("account", "timestamp", "peak_equity", "drawdown_pct"), 4))
SQL_PARTS["wallets"] = """cashes AS (SELECT CASE WHEN substr(symbol, 8)::INT % 2 = 0 THEN 'INR' ELSE 'USD' END AS currency,
  1000000 + sum(CASE WHEN act = 'BUY' THEN -quantity * price ELSE quantity * price END - fee) AS cash FROM fills GROUP BY symbol),
wallet AS (SELECT currency, wallets, cash, market_value, total_cost, realized_pnl, open_positions, cash + coalesce(market_value, 0) AS total_equity,
  (cash + coalesce(market_value, 0) - wallets * 1000000.0) / (wallets * 1000000.0) * 100 AS return_pct
  FROM (SELECT currency, sum(cash) AS cash, count(*) AS wallets FROM cashes GROUP BY 1) LEFT JOIN
  (SELECT currency, sum(quantity * cp) AS market_value, sum(quantity * average_cost) AS total_cost, sum(realized_pnl) AS realized_pnl,
   count(*) FILTER (quantity > 0) AS open_positions FROM marked GROUP BY 1) USING (currency))"""


def wallets(t):
    number = F.regexp_extract("account", r"(\d+)$", 1).cast("int")
    value = F.col("quantity") * F.col("price")
    cash = fills(t).groupBy("account").agg(
        (F.sum(F.when(F.col("action") == "BUY", -value).otherwise(value) - F.col("fee")) + 1e6).alias("cash")
    ).withColumn("currency", F.when(number % 2 == 0, "INR").otherwise("USD"))
    return L.wallet_totals(marked(t), cash, 1e6)


query("wallet_totals", "WITH {fills}, {marked}, {wallets} SELECT currency, wallets, open_positions, " + ", ".join(
    f"round({c} + 1.3e-6, 2) AS {c}" for c in ("cash", "market_value", "total_cost", "realized_pnl", "total_equity", "return_pct")) + " FROM wallet")(
    lambda t: rounded(wallets(t), 2))
query("wallet_summary", """WITH {fills}, {marked}, {wallets} SELECT 'CALCULATED' AS status,
  round(sum(CASE WHEN currency = 'USD' THEN total_equity ELSE total_equity / 83.5 END) + 1.3e-6, 2) AS combined_usd,
  round(sum(CASE WHEN currency = 'INR' THEN total_equity ELSE total_equity * 83.5 END) + 1.3e-6, 2) AS combined_inr FROM wallet""")(
    lambda t: rounded(L.consolidate(wallets(t), 83.5), 2))
query("wallet_summary_no_rate", """SELECT 'UNAVAILABLE' AS status, CAST(NULL AS DOUBLE) AS combined_usd, CAST(NULL AS DOUBLE) AS combined_inr""")(
    lambda t: L.consolidate(wallets(t), None))

_SYMS = ["AAPL", "TCS.NS", "abc.bo", "^NSEI", "^BSESN", "NIFTY50", "^GSPC", " sensex "]


def _sym(key):
    return F.element_at(F.array(*[F.lit(s) for s in _SYMS]), (F.col(key) % len(_SYMS) + 1).cast("int"))


SQL_PARTS["cur"] = "cur AS (SELECT *, CASE o_orderkey % 8 " + " ".join(f"WHEN {i} THEN '{s}'" for i, s in enumerate(_SYMS)) + \
    " END AS sym, CASE WHEN o_orderkey % 8 IN (1, 2, 3, 4, 5, 7) THEN 'INR' ELSE 'USD' END AS currency, CASE WHEN o_orderkey % 3 = 0 THEN 'SELL' ELSE 'BUY' END AS action, " \
    "CAST(1 + o_orderkey % 20 AS DOUBLE) AS quantity FROM orders)"


def _desk(t):
    return t.orders.select("o_orderkey", _sym("o_orderkey").alias("symbol"), (F.col("o_totalprice") / 1000).alias("price"),
                           F.when(F.col("o_orderkey") % 3 == 0, "SELL").otherwise("BUY").alias("action"),
                           (F.col("o_orderkey") % 20 + 1).cast("double").alias("quantity"),
                           (F.col("o_custkey") * 1.0).alias("cash"), (F.col("o_custkey") % 15).cast("double").alias("held_quantity"))


query("symbol_currency", "WITH {cur} SELECT o_orderkey, currency FROM cur")(
    lambda t: t.orders.select("o_orderkey", L.symbol_currency(_sym("o_orderkey")).alias("currency")))
query("order_fees", "WITH {cur} SELECT o_orderkey, round(quantity * o_totalprice / 1000 * 0.001 + CASE currency WHEN 'INR' THEN 20 ELSE 1 END + 1.3e-9, 6) AS fees FROM cur")(
    lambda t: rounded(_desk(t).select("o_orderkey", L.order_fees(
        F.col("quantity") * F.col("price"), L.symbol_currency(F.col("symbol")), digits=None).alias("fees"))))
query("slippage_price", "WITH {cur} SELECT o_orderkey, round(o_totalprice / 1000 * CASE action WHEN 'BUY' THEN 1.0005 ELSE 0.9995 END + 1.3e-9, 6) AS fill_price FROM cur")(
    lambda t: rounded(_desk(t).select("o_orderkey", L.slippage_price(F.col("price"), F.col("action"), digits=None).alias("fill_price"))))
query("order_estimate", """WITH {cur}, e AS (SELECT *, round(o_totalprice / 1000 * CASE action WHEN 'BUY' THEN 1.0005 ELSE 0.9995 END + 1e-10, 4) AS fp FROM cur)
  SELECT o_orderkey, currency, round(quantity * abs(fp - o_totalprice / 1000) + 1.3e-6, 2) AS slippage,
  CASE WHEN action = 'BUY' THEN CASE WHEN o_custkey >= quantity * fp + quantity * fp * 0.001 + CASE currency WHEN 'INR' THEN 20 ELSE 1 END THEN 1 ELSE 0 END
       ELSE CASE WHEN o_custkey % 15 >= quantity THEN 1 ELSE 0 END END AS sufficient FROM e""")(
    lambda t: rounded(L.estimate_orders(_desk(t)).select("o_orderkey", "currency", "slippage", "sufficient"), 2))
query("order_status_mix", """SELECT CASE o_orderstatus WHEN 'F' THEN 'FILLED' WHEN 'O' THEN 'PENDING' ELSE 'CANCELLED' END AS status,
  CASE WHEN o_orderkey % 4 = 0 THEN 'LIMIT' ELSE 'MARKET' END AS order_type, CASE WHEN o_orderkey % 3 = 0 THEN 'SELL' ELSE 'BUY' END AS action,
  count(*) AS orders FROM orders GROUP BY ALL""")(
    lambda t: L.order_status_mix(t.orders.select(
        F.when(F.col("o_orderstatus") == "F", "FILLED").when(F.col("o_orderstatus") == "O", "PENDING").otherwise("CANCELLED").alias("status"),
        F.when(F.col("o_orderkey") % 4 == 0, "LIMIT").otherwise("MARKET").alias("order_type"),
        F.when(F.col("o_orderkey") % 3 == 0, "SELL").otherwise("BUY").alias("action"))))
