"""Queries over instruments, as-of joins, the screener, research tables and models."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from barloom.functions.features import compute_features
from barloom.operators import joins as J
from barloom.operators import metrics as M
from barloom.operators import ml
from barloom.operators import research as R
from barloom.operators import screener as X
from barloom.operators import splits as S
from barloom.operators.model_store import ModelStore, fold_periods
from barloom.operators.walkforward import calendar_fold_rows
from barloom.plans import modeling, trading
from barloom.plans.core import SQL_PARTS, query, rounded
from barloom.session import checkpoint_dir

# ---------------------------------------------------------------- instruments

SQL_PARTS["universe"] = """universe AS (SELECT s_suppkey AS position, CASE WHEN s_suppkey % 10 = 0 THEN '^S' ELSE 'S' END || CAST(s_suppkey AS VARCHAR) AS symbol,
  s_name AS name, n_name AS exchange, CASE WHEN s_nationkey % 2 = 0 THEN 'INR' ELSE 'USD' END AS currency,
  CASE WHEN s_suppkey % 10 = 0 THEN 'INDEX' ELSE 'EQUITY' END AS asset_type, CASE WHEN s_nationkey % 2 = 0 THEN 'IN' ELSE 'US' END AS country,
  r_name AS sector FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"""


def universe(t):
    """Suppliers as listed instruments."""
    nation = t.nation.join(F.broadcast(t.region), F.col("n_regionkey") == F.col("r_regionkey"))
    index, rupee = F.col("s_suppkey") % 10 == 0, F.col("s_nationkey") % 2 == 0
    return t.supplier.join(
        F.broadcast(nation), F.col("s_nationkey") == F.col("n_nationkey")).select(
        F.col("s_suppkey").alias("position"),
        F.concat(F.when(index, "^S").otherwise("S"), F.col("s_suppkey").cast("string")).alias("symbol"),
        F.col("s_name").alias("name"), F.col("n_name").alias("exchange"),
        F.when(rupee, "INR").otherwise("USD").alias("currency"),
        F.when(index, "INDEX").otherwise("EQUITY").alias("asset_type"),
        F.when(rupee, "IN").otherwise("US").alias("country"), F.col("r_name").alias("sector"))


_SUFFIX = {"A": "", "R": ".NS", "N": ".bo"}  # unlisted forms for two of the three return flags


@query("enrich_instruments", """WITH {universe}, s AS (SELECT 'S' || CAST(l_suppkey AS VARCHAR) || CASE l_returnflag WHEN 'R' THEN '.NS' WHEN 'N' THEN '.bo' ELSE '' END AS symbol,
  count(*) AS rows FROM lineitem GROUP BY 1), u AS (SELECT *, upper(symbol) AS k FROM s)
  SELECT u.symbol, rows, coalesce(a.symbol, b.symbol, k) AS instrument, coalesce(a.name, b.name, k) AS name,
  coalesce(a.exchange, b.exchange, CASE right(k, 3) WHEN '.NS' THEN 'NSE' WHEN '.BO' THEN 'BSE' ELSE 'US' END) AS exchange,
  coalesce(a.currency, b.currency, CASE WHEN right(k, 3) IN ('.NS', '.BO') THEN 'INR' ELSE 'USD' END) AS currency,
  coalesce(a.asset_type, b.asset_type, 'EQUITY') AS asset_type, coalesce(a.country, b.country, CASE WHEN right(k, 3) IN ('.NS', '.BO') THEN 'IN' ELSE 'US' END) AS country,
  coalesce(a.sector, b.sector, 'Unspecified') AS sector FROM u LEFT JOIN universe a ON a.symbol = k LEFT JOIN universe b ON b.symbol = '^' || k""")
def _enrich(t):
    suffix = F.coalesce(*[F.when(F.col("l_returnflag") == f, s) for f, s in _SUFFIX.items()], F.lit(""))
    symbols = t.lineitem.groupBy("l_suppkey", "l_returnflag").agg(F.count(F.lit(1)).alias("c")).groupBy(
        F.concat(F.lit("S"), F.col("l_suppkey").cast("string"), suffix).alias("symbol")).agg(F.sum("c").alias("rows"))
    return J.enrich_instruments(symbols, universe(t))


query("universe", "WITH {universe} SELECT symbol, name, exchange, currency, asset_type, country, sector FROM universe")(
    lambda t: universe(t).drop("position"))
query("search_universe", """WITH {universe} SELECT symbol, name, CASE WHEN symbol = 'S1' THEN 1 WHEN starts_with(symbol, 'S1') THEN 2 ELSE 3 END AS tier
  FROM universe WHERE starts_with(symbol, 'S1') OR contains(upper(name), 'S1') OR contains(upper(sector), 'S1') OR contains(upper(exchange), 'S1')
  ORDER BY tier, position LIMIT 20""")(
    lambda t: J.search_universe(universe(t), " s1 ").select("symbol", "name", "tier"))
query("search_universe_sector", """WITH {universe} SELECT symbol, sector, 3 AS tier FROM universe WHERE sector = 'ASIA' ORDER BY position LIMIT 20""")(
    lambda t: J.search_universe(universe(t), "asia").select("symbol", "sector", "tier"))

# ---------------------------------------------------------------- as-of and range joins

query("asof_quote", """WITH q AS (SELECT user_id, ts, max(value) AS value FROM events WHERE event_type = 'view' GROUP BY 1, 2),
  p AS (SELECT event_id, user_id, ts FROM events WHERE event_type = 'purchase')
  SELECT p.event_id, p.user_id, p.ts, q.ts AS asof_ts, q.value AS asof_value FROM p ASOF LEFT JOIN q ON p.user_id = q.user_id AND p.ts >= q.ts""")(
    lambda t: J.asof_join(
        t.events.filter("event_type = 'purchase'").select("event_id", "user_id", "ts"),
        t.events.filter("event_type = 'view'").select("user_id", "ts", "value"),
        "user_id", "ts", "ts", ["value"], 300))
query("forecast_join", """WITH {labelled_n}, f AS (SELECT symbol, timestamp, range_pos_20d AS p FROM labelled WHERE range_pos_20d IS NOT NULL),
  o AS (SELECT o_orderkey AS order_id, n_name AS symbol, o_orderdate AS created_at FROM orders JOIN customer ON o_custkey = c_custkey
        JOIN nation ON c_nationkey = n_nationkey)
  SELECT o.order_id, o.symbol, o.created_at, f.timestamp AS asof_timestamp, round(f.p + 1.3e-9, 6) AS asof_p
  FROM o ASOF LEFT JOIN f ON o.symbol = f.symbol AND o.created_at >= f.timestamp""")(lambda t: _forecast_join(t))


def _nation_orders(t):
    return trading.orders(t).select("order_id", "symbol", F.col("timestamp").alias("created_at"), "price")


def _forecast_join(t):
    forecasts = compute_features(t.bars_n, ["range_pos_20d"]).dropna().withColumnRenamed("range_pos_20d", "p")
    return rounded(J.asof_join(_nation_orders(t).drop("price"), forecasts, "symbol", "created_at", "timestamp", ["p"], 86400))


SQL_PARTS["touch"] = """{bars_n}, lo AS (SELECT o_orderkey AS order_id, n_name AS symbol, o_orderdate AS created_at,
  CASE WHEN o_orderkey % 2 = 0 THEN 'BUY' ELSE 'SELL' END AS action,
  CASE WHEN o_orderkey % 2 = 0 THEN o_totalprice * 0.1 + 500 ELSE o_totalprice * 0.1 + 448000 END AS limit_price,
  CAST(1 + o_orderkey % 5 AS DOUBLE) AS quantity FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey),
touched AS (SELECT lo.*, (SELECT min(b.timestamp) FROM bars_n b WHERE b.symbol = lo.symbol AND b.timestamp >= lo.created_at
  AND (CASE WHEN lo.action = 'BUY' THEN b.low <= lo.limit_price ELSE b.high >= lo.limit_price END)) AS filled_at FROM lo)"""


def limit_orders(t):
    buy = F.col("order_id") % 2 == 0
    return _nation_orders(t).select(
        "order_id", "symbol", "created_at", F.when(buy, "BUY").otherwise("SELL").alias("action"),
        F.when(buy, F.col("price") * 10 + 500).otherwise(F.col("price") * 10 + 448000).alias("limit_price"),
        (F.col("order_id") % 5 + 1).cast("double").alias("quantity"))


query("limit_first_touch", "WITH {touch} SELECT order_id, symbol, created_at, action, filled_at FROM touched")(
    lambda t: J.limit_first_touch(limit_orders(t), t.bars_n).select("order_id", "symbol", "created_at", "action", "filled_at"))
query("limit_fills", """WITH {touch} SELECT CASE WHEN filled_at IS NULL THEN 'PENDING' ELSE 'FILLED' END AS status, action, count(*) AS orders
  FROM touched GROUP BY 1, 2""")(
    lambda t: J.limit_fills(J.limit_first_touch(limit_orders(t), t.bars_n)).groupBy("status", "action").agg(
        F.count(F.lit(1)).alias("orders")))

# ---------------------------------------------------------------- screener

SQL_PARTS["screen"] = """sb AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY timestamp DESC) - 1 AS age,
  count(*) OVER (PARTITION BY symbol) AS nb, lag(close) OVER (PARTITION BY symbol ORDER BY timestamp) AS pc FROM bars_s),
ema AS (SELECT symbol, list_reduce(list(close ORDER BY timestamp), lambda a, x: a + 0.2::DOUBLE * (x - a)) AS ema_9,
  list_reduce(list(close ORDER BY timestamp), lambda a, x: a + (2.0::DOUBLE / 22) * (x - a)) AS ema_21 FROM bars_s GROUP BY 1),
si AS (SELECT symbol, max(nb) AS bars, max(timestamp) AS timestamp, max(close) FILTER (age = 0) AS price,
  100 - 100 / (1 + coalesce(avg(greatest(close - pc, 0)) FILTER (age < 14 AND pc IS NOT NULL), 0)
    / (coalesce(avg(greatest(pc - close, 0)) FILTER (age < 14 AND pc IS NOT NULL), 0) + 1e-9)) AS rsi_14,
  avg(greatest(high - low, abs(high - pc), abs(low - pc))) FILTER (age < 14 AND pc IS NOT NULL) AS atr,
  min(low) FILTER (age < 20) AS support, max(high) FILTER (age < 20) AS resistance,
  max(volume) FILTER (age = 0) / (avg(volume) FILTER (age < 20) + 1e-9) AS volume_ratio,
  CASE WHEN count(pc) FILTER (age < 20) > 1 THEN stddev_samp(close / pc - 1) FILTER (age < 20) ELSE 0.01 END * sqrt(252) AS annual_volatility,
  abs(CASE WHEN count(pc) FILTER (age < 20) >= 10 THEN quantile_cont(close / pc - 1, 0.05) FILTER (age < 20) ELSE -0.02 END) * sqrt(5) AS var_horizon
  FROM sb GROUP BY 1),
ind AS (SELECT *, greatest(coalesce(atr, price * 0.015), price * 0.005) AS atr_14, CASE WHEN annual_volatility < 0.15 THEN 'LOW'
  WHEN annual_volatility < 0.28 THEN 'NORMAL' WHEN annual_volatility < 0.45 THEN 'HIGH' ELSE 'EXTREME' END AS vol_regime,
  CASE WHEN bars < 30 THEN 'INSUFFICIENT_EVIDENCE' ELSE 'VALIDATED' END AS status FROM si JOIN ema USING (symbol)),
s1 AS (SELECT *, CASE WHEN price >= ema_21 AND ema_9 >= ema_21 THEN 18 WHEN price < ema_21 AND ema_9 < ema_21 THEN -18 ELSE 4 END AS t1,
  CASE WHEN rsi_14 BETWEEN 45 AND 65 THEN 16 WHEN rsi_14 < 35 THEN 14 WHEN rsi_14 > 72 THEN -15 ELSE 6 END AS t2,
  CASE WHEN volume_ratio >= 1.15 THEN 14 WHEN volume_ratio >= 0.85 THEN 10 ELSE 2 END AS t3,
  CASE WHEN (price - support) / greatest(resistance - support, atr_14) <= 0.65 THEN 12 ELSE -4 END AS t4 FROM ind),
s2 AS (SELECT *, least(88, greatest(18, 50 + t1 + t2 + t3 + t4)) / 100.0::DOUBLE AS probability_up FROM s1),
s3 AS (SELECT *, probability_up >= 0.52 AS b FROM s2),
s4 AS (SELECT *, round((CASE WHEN b THEN price - 0.25 * atr_14 ELSE price - 0.1 * atr_14 END) + 1.3e-9, 2) AS entry_low,
  round((CASE WHEN b THEN price + 0.1 * atr_14 ELSE price + 0.25 * atr_14 END) + 1.3e-9, 2) AS entry_high,
  round((CASE WHEN b THEN greatest(price - 1.5 * atr_14, support - 0.1 * atr_14) ELSE least(price + 1.5 * atr_14, resistance + 0.1 * atr_14) END) + 1.3e-9, 2) AS stop_loss,
  CASE WHEN b AND rsi_14 < 38 THEN 'rebound' WHEN b AND price >= resistance * 0.985 THEN 'breakout' WHEN b THEN 'pullback'
    WHEN rsi_14 > 70 THEN 'reversal' ELSE 'defensive' END AS setup FROM s3),
s5 AS (SELECT *, greatest(CASE WHEN b THEN price - stop_loss ELSE stop_loss - price END, 0.01) AS risk FROM s4),
plan AS (SELECT *, round(CASE WHEN b THEN price + 2 * risk ELSE price - 2 * risk END + 1.3e-9, 2) AS target_1,
  round(CASE WHEN b THEN price + 3.5 * risk ELSE price - 3.5 * risk END + 1.3e-9, 2) AS target_2,
  CASE WHEN b AND price < stop_loss OR NOT b AND price > stop_loss THEN 'INVALIDATED' WHEN price BETWEEN entry_low AND entry_high THEN 'TRIGGERED'
    WHEN b AND price > entry_high OR NOT b AND price < entry_low THEN 'ARMED' ELSE 'SCANNING' END AS trigger_state FROM s5)"""
_S = "WITH {bars_s}, {screen} "


def _r(*names, digits=4):
    return ", ".join(f"round({c} + 1.3e-9, {digits}) AS {c}" for c in names)


query("latest_quote", """WITH {bars_s}, q AS (SELECT *, coalesce(lag(close) OVER w, close) AS prev_close, row_number() OVER (PARTITION BY symbol ORDER BY timestamp DESC) AS k
  FROM bars_s WINDOW w AS (PARTITION BY symbol ORDER BY timestamp)), z AS (SELECT *, close - prev_close AS change, (close - prev_close) / prev_close * 100 AS change_pct,
  close * 0.99975 AS bid, close * 1.00025 AS ask FROM q WHERE k = 1) SELECT symbol, timestamp, """
      + _r("open", "high", "low", "close", "volume", "prev_close", "change", "change_pct", "bid", "ask", digits=6) + " FROM z")(
    lambda t: rounded(X.latest_quote(t.bars_s)))
_IND = ["price", "ema_9", "ema_21", "rsi_14", "atr_14", "support", "resistance", "volume_ratio"]
query("screen_indicators", _S + "SELECT symbol, timestamp, " + _r(*_IND) + " FROM ind")(
    lambda t: rounded(X.indicators(t.bars_s).select("symbol", "timestamp", *_IND), 4))
query("vol_regime", _S + "SELECT symbol, vol_regime, " + _r("annual_volatility") + " FROM ind")(
    lambda t: rounded(X.indicators(t.bars_s).select("symbol", "vol_regime", "annual_volatility"), 4))
query("var_horizon", _S + "SELECT symbol, " + _r("var_horizon", digits=6) + " FROM ind")(
    lambda t: rounded(X.indicators(t.bars_s).select("symbol", "var_horizon")))
query("var_95", _S + "SELECT symbol, round(var_horizon / sqrt(5) + 1.3e-9, 6) AS var_95 FROM ind")(
    lambda t: rounded(X.indicators(t.bars_s, horizon=1).select("symbol", F.col("var_horizon").alias("var_95"))))
query("min_history", _S + "SELECT symbol, status FROM ind")(lambda t: X.indicators(t.bars_s).select("symbol", "status"))
query("confluence_score", _S + "SELECT symbol, t1 * 1.0::DOUBLE AS trend_score, t2 * 1.0::DOUBLE AS rsi_score, t3 * 1.0::DOUBLE AS volume_score, "
      "t4 * 1.0::DOUBLE AS structure_score, CASE WHEN b THEN 'BUY' ELSE 'SELL' END AS action, round(probability_up + 1.3e-9, 4) AS probability_up, "
      "round(greatest(probability_up, 1 - probability_up) * 100 + 1.3e-9, 1) AS confluence_pct FROM s3")(
    lambda t: rounded(X.confluence(X.indicators(t.bars_s)), 4, {"confluence_pct": 1}).select(
        "symbol", "trend_score", "rsi_score", "volume_score", "structure_score", "action", "probability_up", "confluence_pct"))
query("trade_plan", _S + "SELECT symbol, setup, entry_low, entry_high, stop_loss, target_1, target_2 FROM plan")(
    lambda t: X.trade_plan(X.confluence(X.indicators(t.bars_s))).select(
        "symbol", "setup", "entry_low", "entry_high", "stop_loss", "target_1", "target_2"))
query("trigger_state", _S + "SELECT symbol, trigger_state FROM plan")(lambda t: X.screen(t.bars_s).select("symbol", "trigger_state"))
query("screen", _S + """SELECT symbol, vol_regime, status, setup, trigger_state, CASE WHEN b THEN 'BUY' ELSE 'SELL' END AS action,
  CASE WHEN vol_regime IN ('LOW', 'NORMAL') THEN 'MODERATE' ELSE 'HIGH' END AS risk_rating FROM plan""")(
    lambda t: X.screen(t.bars_s).select("symbol", "vol_regime", "status", "setup", "trigger_state", "action", "risk_rating"))
query("risk_rating", """WITH {bars_s}, {screen}, m AS (SELECT symbol, vol_regime, bars, (bars % 100) / 100.0::DOUBLE AS p, 1 - 2 * abs((bars % 100) / 100.0::DOUBLE - 0.5) AS u FROM ind)
  SELECT symbol, CASE WHEN bars < 10 THEN 'INSUFFICIENT EVIDENCE' WHEN vol_regime = 'EXTREME' OR u > 0.85 THEN 'VERY HIGH'
  WHEN vol_regime = 'HIGH' OR u > 0.60 THEN 'HIGH' WHEN vol_regime = 'NORMAL' AND u < 0.40 THEN 'LOW' ELSE 'MODERATE' END AS risk_rating FROM m""")(
    lambda t: X.indicators(t.bars_s).select("symbol", X.risk_rating(
        F.col("vol_regime"), (F.col("bars") % 100) / 100.0, F.col("bars")).alias("risk_rating")))
query("direction_label", """WITH {scored} SELECT timestamp, symbol, CASE WHEN p >= 0.55 THEN 'UPWARD' WHEN p <= 0.45 THEN 'DOWNWARD' ELSE 'NEUTRAL' END AS direction
  FROM scored""")(
    lambda t: modeling.scored(t).select("timestamp", "symbol", X.direction(F.col("p")).alias("direction")))

# ---------------------------------------------------------------- research tables


def experiment_table(t):
    """Metrics of the stored predictions, one experiment per symbol."""
    long = M.evaluate(modeling.scored(t).filter("fold = 'test'"), "classification", ["symbol"])
    return long.select(F.concat(F.lower("symbol"), F.lit("_clf")).alias("experiment_id"), "metric", "value")


SQL_PARTS["exp"] = """{scored}, tested AS (SELECT * FROM scored WHERE fold = 'test'),
  cm AS (SELECT symbol, avg(CASE WHEN y = y_hat THEN 1.0::DOUBLE ELSE 0 END) AS accuracy, coalesce(2 * sum(y * y_hat) / nullif(sum(y) + sum(y_hat), 0), 0) AS f1,
    coalesce(sum(y * y_hat) / nullif(sum(y_hat), 0), 0) AS precision, coalesce(sum(y * y_hat) / nullif(sum(y), 0), 0) AS recall,
    avg((p - y) ** 2) AS brier_score, avg(-CASE WHEN y = 1 THEN ln(greatest(1e-15, least(p, 1 - 1e-15))) ELSE ln(1 - greatest(1e-15, least(p, 1 - 1e-15))) END) AS log_loss
    FROM tested GROUP BY 1),
  rk AS (SELECT symbol, y, rank() OVER (PARTITION BY symbol ORDER BY p) + (count(*) OVER (PARTITION BY symbol, p) - 1) / 2.0 AS k FROM tested),
  au AS (SELECT symbol, (sum(k * y) - sum(y) * (sum(y) + 1) / 2) / nullif(sum(y) * (count(*) - sum(y)), 0) AS roc_auc FROM rk GROUP BY 1),
  exp AS (SELECT lower(symbol) || '_clf' AS experiment_id, * EXCLUDE (symbol) FROM cm JOIN au USING (symbol))"""
query("experiments", "WITH {exp} SELECT experiment_id, " + _r("accuracy", "f1", "roc_auc", "brier_score")
      + ", 7 AS metrics FROM exp WHERE contains(experiment_id, 'nation_1')")(
    lambda t: rounded(R.experiments(experiment_table(t), "Nation_1"), 4))
query("compare_experiments", "WITH {exp}, m AS (" + " UNION ALL ".join(
    f"SELECT experiment_id, '{m}' AS metric, {m} AS value FROM exp" for m in (
        "accuracy", "precision", "recall", "f1", "roc_auc", "brier_score", "log_loss")) + """)
  SELECT metric, round(a.value + 1.3e-9, 4) AS value_a, round(b.value + 1.3e-9, 4) AS value_b, round(a.value - b.value + 1.3e-9, 4) AS delta
  FROM (SELECT * FROM m WHERE experiment_id = 'nation_1_clf') a FULL JOIN (SELECT * FROM m WHERE experiment_id = 'nation_2_clf') b USING (metric)""")(
    lambda t: rounded(R.compare_experiments(experiment_table(t), "nation_1_clf", "nation_2_clf", 12), 4))
query("latest_model", """WITH m AS (SELECT o_orderkey AS experiment_id, o_orderdate AS created_at, o_orderpriority AS target_name,
  CASE WHEN o_orderkey % 3 = 0 THEN 'ridge_regression' ELSE 'random_forest' END AS model_type FROM orders)
  SELECT experiment_id, model_type FROM m WHERE target_name = '2-HIGH' QUALIFY row_number() OVER (ORDER BY CASE WHEN model_type = 'ridge_regression' THEN 0 ELSE 1 END,
  created_at DESC, experiment_id) = 1""")(
    lambda t: R.latest_model(t.orders.select(
        F.col("o_orderkey").alias("experiment_id"), F.col("o_orderdate").alias("created_at"), F.col("o_orderpriority").alias("target_name"),
        F.when(F.col("o_orderkey") % 3 == 0, "ridge_regression").otherwise("random_forest").alias("model_type")),
        "2-HIGH", "ridge_regression").select("experiment_id", "model_type"))
query("runs", """WITH {chain_n}, {perf} SELECT run_id, created_at, trade_count, round(win_rate + 1.3e-9, 4) AS win_rate FROM perf
  JOIN (SELECT run_id, max(timestamp) AS created_at FROM curve GROUP BY 1) USING (run_id)""")(
    lambda t: rounded(R.runs(trading.metrics(t), trading.run_catalog(t)).select("run_id", "created_at", "trade_count", "win_rate"), 4))
query("evidence_bundle")(lambda t: R.evidence_bundle(
    R.experiments(experiment_table(t)), trading.metrics(t).select("run_id", "win_rate"), t.bars_n))

# ---------------------------------------------------------------- models (values depend on the learner)

def _model_query(kind, target):
    return lambda t: ml.run_experiment(modeling.labelled_all(t), modeling.ALL_FEATS, target, kind)


query("logreg")(_model_query("logistic_regression", modeling.Y))
query("ridge")(_model_query("ridge_regression", modeling.R))
query("random_forest")(_model_query("random_forest", modeling.Y))
query("random_forest_reg")(_model_query("random_forest", modeling.R))
query("gbt")(_model_query("lightgbm", modeling.Y))
query("gbt_reg")(_model_query("xgboost", modeling.R))
query("experiment", f"""WITH {{labelled_n}}, {{pfold_all}}, pr AS (SELECT avg(y) AS p, CASE WHEN avg(y) >= 0.5 THEN 1 ELSE 0 END AS h FROM pfold_all WHERE fold = 'train'),
  e AS (SELECT fold, avg(CASE WHEN y = h THEN 1.0::DOUBLE ELSE 0 END) AS accuracy, coalesce(sum(y * h) / nullif(sum(h), 0), 0)::DOUBLE AS precision,
  coalesce(sum(y * h) / nullif(sum(y), 0), 0)::DOUBLE AS recall, coalesce(2 * sum(y * h) / nullif(sum(y) + sum(h), 0), 0)::DOUBLE AS f1,
  CASE WHEN min(y) < max(y) THEN 0.5::DOUBLE END AS roc_auc, avg((p - y) ** 2) AS brier_score, avg(-CASE WHEN y = 1 THEN ln(p) ELSE ln(1 - p) END) AS log_loss
  FROM pfold_all, pr WHERE fold <> 'purged' GROUP BY fold)
  SELECT 'baseline_{modeling.Y}' AS experiment_id, 'baseline' AS model_type, '{modeling.Y}' AS target_name, 'classification' AS task_type, 42 AS seed,
  fold, metric, round(value + 1.3e-9, 6) AS value FROM e UNPIVOT INCLUDE NULLS (value FOR metric IN (accuracy, precision, recall, f1, roc_auc, brier_score, log_loss))""")(
    lambda t: rounded(_model_query("baseline", modeling.Y)(t)))
query("model_compare")(lambda t: ml.compare_models(
    modeling.labelled_all(t), modeling.ALL_FEATS, modeling.Y, ["baseline", "logistic_regression", "random_forest", "lightgbm"]))  # xgboost is the same learner


@query("wf_evaluate")
def _wf_evaluate(t):
    """Out-of-sample metrics per fold of a walk-forward run over all symbols, on one calendar."""
    rows = calendar_fold_rows(modeling.labelled(t).select("timestamp", "symbol", *modeling.FEATS, modeling.Y), modeling.WF)
    train = S.train_rows(rows, [*modeling.FEATS, modeling.Y])
    test = S.wf_impute(rows, modeling.FEATS).dropna(subset=[modeling.Y])
    scored = ml.wf_predict(train.unionByName(test), modeling.FEATS, modeling.Y, "logistic_regression", ml.CLASSIFICATION)
    return M.evaluate(scored, "classification", ["fold_idx"], y=modeling.Y)


def _stored(t, *kinds):
    """A store below the shared folder holding one experiment of each type, metrics and periods with it."""
    store = ModelStore(t.spark, f"{checkpoint_dir(t.spark).rstrip('/')}/models-{uuid.uuid4().hex}")
    for kind in kinds:
        model, folded = ml.fit_experiment(modeling.labelled_all(t), modeling.ALL_FEATS, modeling.Y, kind)
        store.save(model, kind, modeling.Y, 42, periods=fold_periods(folded), metrics=ml.experiment_metrics(model, folded, modeling.Y))
    return store


@query("model_record")
def _model_record(t):
    """Records of two stored models; the id's random part is cut off."""
    kept = _stored(t, "baseline", "logistic_regression").records()
    return kept.drop("created_at", "versions", "scaling").withColumn("experiment_id", F.regexp_replace("experiment_id", "_[0-9a-f]{12}$", ""))


# The majority class of the training fold on each symbol's last row: a stored baseline is loaded and scores.
query("score_latest_baseline", "WITH {labelled_n}, {pfold}, pr AS (SELECT avg(y) AS p FROM pfold WHERE fold = 'train') "
      """SELECT symbol, max(timestamp) AS timestamp, round(any_value(p) + 1.3e-9, 6) AS probability_up, any_value(CASE WHEN p >= 0.55 THEN 'UPWARD'
  WHEN p <= 0.45 THEN 'DOWNWARD' ELSE 'NEUTRAL' END) AS direction FROM labelled, pr GROUP BY symbol""")(
    lambda t: rounded(X.score_latest(modeling.labelled(t), _stored_baseline(t), modeling.FEATS)))


def _stored_baseline(t):
    store = ModelStore(t.spark, f"{checkpoint_dir(t.spark).rstrip('/')}/models-{uuid.uuid4().hex}")
    model, folded = ml.fit_experiment(modeling.labelled(t), modeling.FEATS, modeling.Y, "baseline")
    store.save(model, "baseline", modeling.Y, 42, periods=fold_periods(folded))
    return store.load_latest(modeling.Y, "baseline")


@query("score_latest")
def _score_latest(t):
    """Trained, saved, loaded again and applied to the last row per symbol."""
    model = _stored(t, "logistic_regression").load_latest(modeling.Y, "logistic_regression")
    return X.score_latest(modeling.labelled_all(t), model, modeling.ALL_FEATS)


@query("predict_proba")
def _predict(t):
    rows = S.panel_split(modeling.labelled(t).dropna(), gap=5)
    model = ml.fit_model(rows.filter("fold = 'train'"), modeling.FEATS, modeling.Y, "logistic_regression", ml.CLASSIFICATION)
    return model.predict(rows.filter("fold = 'test'")).select("timestamp", "symbol", "y_hat", "p")


@query("vector_assemble")
def _assembled(t):
    return ml.assemble(modeling.dataset(t).modeling_rows(modeling.Y), modeling.FEATS).select(
        "timestamp", "symbol", F.size(ml.vector_to_array("features")).alias("width"))

