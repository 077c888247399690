import math
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from barloom.operators import joins as J
from barloom.operators import ledger as L
from barloom.operators import metrics as M
from barloom.operators import ml
from barloom.operators import performance as P
from barloom.operators import risk as K
from barloom.operators import screener as X
from barloom.operators import signals as S
from barloom.operators import splits as SP
from barloom.streaming import bars as SB


# ------------------------------------------------------------ splits and folds

def test_split_60_20_20_and_purge(bars):
    df = SP.split_by_ratio(bars(list(range(1, 101))))
    assert {r.fold: r["count"] for r in df.groupBy("fold").count().collect()} == {"train": 60, "validation": 20, "test": 20}
    purged = SP.split_by_ratio(bars(list(range(1, 101))), gap=5).groupBy("fold").count()
    assert {r.fold: r["count"] for r in purged.collect()} == {"train": 55, "validation": 15, "test": 20, "purged": 10}
    with pytest.raises(ValueError):
        SP.check_ratios(.5, .2, .2)


def test_split_same_when_chunked(bars):
    df = bars(list(range(1, 301)))
    assert SP.split_by_ratio(df, gap=3).exceptAll(SP.split_by_ratio(df, gap=3, grain="hour")).count() == 0
    panel = SP.panel_split(df.unionByName(bars(list(range(1, 151)), "BBB")), gap=3)
    assert panel.groupBy("timestamp").agg(F.countDistinct("fold").alias("f")).filter("f > 1").count() == 0


def test_walk_forward_purge_gap(bars):
    rows = SP.wf_windows(bars([1.0] * 150), SP.WalkForward(3, 40, 7)).collect()
    assert len(rows) == 3 and all(r.test_start - r.train_end == 7 for r in rows)
    assert [(r.test_start, r.test_end) for r in sorted(rows, key=lambda r: r.fold_idx)] == [(48, 82), (82, 116), (116, 150)]
    assert SP.wf_windows(bars([1.0] * 60), SP.WalkForward(3, 50, 20)).count() == 0


# ------------------------------------------------------------ metrics and models

def test_classification_metrics(spark):
    df = spark.createDataFrame([(1, 1, .9), (0, 0, .1), (1, 0, .4), (0, 1, .6)], "y int, y_hat int, p double")
    row = M.classification(df, []).first()
    assert (row.accuracy, row.precision, row.recall, row.f1) == (.5, .5, .5, .5)
    assert row.brier_score == pytest.approx((.01 + .01 + .36 + .36) / 4)
    assert M.roc_auc(df, []).first()[0] == pytest.approx(.75)
    assert M.roc_auc(df.filter("y = 1"), []).first()[0] is None
    none = M.classification(df.withColumn("y_hat", F.lit(0)), []).first()
    assert (none.precision, none.recall, none.f1) == (0, 0, 0)


def test_auc_with_ties_equals_pair_count(spark):
    rows = [(i % 2 if i % 3 else 1, ((i * 37) % 20) / 20) for i in range(200)]
    pos, neg = [p for y, p in rows if y], [p for y, p in rows if not y]
    want = sum((a > b) + (a == b) / 2 for a in pos for b in neg) / len(pos) / len(neg)
    assert M.roc_auc(spark.createDataFrame(rows, "y int, p double"), []).first()[0] == pytest.approx(want)


def test_regression_metrics(spark):
    df = spark.createDataFrame([(1.0, 1.5), (-2.0, -1.0), (3.0, -.5)], "y double, y_hat double")
    row = M.regression(df, []).first()
    assert row.mae == pytest.approx(5 / 3) and row.rmse == pytest.approx(math.sqrt(13.5 / 3))
    assert row.directional_accuracy == pytest.approx(2 / 3)
    assert M.regression(df.withColumn("y_hat", F.lit(1.0)), []).first().pearson_corr is None


@pytest.fixture(scope="module")
def learnable(spark):
    return spark.range(400).select(
        F.date_add(F.lit("2020-01-01").cast("date"), (F.col("id") / 4).cast("int")).cast("timestamp_ntz").alias("timestamp"),
        F.concat(F.lit("S"), F.col("id") % 4).alias("symbol"),
        (F.pmod(F.xxhash64("id"), F.lit(1000)) / 500 - 1).alias("a"), (F.pmod(F.xxhash64("id", F.lit(1)), F.lit(1000)) / 500 - 1).alias("b")
    ).withColumns({"y": (F.col("a") + F.col("b") * .1 > 0).cast("double"), "r": F.col("a") * 2 - F.col("b")}).cache()


@pytest.mark.parametrize("kind, target, task", [
    ("baseline", "y", "classification"), ("logistic_regression", "y", "classification"), ("random_forest", "y", "classification"),
    ("xgboost", "y", "classification"), ("baseline", "r", "regression"), ("ridge_regression", "r", "regression"),
    ("random_forest", "r", "regression"), ("lightgbm", "r", "regression")])
def test_models_fit_and_predict(learnable, kind, target, task):
    params = {"n_estimators": 5} if kind in ("random_forest", "xgboost", "lightgbm") else None
    model = ml.fit_model(learnable, ["a", "b"], target, kind, task, params)
    out = model.predict(learnable)
    assert out.count() == 400 and ("p" in out.columns) == (task == "classification")
    assert out.filter("a IS NULL OR abs(a) > 1").count() == 0  # features come back unscaled
    if kind != "baseline":
        good = M.classification(out, [], y="y").first().accuracy > .8 if task == "classification" else \
            M.regression(out, [], y="r").first().r2 > .5
        assert good
    with pytest.raises(ValueError):
        model.predict(learnable.drop("a"))


def test_ridge_equals_closed_form(learnable):
    import numpy as np
    model = ml.fit_model(learnable, ["a", "b"], "r", "ridge_regression", "regression", {"alpha": 5.0})
    pdf = learnable.toPandas()
    x = ((pdf[["a", "b"]] - pdf[["a", "b"]].mean()) / pdf[["a", "b"]].std(ddof=0)).to_numpy()
    want = np.linalg.solve(x.T @ x + 5.0 * np.eye(2), x.T @ (pdf["r"] - pdf["r"].mean()))
    assert model.model.coefficients.toArray() == pytest.approx(want, abs=1e-8)


def test_unknown_model_and_bad_target(learnable):
    with pytest.raises(ValueError):
        ml.fit_model(learnable, ["a"], "y", "oracle", "classification")
    with pytest.raises(ValueError):
        ml.fit_model(learnable, ["a"], "r", "logistic_regression", "classification")
    assert ml.infer_task(learnable, "y") == ("classification", 1) and ml.infer_task(learnable, "r")[0] == "regression"


# ------------------------------------------------------------ signals

def scored(bars, closes, p, **kw):
    df = bars(closes, **kw)
    first = df.agg(F.min("timestamp")).first()[0]
    at = F.datediff("timestamp", F.lit(first)) + 1
    return df.withColumn("p", F.element_at(F.array(*[F.lit(x) for x in p]), at).cast("double"))


def test_single_trade_to_the_penny(bars):
    costs = S.Costs(commission_bps=10, fixed_fee=1, slippage_bps=0)
    df = scored(bars, [100, 100, 110], [1.0, 0.0, 0.0], opens=[100, 100, 110], highs=[120] * 3, lows=[90] * 3)
    trip = S.round_trips(S.held_bars(df, .8, .3, costs), 100, costs).first()
    assert (trip.gross_pnl, trip.total_fees, trip.net_pnl) == pytest.approx((1000, 23, 977))
    assert (trip.holding_bars, trip.exit_reason) == (1, "signal_exit")


def test_fill_waits_for_the_next_open(bars):
    df = S.next_bar_fill(bars([101, 103], opens=[100, 102], highs=[104, 104], lows=[99, 99]), S.Costs(slippage_bps=0)).orderBy("timestamp").collect()
    assert (df[0].buy_fill, df[0].sell_fill, df[1].buy_fill) == (102, 102, None)


def test_fills_are_clamped_to_the_bar(bars):
    row = S.next_bar_fill(bars([100, 100], highs=[103, 103], lows=[97, 97], opens=[100, 100]), S.Costs(slippage_bps=500)).orderBy("timestamp").first()
    assert (row.buy_fill, row.sell_fill) == (103, 97)


def test_volume_caps_the_fill(spark):
    row = S.fill_costs(spark.range(1), F.lit(500.0), F.lit(10.0), F.lit(10.0), F.lit(1000.0)).first()
    assert row.filled_quantity == 100


def test_position_needs_two_thresholds(bars):
    with pytest.raises(ValueError):
        S.position_state(scored(bars, [1, 2], [1, 0]), .5, .5)


@pytest.mark.parametrize("closes, p, reason, bars_held", [
    ([100, 100, 90, 90, 90], [1, .5, .5, .5, .5], "stop_loss", 2), ([100, 100, 120, 120, 120], [1, .5, .5, .5, .5], "take_profit", 2),
    ([100] * 8, [1] + [.5] * 7, "max_holding_period", 4), ([100, 100, 100, 100], [1, .5, .1, .5], "signal_exit", 2),
    ([100, 100, 101], [1, .5, .5], "end_of_simulation", 1)])
def test_barriers(bars, closes, p, reason, bars_held):
    df = scored(bars, closes, p, opens=closes, highs=[c * 2 for c in closes], lows=[c / 2 for c in closes])
    rule = S.Barriers(.05, .10, 3)
    for grain in ("day", "hour"):
        got = S.barrier_exits(df, .8, .3, rule, S.Costs(slippage_bps=0), grain=grain).collect()
        assert [(g.exit_reason, g.holding_bars) for g in got] == [(reason, bars_held)]


def test_trades_of_a_hot_series_in_blocks(bars, monkeypatch):
    import barloom.panel as panel
    monkeypatch.setattr(panel, "CHUNK_ROWS", 64)
    closes = [100 + (i * 7919) % 37 for i in range(400)]
    df = scored(bars, closes, [((i * 31) % 100) / 100 for i in range(400)])
    one = S.round_trips(S.held_bars(df, .8, .3))
    two = S.round_trips(S.held_bars(df, .8, .3, grain="hour"))
    assert one.count() > 20 and one.exceptAll(two).count() == 0


def test_metrics_of_a_known_curve(spark):
    e = [100, 110, 99, 120]
    curve = spark.createDataFrame([("r", datetime(2024, 1, 1) + timedelta(days=i), float(v), 1.0) for i, v in enumerate(e)],
                                  "run_id string, timestamp timestamp_ntz, portfolio_equity double, gross_exposure double")
    full = P.drawdown_curve(P.equity_returns(curve, 100), 100)
    trades = spark.createDataFrame([("r", 1.0, 10.0, 12.0, .5, 1.5), ("r", 1.0, 10.0, 9.0, .5, -1.5)],
                                   "run_id string, quantity double, entry_price double, exit_price double, total_fees double, net_pnl double")
    m = P.perf_metrics(full, trades, 100).first()
    assert m.total_return == pytest.approx(.2) and m.maximum_drawdown == pytest.approx(.1)
    assert m.annualized_return == pytest.approx(1.2 ** 63 - 1) and m.win_rate == .5 and m.profit_factor == 1
    assert m.sortino_ratio == pytest.approx((m.annualized_return - .02) / (.1 * math.sqrt(252)))
    assert m.turnover == pytest.approx(41 / (2 * 107.25))
    idle = P.perf_metrics(full, trades.filter("false"), 100).first()
    assert (idle.trade_count, idle.profit_factor, idle.turnover) == (0, 0, 0)


# ------------------------------------------------------------ risk, ledger, look-ups

ORDER = "order_id int, timestamp int, symbol string, action string, quantity double, price double, held_quantity double, " \
        "gross_value double, equity double, cash double, drawdown double"


@pytest.mark.parametrize("order, limits, want", [
    (("BUY", 150, 100, 0, 0, 1e6, 1e6, 0), dict(max_position_exposure=10_000), ("REDUCED", 100, "max_position_exposure")),
    (("BUY", 50, 100, 100, 10_000, 1e6, 1e6, 0), dict(max_position_exposure=10_000), ("REJECTED", 0, "max_position_exposure")),
    (("BUY", 400, 50, 0, 0, 50_000, 5e4, 0), dict(max_position_concentration=.2), ("REDUCED", 200, "max_position_concentration")),
    (("BUY", 10, 50, 0, 0, 5e4, 5e4, .25), {}, ("REJECTED", 0, "max_drawdown_limit")),
    (("SELL", 10, 50, 0, 0, 5e4, 5e4, .25), {}, ("REJECTED", 0, "short_selling_disabled")),
    (("SELL", 10, 50, 4, 200, 5e4, 5e4, .25), {}, ("REDUCED", 4, "held_position_limit")),
    (("SELL", 4, 50, 4, 200, 5e4, 5e4, .25), {}, ("ACCEPTED", 4, None)),
    (("BUY", 100, 100, 0, 49_500, 5e4, 5e4, 0), {}, ("REDUCED", 5, "max_portfolio_exposure")),
    (("BUY", 100, 100, 0, 0, 5e4, 1000, 0), dict(cash_buffer=.1), ("REDUCED", 9, "cash_buffer")),
    (("BUY", 100, 100, 0, 0, 5e4, 0, 0), {}, ("REJECTED", 0, "cash_buffer")),
    (("BUY", 0, 100, 0, 0, 5e4, 5e4, 0), {}, ("REJECTED", 0, "order_sanity")),
    (("BUY", 1, 100, 0, 0, 5e4, 5e4, 0), {}, ("ACCEPTED", 1, None))])
def test_risk_rules(spark, order, limits, want):
    action, *numbers = order
    df = spark.createDataFrame([(1, 1, "A", action, *map(float, numbers))], ORDER)
    row = K.evaluate_orders(df, K.RiskLimits(**limits)).first()
    assert (row.status, pytest.approx(row.approved_quantity), row.constraint_triggered) == want
    assert len(row) == 16


def test_risk_limits_are_checked():
    for bad in (dict(max_position_concentration=0), dict(cash_buffer=1), dict(max_drawdown=2), dict(max_portfolio_exposure=0)):
        with pytest.raises(ValueError):
            K.RiskLimits(**bad)


def test_paper_fees(spark):
    row = spark.range(1).select(L.slippage_price(F.lit(200.0), F.lit("BUY")).alias("p"),
                                L.order_fees(F.lit(2001.0), F.lit("USD")).alias("f")).first()
    assert (row.p, row.f) == (200.10, 3.00)


def _fold_positions(fills):
    held, avg, pnl = 0.0, 0.0, 0.0
    for _, _, _, action, q, px, fee in fills:
        if action == "BUY":
            avg, held = (held * avg + q * px) / (held + q), held + q
        else:
            pnl += q * (px - avg) - fee
            held -= q
            if abs(held) <= 1e-7:
                held = 0.0
    return held, avg if held else 0.0, pnl


@pytest.mark.parametrize("spread", [300.0, 30.0])
def test_average_cost_ledger_of_one_hot_account(spark, monkeypatch, spread):
    """Long chains of partial sells, closings and blocks smaller than the log."""
    monkeypatch.setattr(L, "_SPREAD", spread)
    fills, held = [], 0.0
    for i in range(600):
        px = 50 + (i * 7919) % 41
        if held == 0 or i % 3 == 0:
            fills.append(("acc", "S", i, "BUY", float(1 + i % 5), float(px), .5))
            held += 1 + i % 5
        else:
            q = held if i % 300 == 299 else held * .3
            fills.append(("acc", "S", i, "SELL", q, float(px), .5))
            held -= q
    df = spark.createDataFrame(fills, "account string, symbol string, seq bigint, action string, quantity double, price double, fee double")
    row = L.positions(L.position_path(df, F.floor(F.col("seq") / 64))).first()
    assert (row.quantity, row.average_cost, row.realized_pnl) == pytest.approx(_fold_positions(fills), rel=1e-9)


def test_limit_order_touch(spark, bars):
    df = bars([210, 198, 190, 230], highs=[215, 205, 195, 240], lows=[205, 197, 188, 220])
    orders = spark.createDataFrame(
        [(1, "AAA", datetime(2024, 1, 1), "BUY", 200.0), (2, "AAA", datetime(2024, 1, 2), "SELL", 235.0),
         (3, "AAA", datetime(2023, 1, 1), "BUY", 1.0), (4, "AAA", datetime(2025, 1, 1), "BUY", 500.0), (5, "ZZZ", datetime(2024, 1, 1), "BUY", 500.0)],
        "order_id bigint, symbol string, created_at timestamp_ntz, action string, limit_price double")
    for rows in (1, 2, 256):
        got = {r.order_id: r.filled_at for r in J.limit_first_touch(orders, df, rows=rows).collect()}
        assert got == {1: datetime(2024, 1, 2), 2: datetime(2024, 1, 4), 3: None, 4: None, 5: None}


def test_asof_join_of_a_hot_key(spark):
    left = spark.range(500).select(F.lit("hot").alias("k"), F.col("id"), F.timestamp_seconds(F.col("id") * 7).alias("t"))
    right = spark.range(40).select(F.lit("hot").alias("k"), F.timestamp_seconds(F.col("id") * 90 + 5).alias("t"), F.col("id").alias("v"))
    for r in J.asof_join(left, right, "k", "t", "t", ["v"], 100).collect():
        at = r.id * 7
        assert r.asof_v == (None if at < 5 else min(39, (at - 5) // 90))


def test_instrument_fallback(spark):
    universe = spark.createDataFrame([("^NSEI", "Nifty", "NSE", "INR", "INDEX", "IN", "Index"), ("SPY", "Spider", "ARCA", "USD", "ETF", "US", "Broad")],
                                     "symbol string, name string, exchange string, currency string, asset_type string, country string, sector string")
    rows = spark.createDataFrame([("nsei",), ("SPY",), ("abc.bo",)], "symbol string")
    got = {r.symbol: (r.instrument, r.exchange, r.currency) for r in J.enrich_instruments(rows, universe).collect()}
    assert got == {"nsei": ("^NSEI", "NSE", "INR"), "SPY": ("SPY", "ARCA", "USD"), "abc.bo": ("ABC.BO", "BSE", "INR")}


def test_screener_of_short_and_long_history(bars):
    rows = {r.symbol: r for r in X.screen(bars([100 + i for i in range(60)], "UP").unionByName(bars([100, 101], "NEW"))).collect()}
    assert rows["NEW"].status == "INSUFFICIENT_EVIDENCE" and rows["UP"].status == "VALIDATED"
    assert rows["UP"].trend_score == 18 and rows["UP"].rsi_14 > 99 and rows["NEW"].annual_volatility == pytest.approx(.01 * math.sqrt(252))


# ------------------------------------------------------------ streams

def test_stream_bars_equal_batch_and_drop_late_rows(spark, tmp_path):
    from barloom.sources.bars import event_bars
    path = "/root/testdata/sf0.001"
    ticks = SB.stream_table(spark, path, "events.parquet")
    bars = SB.stream_bars(ticks, F.upper("event_type"), F.col("ts"), F.col("value"), F.col("event_id"), "1 hour")
    got = SB.run_to_table(bars, str(tmp_path / "bars")).withColumn("timestamp", F.col("timestamp").cast("timestamp_ntz"))
    batch = event_bars(spark.read.parquet(f"{path}/events.parquet"))
    assert got.count() > 400 and got.exceptAll(batch.select(got.columns)).count() == 0
