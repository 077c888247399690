"""Walk-forward folds on one calendar and equity carried through them, against a plain simulation."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from barloom.operators import walkforward as WF
from barloom.operators.signals import Costs
from barloom.operators.splits import WalkForward

CONFIG = WalkForward(n_folds=3, min_train=12, gap=4)
COSTS = Costs()
INITIAL, SHARE = 1000.0, 0.5


@pytest.fixture(scope="module")
def scored(spark):
    """Three symbols with different starts and gaps, so that positions in a series are no common dates."""
    rnd, rows = random.Random(8), []
    for symbol, first, keep in (("AAA", 0, 1.0), ("BBB", 25, 0.9), ("CCC", 3, 0.4)):
        price = 100.0
        for day in range(first, 60):
            price *= rnd.uniform(0.94, 1.06)
            if rnd.random() < keep:
                opened = price * rnd.uniform(0.99, 1.01)
                rows.append((datetime(2024, 1, 1) + timedelta(days=day), symbol, opened, max(price, opened) * 1.01, min(price, opened) * 0.99, price, 1000.0,
                             rnd.choice([None, 0.1, 0.5, 0.9, 0.95])))
    return spark.createDataFrame(rows, "timestamp timestamp_ntz, symbol string, open double, high double, low double, close double, volume double, p double")


def test_no_training_date_reaches_a_test_date(scored):
    spans = {(r.fold_idx, r.part): r for r in WF.calendar_fold_rows(scored, CONFIG).groupBy("fold_idx", "part").agg(
        F.min("timestamp").alias("a"), F.max("timestamp").alias("b")).collect()}
    dates = sorted(r[0] for r in scored.select("timestamp").distinct().collect())
    folds = sorted({k for k, _ in spans})
    assert len(folds) == 3
    for k in folds:
        assert spans[k, "train"].b < spans[k, "test"].a
        assert dates.index(spans[k, "test"].a) - dates.index(spans[k, "train"].b) == CONFIG.gap + 1
    assert [spans[k, "test"].b < spans[k + 1, "test"].a for k in folds[:-1]] == [True, True]


def plain(rows):
    """Per symbol: every bar of every fold as the rules say it, one after the other."""
    dates = sorted({r.timestamp for r in rows})
    size = max(10, (len(dates) - CONFIG.min_train - CONFIG.gap) // CONFIG.n_folds)
    curve, trades, equity, peak_of = {}, [], {}, {}
    for k in range(CONFIG.n_folds):
        stop = len(dates) - (CONFIG.n_folds - 1 - k) * size
        if stop - size < CONFIG.min_train + CONFIG.gap:
            continue
        for symbol in sorted({r.symbol for r in rows}):
            bars = sorted((r for r in rows if r.symbol == symbol and dates[stop - size] <= r.timestamp <= dates[stop - 1]), key=lambda r: r.timestamp)
            held, wanted, fill, before = False, False, None, None
            start = value = peak = equity.get(symbol, INITIAL)
            for i, b in enumerate(bars):
                growth = 1.0
                if wanted and not held:
                    fill = min(b.open * (1 + COSTS.slippage), b.high)
                    growth, held = b.close / fill * (1 - COSTS.commission), True
                elif held and not wanted:
                    out = max(b.open * (1 - COSTS.slippage), b.low)
                    growth, held = out / before * (1 - COSTS.commission), False
                    trades.append((symbol, k, out - fill - (out + fill) * COSTS.commission - 2))
                elif held:
                    growth = b.close / before
                if held and i == len(bars) - 1:
                    out = max(b.close * (1 - COSTS.slippage), b.low)
                    growth *= out / b.close * (1 - COSTS.commission)
                    trades.append((symbol, k, out - fill - (out + fill) * COSTS.commission - 2))
                value *= 1 + (growth - 1) * SHARE
                peak = max(peak, value)
                curve[symbol, k, b.timestamp] = (start, value, value / peak - 1)
                wanted = True if b.p is not None and b.p >= 0.8 else False if b.p is not None and b.p <= 0.3 else wanted
                before = b.close
            equity[symbol] = value
    return curve, trades


def test_equity_is_carried_and_marks_start_anew(scored):
    curve, trades, train = WF.walk_forward(scored, CONFIG, 0.8, 0.3, INITIAL, COSTS, SHARE, 1.0)
    expected, expected_trades = plain(scored.collect())
    got = {(r.run_id, r.fold_idx, r.timestamp): r for r in curve.collect()}
    assert got.keys() == expected.keys() and len(expected) > 60
    for key, (start, value, drawdown) in expected.items():
        assert (got[key].start_equity, got[key].portfolio_equity, got[key].drawdown) == pytest.approx((start, value, drawdown))
    assert sorted((r.run_id, r.fold_idx, round(r.net_pnl, 6)) for r in trades.collect()) == sorted((s, k, round(v, 6)) for s, k, v in expected_trades)
    steps = {}
    for r in WF.fold_equity(curve).orderBy("run_id", "fold_idx").collect():
        assert r.start_equity == pytest.approx(steps.get(r.run_id, INITIAL))
        steps[r.run_id] = r.final_equity

    table = {(r.run_id, r.fold): r for r in WF.wf_summary(curve, trades, train, INITIAL, CONFIG.gap).collect()}
    assert all(c in table["AAA", "OVERALL"] for c in WF.SUMMARY)
    for symbol, last in steps.items():
        folds = [r for (s, f), r in table.items() if s == symbol and f != "OVERALL"]
        overall = table[symbol, "OVERALL"]
        assert overall.total_return == pytest.approx(last / INITIAL - 1)
        assert overall.max_drawdown == pytest.approx(max(r.max_drawdown for r in folds))
        assert overall.trade_count == sum(r.trade_count for r in folds) == sum(s == symbol for s, _, _ in expected_trades)
        assert (overall.train_bars, overall.test_bars) == (sum(r.train_bars for r in folds), sum(r.test_bars for r in folds))
        assert (overall.test_start, overall.test_end) == (min(r.test_start for r in folds), max(r.test_end for r in folds))


def test_folds_of_an_empty_table(scored):
    assert WF.calendar_fold_rows(scored.filter("false"), CONFIG).collect() == []
