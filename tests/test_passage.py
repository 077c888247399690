"""First-passage searches against a scan of each series."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from barloom.operators import signals as S
from barloom.operators.passage import first_passage, passage_index


@pytest.mark.parametrize("width", [7, 64])
def test_any_distance_and_one_hot_symbol(spark, width):
    rnd = random.Random(width)
    series = {"HOT": [rnd.uniform(0, 100) for _ in range(500)], "B": [50.0, None, 70.0], "C": [None]}
    rows = [(s, i + 1, v, v, f"{s}{i}") for s, values in series.items() for i, v in enumerate(values)]
    rows += [("B", 4, 1.0, 99.5, "B3")]
    table = spark.createDataFrame(rows, "symbol string, n long, low double, high double, tag string")
    index = passage_index(table, ["low"], ["high"], ["tag", "n"], width=width)
    assert len(index.levels) == (4 if width == 7 else 2)
    searches = [(i, "HOT" if i % 10 else rnd.choice(["B", "C", "unknown", None]), rnd.randrange(1, 520), rnd.choice([None, 0.05, 1.0, 30.0]),
                 rnd.choice([None, 99.9, 98.0, 60.0, 200.0])) for i in range(400)]
    asked = spark.createDataFrame(searches, "id long, symbol string, start long, below double, above double")
    hit = lambda c: F.coalesce(c["low"] <= F.col("below"), F.lit(False)) | F.coalesce(c["high"] >= F.col("above"), F.lit(False))
    got = {r.id: r.found for r in first_passage(asked, index, F.col("start"), hit, "found").collect()}
    assert len(got) == len(searches)
    for i, symbol, start, below, above in searches:
        expected = next((tag for s, n, low, high, tag in sorted(rows, key=lambda r: r[1]) if s == symbol and n >= start and low is not None
                         and ((below is not None and low <= below) or (above is not None and high >= above))), None)
        assert (got[i].tag if got[i] else None) == expected


def plain_exit(bars, i, rule, leave, costs):
    """(exit place, reason) of an entry decided at bar i."""
    e = i + 1
    fill = min(bars[e].open * (1 + costs.slippage), bars[e].high)
    for j in range(e, len(bars) - 1):
        pnl = (bars[j].close - fill) / fill
        reasons = [("stop_loss", rule.stop_loss is not None and pnl <= -rule.stop_loss), ("take_profit", rule.take_profit is not None and pnl >= rule.take_profit),
                   ("max_holding_period", rule.holding is not None and j - e >= rule.holding), ("signal_exit", bars[j].p is not None and bars[j].p <= leave)]
        for name, hit in reasons:
            if hit:
                return j + 1, name
    return len(bars) - 1, "end_of_simulation"


@pytest.mark.parametrize("grain, step", [("day", timedelta(days=1)), ("hour", timedelta(hours=1))])
def test_optional_barriers_and_threshold_grid(spark, grain, step):
    rnd, rows, price = random.Random(3), [], 100.0
    for symbol in ("A", "B"):
        for k in range(150):
            price *= rnd.uniform(0.97, 1.03)
            rows.append((datetime(2024, 1, 1) + k * step, symbol, price * 1.001, price * 1.02, price * 0.98, price, 10.0, rnd.choice([None, 0.02, 0.4, 0.6, 0.85, 0.99])))
    table = spark.createDataFrame(rows, "timestamp timestamp_ntz, symbol string, open double, high double, low double, close double, volume double, p double")
    series = {s: sorted((r for r in table.collect() if r.symbol == s), key=lambda r: r.timestamp) for s in "AB"}
    costs = S.Costs()
    rules = [S.Barriers(), S.Barriers(stop_loss=0.05), S.Barriers(take_profit=0.04, holding=60), S.Barriers(0.03, 0.03, 5)]
    for rule in rules:
        got = {(r.symbol, r.signal_time): (r.exit_time, r.exit_reason, r.holding_bars) for r in S.barrier_exits(table, 0.8, -1.0, rule, costs, grain).collect()}
        expected = {}
        for symbol, bars in series.items():
            for i, b in enumerate(bars[:-1]):
                if b.p is not None and b.p >= 0.8:
                    x, reason = plain_exit(bars, i, rule, -1.0, costs)
                    expected[symbol, b.timestamp] = (bars[x].timestamp, reason, x - i - 1)
        assert got == expected
    if grain == "day":
        table_rows = S.threshold_sweep(table, [0.5, 0.8, 0.9], [0.05, -1.0], rules, costs).collect()
        assert len(table_rows) == 3 * 2 * len(rules)
        for r in table_rows:
            rule = S.Barriers(r.stop_loss, r.take_profit, r.holding)
            one = S.param_sweep(table, r.enter, r.leave, [rule], costs).first() if r.enter == 0.8 and r.leave == 0.05 else None
            n = sum(1 for bars in series.values() for b in bars[:-1] if b.p is not None and b.p >= r.enter)
            held = [plain_exit(bars, i, rule, r.leave, costs)[0] - i - 1 for bars in series.values() for i, b in enumerate(bars[:-1]) if b.p is not None and b.p >= r.enter]
            assert r.trades == n and r.avg_holding == pytest.approx(sum(held) / n)
            assert one is None or (one.trades, one.avg_pnl_pct, one.win_rate) == pytest.approx((r.trades, r.avg_pnl_pct, r.win_rate))
