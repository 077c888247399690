import math
import random
import re
import statistics
from datetime import datetime, timedelta

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from barloom.functions import features as FT
from barloom.functions import targets as TG
from barloom.functions.indicators import candles
from barloom.operators.dataset import ModelingDataset, label_dataset
from barloom.panel import CHUNK_ROWS, open_frame


def near(got, want, tol=1e-9):
    assert len(got) == len(want)
    for g, w in zip(got, want):
        assert (g is None) == (w is None), (got, want)
        if w is not None:
            assert g == pytest.approx(w, abs=tol)


def test_simple_and_multi_period_returns(bars, column):
    df = FT.compute_features(bars([100, 110, 121, 108.9]), features=FT.multi_period_returns([1, 2]))
    near(column(df, "return_1d"), [None, .10, .10, -.10])
    near(column(df, "return_2d"), [None, None, .21, -.01])


def test_return_needs_positive_base(bars, column):
    near(column(FT.compute_features(bars([0, 5, 10]), ["return_1d"]), "return_1d"), [None, None, 1.0])


def test_moving_averages(bars, column):
    def f(name, build, k):
        return FT.Feature(name, "MOMENTUM", ("close",), k, build)
    df = FT.compute_features(bars([10, 20, 30, 40, 50]), features=[
        f("sma", lambda b: b.roll("avg", "close", 3), 3), f("mom", lambda b: F.col("close") - b.lag("close", 2), 2),
        f("roc", lambda b: b.change("close", 2) * 100, 2), f("rel", FT._price_to_sma(3), 3), f("spread", FT._sma_spread(2, 3), 3)])
    near(column(df, "sma"), [None, None, 20, 30, 40])
    near(column(df, "mom"), [None, None, 20, 20, 20])
    near(column(df, "roc")[:3], [None, None, 200])
    near(column(df, "rel")[:3], [None, None, .5])
    near(column(df, "spread")[:3], [None, None, .25])


def test_rolling_std_starts_at_row_k(bars, column):
    closes = [100, 101, 99, 102, 103]
    r = [b / a - 1 for a, b in zip(closes, closes[1:])]
    df = FT.compute_features(bars(closes), features=[FT.Feature("sd", "VOLATILITY", ("close",), 3, FT._vol_std(3))])
    near(column(df, "sd"), [None, None, statistics.stdev(r[:2]), statistics.stdev(r[:3]), statistics.stdev(r[1:4])])


def test_true_range_and_atr(bars, column):
    df = FT.compute_features(bars([10, 11, 9], highs=[11, 12, 10], lows=[9, 10, 8]), features=[
        FT.Feature("tr", "VOLATILITY", ("high", "low", "close"), 1, lambda b: b.true_range()),
        FT.Feature("atr", "VOLATILITY", ("high", "low", "close"), 2, FT._atr(2))])
    near(column(df, "tr"), [2, 2, 3])
    near(column(df, "atr"), [None, 2, 2.5])


def test_volume_features(bars, column):
    v = [1000, 1200, 1500, 900, 1100]
    df = FT.compute_features(bars([1] * 5, volumes=v), features=[
        FT.Feature("chg", "VOLUME", ("volume",), 1, lambda b: b.change("volume", 1)),
        FT.Feature("rel", "VOLUME", ("volume",), 3, FT._volume_ratio(3)), FT.Feature("z", "VOLUME", ("volume",), 3, FT._volume_z(3))])
    near(column(df, "chg")[:2], [None, .2])
    near(column(df, "rel")[2:4], [1500 / (3700 / 3), 900 / 1200])
    near(column(df, "z")[3:4], [(900 - 1200) / (statistics.stdev([1200, 1500, 900]) + 1e-8)])


def test_structure_bounds(spark, bars):
    df = FT.compute_features(bars([5 + math.sin(i) for i in range(80)], highs=[6.2 + math.sin(i) for i in range(80)],
                                  lows=[4 + math.sin(i) for i in range(80)]), groups=["PRICE_STRUCTURE"])
    bad = df.filter("dist_high_10d > 0 OR dist_low_10d < 0 OR range_pos_10d NOT BETWEEN 0 AND 1 OR range_pos_60d NOT BETWEEN 0 AND 1")
    assert bad.count() == 0
    flat = FT.compute_features(bars([7] * 12), ["range_pos_10d"])
    assert flat.agg(F.max("range_pos_10d")).first()[0] == 0.5


def test_registry_has_43_features_and_refuses_bad_ones():
    assert len(FT.REGISTRY.select()) == 43
    reg = FT.default_registry()
    with pytest.raises(ValueError):
        reg.register(FT.Feature("return_1d", "PRICE", ("close",), 1, None))
    with pytest.raises(ValueError):
        reg.register(FT.Feature("", "PRICE", ("close",), 1, None))
    with pytest.raises(ValueError):
        reg.register(FT.Feature("x", "PRICE", ("close",), 0, None))
    with pytest.raises(ValueError):
        reg.register(FT.Feature("x", "PRICE", (), 1, None))
    with pytest.raises(ValueError):
        FT._sma_spread(5, 5)
    assert [f.group for f in reg.select(groups=["volume"])] == ["VOLUME"] * 6


def test_missing_policies(bars):
    df = FT.compute_features(bars([100 + i for i in range(25)]), ["return_5d"])
    assert FT.apply_nan_policy(df, ["return_5d"], "keep").count() == 25
    assert FT.apply_nan_policy(df, ["return_5d"], "drop").count() == 20
    with pytest.raises(ValueError):
        FT.apply_nan_policy(df, ["return_5d"], "error")


def _walk(n, seed=3):
    out, x = [], 100.0
    for i in range(n):
        x *= 1 + ((i * 7919 + seed * 104729) % 1000 - 500) / 20000
        out.append(x)
    return out


def test_future_does_not_change_the_past(bars):
    base = bars(_walk(90), highs=[c * 1.01 for c in _walk(90)], lows=[c * .99 for c in _walk(90)])
    cut = base.orderBy("timestamp").limit(70).agg(F.max("timestamp")).first()[0]
    late = F.col("timestamp") > F.lit(cut)
    bent = base.withColumns({c: F.when(late, F.col(c) * k).otherwise(F.col(c)) for c, k in
                             {"open": 5, "high": 10, "low": .1, "close": 8, "volume": 100}.items()})
    a, b = FT.compute_features(base).filter(~late), FT.compute_features(bent).filter(~late)
    assert a.exceptAll(b).count() == 0


def test_symbols_do_not_mix(bars):
    one, two = bars(_walk(70), "AAA"), bars(_walk(70, 9), "BBB")
    both = FT.compute_features(one.unionByName(two))
    assert both.filter("symbol = 'AAA'").exceptAll(FT.compute_features(one)).count() == 0


@pytest.mark.parametrize("rows", [70, 100])
def test_chunked_windows_equal_plain_ones(bars, rows):
    """One long series cut into small chunks gives the features and targets of one window."""
    df = bars(_walk(500), highs=[c * 1.02 for c in _walk(500)], lows=[c * .97 for c in _walk(500)],
              volumes=[100 + i % 13 for i in range(500)])
    def r(x):
        return x.select("timestamp", "symbol", *[F.round(c, 9).alias(c) for c in x.columns[2:]])
    plain, cut = FT.compute_features(df), FT.compute_features(df, grain="hour", rows=rows)
    assert cut.count() == 500 and r(plain).exceptAll(r(cut)).count() == 0
    plain = TG.compute_targets(df, keep_bars=False)
    cut = TG.compute_targets(df, keep_bars=False, grain="hour", rows=rows)
    assert cut.count() == 500 and r(plain).exceptAll(r(cut)).count() == 0
    assert CHUNK_ROWS > 61


def test_forward_returns_and_labels(bars, column):
    T = TG.Target
    df = TG.compute_targets(bars([100, 110, 121, 108.9]), targets=[T("h1", "forward_return", 1), T("h2", "forward_return", 2)])
    near(column(df, "h1"), [.10, .10, -.10, None])
    near(column(df, "h2"), [.21, -.01, None, None])
    df = TG.compute_targets(bars([100, 105, 95, 110]), targets=[T("up", "binary", 1, 0.0), T("up10", "binary", 1, .10)])
    near(column(df, "up"), [1, 0, 1, None])
    near(column(df, "up10"), [0, 0, 1, None])


def test_forward_volatility(bars, column):
    df = TG.compute_targets(bars([100, 102, 101, 105, 104]), targets=[TG.Target("v", "forward_volatility", 2)])
    got = column(df, "v")
    near(got[:1], [statistics.stdev([.02, -1 / 102]) * math.sqrt(252)])
    assert got[-2:] == [None, None]
    with pytest.raises(ValueError):
        TG.Target("v", "forward_volatility", 1)


def test_target_registry():
    assert len(TG.REGISTRY.select()) == 18
    assert TG.resolve_target("binary_up", 5) == "target_binary_up_5d"
    assert TG.default_registry().register(TG.Target("mine", "binary", 2)).threshold == 0.0


def test_alignment_keeps_only_complete_rows(spark):
    df = spark.createDataFrame([(i, "A", x, y) for i, (x, y) in enumerate(
        [(None, .1), (None, .2), (3.0, .3), (4.0, None), (5.0, None)])],
        "timestamp int, symbol string, feature_warmup double, target_trailing double")
    ds = ModelingDataset.infer(df)
    assert (ds.features, ds.targets) == (("feature_warmup",), ("target_trailing",))
    assert [tuple(r)[2:] for r in ds.modeling_rows("target_trailing").collect()] == [(3.0, .3)]
    assert [r.row_position for r in ds.valid_rows("target_trailing").collect()] == [2]


def test_roles_are_disjoint_and_present(spark):
    df = spark.createDataFrame([(1, "A", 1.0)], "timestamp int, symbol string, a double")
    with pytest.raises(ValueError):
        ModelingDataset(df, ("a",), ("a",))
    with pytest.raises(ValueError):
        ModelingDataset(df, ("b",), ())


def test_roles_survive_parquet(bars, spark, tmp_path):
    ds = ModelingDataset.infer(label_dataset(bars(_walk(40)), ["return_1d"], ["target_fwd_ret_1d"]))
    ds.save(str(tmp_path / "d"))
    back = ModelingDataset.load(spark, str(tmp_path / "d"))
    assert (back.features, back.targets) == (("return_1d",), ("target_fwd_ret_1d",))


def test_labelled_features_share_one_symbol_exchange(spark):
    from barloom.plans.core import Tables
    plan = label_dataset(Tables(spark, "/root/testdata/sf0.001").bars_s)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 2  # bars, then symbol
    assert "ReadSchema: struct<l_orderkey:bigint,l_partkey:bigint,l_suppkey:bigint,l_linenumber:int,l_quantity" in plan
    assert "l_tax" not in plan and "Python" not in plan


@pytest.mark.parametrize("name", ["label_dataset", "feature_matrix", "target_matrix"])
def test_ticks_move_once_in_the_queries_of_all_suppliers(spark, name):
    from __spark_entry__ import queries
    plan = queries()[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "REPARTITION_BY_NUM" in plan


@pytest.mark.parametrize("hot_ticks, task_ticks", [(1 << 18, 1 << 19), (60, 100), (0, 1 << 19)])
def test_series_equal_bars(spark, hot_ticks, task_ticks):
    from barloom.sources.bars import named, resample_bars, resample_series
    # Symbol 0 and the missing one have 200 ticks, symbols 1 to 20 have 10; some prices and volumes are missing.
    ticks = spark.range(0, 600, 1, 3).select(
        F.expr("case when id < 200 then 0L when id < 400 then null else 1 + id % 20 end").alias("sym"),
        F.expr("timestamp_ntz '2024-01-01 00:00:00' + make_interval(0, 0, 0, cast(id * 7 % 40 as int), cast(id % 24 as int))").alias("ts"),
        F.expr("if(id % 11 = 0, null, 100 + id * 37 % 101 / 7.0)").alias("p"), F.expr("if(id % 13 = 0, null, cast(id % 5 as double))").alias("v"),
        F.expr("id * 7919 % 600").alias("seq"))
    args = (ticks, F.col("sym"), F.col("ts"), F.col("p"), F.col("v"), F.col("seq"))
    bars, parts = resample_series(*args, hot_ticks=hot_ticks, task_ticks=task_ticks)
    assert parts == (6 if task_ticks == 100 else 4)
    assert sorted(map(str, named(bars, "S").collect())) == sorted(map(str, resample_bars(*args, prefix="S").collect()))
    places = bars.select("symbol", F.spark_partition_id().alias("part")).distinct().groupBy("symbol").count().collect()
    assert len(places) == 22 and all(r["count"] == 1 for r in places)
    plan = FT.compute_features(bars, ["return_1d"], parts=parts)._jdf.queryExecution().executedPlan().toString()
    # Hot symbols: their bars, once more by symbol, and the counts for either side.
    assert plan.count("Exchange hashpartitioning") == (1 if hot_ticks == 1 << 18 else 5)


def test_candles(bars, column):
    closes = _walk(900)
    df = candles(bars(closes), digits=None)
    ema = closes[0]
    want = [ema]
    for c in closes[1:]:
        ema += (c - ema) * 2 / 21
        want.append(ema)
    near(column(df, "ema_20"), want, 1e-9)
    assert column(df, "rsi_14")[:14] == [50.0] * 14
    near(column(df, "sma_20")[:2], [closes[0], (closes[0] + closes[1]) / 2])


@pytest.mark.parametrize("span", [1, 2, 20, 200])
def test_ema_is_exact_over_many_blocks(bars, column, span):
    from barloom.functions.indicators import with_ema

    closes = [100 + (i * 37 % 101) / 7 for i in range(1500)]
    got = column(with_ema(bars(closes).withColumn("n", F.row_number().over(Window.partitionBy("symbol").orderBy("timestamp"))), "close", {"e": span}), "e")
    value, alpha = closes[0], 2 / (span + 1)
    for c, g in zip(closes, got, strict=True):
        value = value if c is closes[0] else alpha * c + (1 - alpha) * value
        assert abs(g - value) < 1e-9


def test_long_frames_are_put_together_from_frames_of_ten(spark):
    """The same values as plain frames, missing ones and long flat stretches included; no frame over 21 bars in the plan."""
    rng = random.Random(3)
    rows = [(datetime(2024, 1, 1) + timedelta(days=i), s, None if rng.random() < 0.1 or (s == "B" and 20 < i < 45) else
             0.1 if s == "C" else rng.uniform(-1, 1) * 10 ** rng.randint(0, 6)) for s in "ABC" for i in range(150)]
    df = spark.createDataFrame(rows, "timestamp timestamp_ntz, symbol string, x double")
    frame = open_frame(df, 61)
    b = FT.Builder(frame)
    got = {f"{kind}_{k}": b.roll(kind, "x", k, 2 if kind == "std" else 1) for kind in ("avg", "std", "max", "min") for k in (10, 20, 50, 60)}
    w = Window.partitionBy("symbol").orderBy("timestamp")
    aggs = {"avg": F.avg, "std": F.stddev_samp, "max": F.max, "min": F.min}
    want = {f"w_{n}": F.when(F.col("n") >= int(n[4:]), aggs[n[:3]]("x").over(w.rowsBetween(1 - int(n[4:]), 0))) for n in got}
    both = b.apply(frame.df).select("symbol", "timestamp", "n", "x", *[c.alias(n) for n, c in got.items()]).withColumns(want).collect()
    for r in both:
        for n in got:
            assert (r[n] is None) == (r["w_" + n] is None)
            assert r[n] is None or r[n] == pytest.approx(r["w_" + n], rel=1e-9, abs=1e-12)
            assert r.symbol != "C" or n[:3] != "std" or not r[n]
    plan = FT.compute_features(df.select("timestamp", "symbol", *[F.col("x").alias(c) for c in ("open", "high", "low", "close", "volume")]))
    frames = re.findall(r"RowFrame, -(\d+), currentrow", plan._jdf.queryExecution().executedPlan().toString())
    assert frames and max(map(int, frames)) == 20
    assert int(spark.conf.get("spark.sql.codegen.hugeMethodLimit")) <= 8000
