"""Radix selection against `percentile` and against the bits of doubles."""

import struct

import pytest
from pyspark.sql import functions as F

from barloom.operators import metrics as M
from barloom.operators import splits as S
from barloom.operators.order_stats import exact_median, exact_medians, exact_quantiles, ordered_bits

EXTREME = [0.0, -0.0, 5e-324, -5e-324, 2.2250738585072014e-308, 2.225073858507201e-308, 1.0, 0.9999999999999999, 1.0000000000000002,
           1.7976931348623157e308, -1.7976931348623157e308, float("inf"), float("-inf"), 0.1, -0.1, 2.0 ** 52, 2.0 ** 53 - 1, 8.0, 7.999999999999999]


def test_ordered_bits(spark):
    df = ordered_bits(spark.createDataFrame([(v,) for v in EXTREME], "v double"), "v", "b")
    for row in df.collect():
        bits = struct.unpack("<q", struct.pack("<d", abs(row.v)))[0]
        assert row.b == (-bits if row.v < 0 else bits), row.v


def skewed(spark):
    """One key with 90 % of the rows, negative values, ties and crowded values, a null key, nulls and NaN."""
    noise = lambda tag, top: F.pmod(F.xxhash64("id", F.lit(tag)), F.lit(top))
    return spark.range(30_000).select(
        F.when(noise("k", 10) > 0, "big").when(noise("j", 3) > 0, "small").alias("k"),
        F.when(noise("n", 7) > 0, (noise("v", 1_000_003) - 500_000) / 977).alias("v"),
        F.when(noise("m", 50) > 0, 100 + noise("w", 40) / 1e9).otherwise(float("nan")).alias("w"))


def test_equal_to_percentile(spark):
    df = skewed(spark).persist()
    shares = [0.0, 0.05, 0.5, 0.731, 1.0]
    mine = {(r.k, r["name"], r.share): r.value for r in exact_quantiles(df, ["k"], ["v", "w"], shares).collect()}
    theirs = df.groupBy("k").agg(*[F.percentile(F.when(~F.isnan(c), F.col(c)), F.array(*map(F.lit, shares))).alias(c) for c in ("v", "w")])
    want = {(r.k, c, s): r[c][i] for r in theirs.collect() for c in ("v", "w") for i, s in enumerate(shares)}
    assert mine == want and len(mine) == 30
    df.unpersist()


def test_no_group_in_one_task(spark):
    """The only window is over the buckets of a round, not over rows."""
    plan = exact_medians(skewed(spark), ["k"], ["v"])._jdf.queryExecution().toString()
    assert "percentile" not in plan and "Window" not in plan.split("== Physical Plan ==")[-1]


def test_empty_and_single(spark):
    df = skewed(spark)
    assert exact_quantiles(df.filter("v IS NULL"), ["k"], ["v"]).count() == 0
    assert exact_median(df.filter("v > 1e9"), "v") is None
    assert exact_median(spark.createDataFrame([(3.5,), (None,), (float("nan"),)], "v double"), "v") == 3.5
    assert exact_median(spark.createDataFrame([(float("inf"),), (float("inf"),)], "v double"), "v") == float("inf")
    with pytest.raises(ValueError):
        exact_quantiles(df, ["k"], ["v"], [1.5])


def test_grains_agree(spark):
    df = skewed(spark).withColumn("w", F.nanvl("w", F.lit(None).cast("double")))
    at = F.timestamp_seconds(F.monotonically_increasing_id() % 20_000 * 3600 + F.lit(1_600_000_000)).cast("timestamp_ntz")
    rows = df.dropna(subset=["k"]).select(F.col("k").alias("symbol"), at.alias("timestamp"), "v", "w").dropDuplicates(
        ["symbol", "timestamp"]).withColumns({"fold_idx": F.lit(1), "part": F.when(F.hour("timestamp") < 12, "train").otherwise("test")})
    rows = rows.persist()
    for make in (lambda g: S.fold_medians(rows, ["v", "w"], g), lambda g: S.wf_impute(rows, ["v", "w"], g),
                 lambda g: M.mean_median(rows, ["symbol"], "v", g).select("symbol", "median"),
                 lambda g: S.split_by_date(rows.select("symbol", "timestamp"), "2021-06-01", "2022-01-01", gap=4, grain=g)):
        assert sorted(map(tuple, make("day").collect())) == sorted(map(tuple, make("hour").collect()))
    rows.unpersist()
