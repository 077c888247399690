"""Exact quantiles of many groups of any size, by radix selection.

`percentile` gathers all values of a group in one task. Here a value is taken as the
integer of its bits, which sorts as the value does, and sought 16 bits at a time: a
round counts the rows of every bucket (combined before the shuffle), a running sum
over at most 65 536 buckets finds the one holding the wanted rank, and only its rows
go on. Four rounds serve all groups, columns and shares at once; no rows of a group
ever meet in one task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from barloom.panel import cut

DIGIT = 16
TOP = 1.7976931348623157e308
_UNIT = float(1 << 52)


def ordered_bits(df: DataFrame, column: str, out: str) -> DataFrame:
    """Adds the bits of a double as a signed integer of the same order; -0.0 and 0.0 share 0.

    Exponent and fraction come from exact divisions by powers of two. NaN has no place.
    """
    size = F.abs(F.col(column))
    # A rounded logarithm may miss the exponent by one on either side.
    near = df.withColumn("_e", F.greatest(F.lit(-1022), F.least(F.lit(1023), F.floor(F.log2(F.greatest(
        F.least(size, F.lit(TOP)), F.lit(5e-324)))).cast("int"))))
    power = F.pow(F.lit(2.0), F.col("_e"))
    near = near.withColumn("_e", F.when((power > size) & (F.col("_e") > -1022), F.col("_e") - 1)
                           .when((size / power >= 2) & (F.col("_e") < 1023), F.col("_e") + 1).otherwise(F.col("_e")))
    fraction = ((size / F.pow(F.lit(2.0), F.col("_e")) - 1) * _UNIT).cast("long")
    bits = F.when(size > TOP, F.lit(2047 << 52)).otherwise((F.col("_e") + 1023) * F.lit(1 << 52) + fraction)
    return near.withColumn(out, F.when(F.col(column) < 0, -bits).otherwise(bits)).drop("_e")


def exact_quantiles(df: DataFrame, keys: Sequence[str], columns: Sequence[str], shares: Sequence[float] = (0.5,)) -> DataFrame:
    """(keys, name, share, value): linearly interpolated quantiles, equal to `percentile` to the last bit.

    Nulls and NaN are left out; a group without a value in a column has no row for it.
    Null keys are a group of their own.
    """
    if any(not 0 <= s <= 1 for s in shares):
        raise ValueError("shares must lie between 0 and 1")
    group = F.struct(*[F.col(k) for k in keys], F.col("_name"))
    named = F.explode(F.array(*[F.struct(F.lit(c).alias("_name"), F.col(c).cast("double").alias("_v")) for c in columns]))
    long = df.select(*keys, named.alias("_x")).select(*keys, "_x._name", (F.col("_x._v") + 0.0).alias("_v"))
    long = long.select(group.alias("_k"), "_v").filter(F.col("_v").isNotNull() & ~F.isnan("_v"))
    rows = ordered_bits(long, "_v", "_b")

    place = (F.col("_n") - 1) * F.col("_share")
    wanted = cut(rows.groupBy("_k").agg(F.count(F.lit(1)).alias("_n")).withColumn(
        "_share", F.explode(F.array(*[F.lit(float(s)) for s in shares]))).select(
        "_k", "_share", place.alias("_at"), F.floor(place).alias("_lo"), F.ceil(place).alias("_hi")))
    # A search: the rank it began with, the bucket it is in and the rank inside that bucket.
    search = wanted.select("_k", F.explode(F.array_distinct(F.array("_lo", "_hi"))).alias("_goal")).distinct().select(
        "_k", "_goal", F.lit(0).cast("long").alias("_in"), F.col("_goal").alias("_rank"))
    for shift in range(64 - DIGIT, -1, -DIGIT):
        first, last = shift == 64 - DIGIT, shift == 0
        counts = rows.groupBy("_k", F.shiftright("_b", shift).alias("_d")).agg(
            F.count(F.lit(1)).alias("_c"), F.min("_v").alias("_value"))
        counts = counts.withColumn("_in", F.lit(0).cast("long") if first else F.shiftright("_d", DIGIT))
        upto = F.sum("_c").over(Window.partitionBy("_k", "_in").orderBy("_d"))
        met = search.join(counts.withColumn("_upto", upto), ["_k", "_in"]).filter(
            (F.col("_rank") < F.col("_upto")) & (F.col("_rank") >= F.col("_upto") - F.col("_c")))
        search = cut(met.select("_k", "_goal", F.col("_d").alias("_in"),
                                (F.col("_rank") - F.col("_upto") + F.col("_c")).alias("_rank"), "_value"))
        if not last:
            buckets = search.select("_k", F.col("_in").alias("_d")).distinct()
            rows = cut(rows.withColumn("_d", F.shiftright("_b", shift)).join(buckets, ["_k", "_d"], "left_semi").select("_k", "_v", "_b"))
            search = search.drop("_value")

    ends = wanted.join(search, "_k").groupBy("_k", "_share", "_at", "_lo", "_hi").agg(
        F.max(F.when(F.col("_goal") == F.col("_lo"), F.col("_value"))).alias("_a"),
        F.max(F.when(F.col("_goal") == F.col("_hi"), F.col("_value"))).alias("_z"))
    value = F.when(F.col("_a") == F.col("_z"), F.col("_a")).otherwise(
        (F.col("_hi") - F.col("_at")) * F.col("_a") + (F.col("_at") - F.col("_lo")) * F.col("_z"))
    return ends.select(*[F.col(f"_k.{k}").alias(k) for k in keys], F.col("_k._name").alias("name"),
                       F.col("_share").alias("share"), value.alias("value"))


def exact_medians(df: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """(keys, <column>_median …) of groups of any size; groups without any value have no row."""
    long = exact_quantiles(df, keys, columns)
    return long.groupBy(*keys).agg(*[
        F.max(F.when(F.col("name") == c, F.col("value"))).alias(f"{c}_median") for c in columns])


def exact_median(df: DataFrame, column: str) -> float | None:
    """Exact median of a column of any length; None without values."""
    row = exact_quantiles(df, [], [column]).select("value").first()
    return None if row is None else row["value"]
