"""Backward-looking bar features as window columns.

A feature is a function of a `Builder`. The builder hands out columns and keeps
the helper columns they need (lags, then per-row values, then rolling frames);
`compute_features` puts the helpers into stages over one window, so all
features of all symbols share one exchange and one sort. A sliding frame costs its
length per row, so frames of whole tens are put together from frames of ten.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barloom.panel import CHUNK_ROWS, DAILY, Frame, open_frame
from barloom.schema import require_columns

EPS = 1e-8
PERIODS_PER_YEAR = 252
BLOCK = 10   # bars of the frames that longer ones are put together from


class Builder:
    """Collects the helper columns of the requested features."""

    def __init__(self, frame: Frame):
        self.frame = frame
        self.lags: dict[str, Column] = {}
        self.values: dict[str, Column] = {}
        self.rolls: dict[str, Column] = {}
        self.earlier: dict[str, Column] = {}
        self.joined: dict[str, Column] = {}

    def lag(self, column: str, k: int) -> Column:
        if k < 1:
            raise ValueError("period must be at least 1")
        name = f"_lag_{column}_{k}"
        self.lags[name] = F.lag(column, k).over(self.frame.window)
        return F.col(name)

    def change(self, column: str, k: int) -> Column:
        """Relative change against k bars ago, missing unless the base is positive."""
        base = self.lag(column, k)
        return F.when(base > 0, (F.col(column) - base) / base)

    def bar_return(self) -> Column:
        self.values["_r1"] = self.change("close", 1)
        return F.col("_r1")

    def true_range(self) -> Column:
        prev = self.lag("close", 1)
        high, low = F.col("high"), F.col("low")
        self.values["_tr"] = F.greatest(high - low, F.abs(high - prev), F.abs(low - prev))
        return F.col("_tr")

    def roll(self, kind: str, column: str, k: int, minimum: int = 1) -> Column:
        """Rolling aggregate over the last k bars, missing before the k-th bar."""
        if k < minimum:
            raise ValueError(f"period must be at least {minimum}")
        name = f"_{kind}_{column}_{k}"
        if k % BLOCK == 0:
            self.joined[name] = F.when(F.col("n") >= k, self._join(kind, column, k))
            return F.col(name)
        agg = {"avg": F.avg, "std": F.stddev_samp, "max": F.max, "min": F.min}[kind]
        self.rolls[name] = F.when(F.col("n") >= k,
                                  agg(column).over(self.frame.rows(-(k - 1), 0)))
        return F.col(name)

    def _blocks(self, kind: str, column: str, k: int) -> list[Column]:
        """The aggregate over the last ten bars, the ten before them and so on, k bars in all."""
        name, frame = f"_{kind}_{column}_block", self.frame.rows(-(BLOCK - 1), 0)
        agg = {"sum": F.sum, "count": F.count, "max": F.max, "min": F.min, "var": F.var_pop}[kind]
        self.rolls[name] = agg(column).over(frame)
        for back in range(BLOCK, k, BLOCK):
            self.earlier[f"{name}_{back}"] = F.lag(name, back).over(self.frame.window)
        return [F.col(name), *[F.col(f"{name}_{back}") for back in range(BLOCK, k, BLOCK)]]

    def _join(self, kind: str, column: str, k: int) -> Column:
        """The aggregate over k bars; missing values take no part, as in the plain aggregates."""
        if kind in ("max", "min"):
            blocks = self._blocks(kind, column, k)
            return (F.greatest if kind == "max" else F.least)(*blocks) if len(blocks) > 1 else blocks[0]
        sums, counts = self._blocks("sum", column, k), self._blocks("count", column, k)
        n = sum(counts[1:], counts[0])
        if kind == "avg":
            total = sums[0] if len(sums) == 1 else sum((F.coalesce(s, F.lit(0.0)) for s in sums), F.lit(0.0))
            return F.when(n > 0, total / n)
        # Deviations from the blocks' means are added; equal values give 0 exactly.
        means = [F.when(c > 0, s / c) for s, c in zip(sums, counts)]
        pivot = F.coalesce(*means)
        shifts = [F.coalesce(m - pivot, F.lit(0.0)) for m in means]
        shift = sum((c * d for c, d in zip(counts, shifts)), F.lit(0.0)) / n
        square = sum((c * (F.coalesce(v, F.lit(0.0)) + (d - shift) * (d - shift))
                      for c, v, d in zip(counts, self._blocks("var", column, k), shifts)), F.lit(0.0))
        return F.when(n > 1, F.sqrt(square / (n - 1)))

    def apply(self, df: DataFrame) -> DataFrame:
        for stage in (self.lags, self.values, self.rolls, self.earlier, self.joined):
            if stage:
                df = df.withColumns(stage)
        return df


@dataclass(frozen=True)
class Feature:
    name: str
    group: str
    requires: tuple[str, ...]
    lookback: int
    build: Callable[[Builder], Column]
    min_observations: int = 1
    point_in_time: bool = True
    custom: bool = False


class FeatureRegistry:
    """Features by name; duplicate or empty definitions are refused."""

    def __init__(self):
        self._items: dict[str, Feature] = {}

    def register(self, feature: Feature) -> Feature:
        if not feature.name:
            raise ValueError("feature name must not be empty")
        if feature.name in self._items:
            raise ValueError(f"feature {feature.name} is already registered")
        if feature.lookback < 1:
            raise ValueError("look-back must be at least 1")
        if not feature.requires:
            raise ValueError("a feature needs at least one source column")
        self._items[feature.name] = feature
        return feature

    def feature(self, name, group, requires, lookback):
        """Decorator form of `register` for user-defined features."""
        def wrap(build):
            self.register(Feature(name, group, tuple(requires), lookback, build,
                                  lookback + 1, custom=True))
            return build
        return wrap

    def get(self, name: str) -> Feature:
        if name not in self._items:
            raise KeyError(f"unknown feature {name}")
        return self._items[name]

    def select(self, names=None, groups=None) -> list[Feature]:
        """An explicit list wins over groups; otherwise sorted by name."""
        if names:
            return [self.get(n) for n in names]
        items = sorted(self._items.values(), key=lambda f: f.name)
        if groups:
            wanted = {g.upper() for g in groups}
            unknown = wanted - {f.group for f in items}
            if unknown:
                raise ValueError(f"unknown feature groups: {sorted(unknown)}")
            items = [f for f in items if f.group in wanted]
        return items

    def catalog(self, spark) -> DataFrame:
        rows = [(f.name, f.group, list(f.requires), f.lookback, f.min_observations,
                 f.point_in_time, f.custom) for f in self.select()]
        return spark.createDataFrame(
            rows, "name string, feature_group string, requires array<string>, lookback int, "
                  "min_observations int, point_in_time boolean, custom boolean")


def _price_to_sma(k):
    def build(b):
        sma = b.roll("avg", "close", k)
        return F.when(sma > 0, (F.col("close") - sma) / sma)
    return build


def _sma_spread(fast, slow):
    if fast >= slow:
        raise ValueError("fast period must be below the slow one")

    def build(b):
        quick, base = b.roll("avg", "close", fast), b.roll("avg", "close", slow)
        return F.when(base > 0, (quick - base) / base)
    return build


def _vol_std(k, scale=1.0):
    def build(b):
        b.bar_return()
        std = b.roll("std", "_r1", k, minimum=2)
        return std * F.lit(scale) if scale != 1.0 else std
    return build


def _atr(k, normalized=False):
    def build(b):
        b.true_range()
        atr = b.roll("avg", "_tr", k)
        return F.when(F.col("close") > 0, atr / F.col("close") * 100) if normalized else atr
    return build


def _log_return(k):
    def build(b):
        base = b.lag("close", k)
        return F.when((base > 0) & (F.col("close") > 0), F.log(F.col("close") / base))
    return build


def _volume_ratio(k):
    def build(b):
        mean = b.roll("avg", "volume", k)
        return F.when(mean > 0, F.col("volume") / mean)
    return build


def _volume_z(k):
    def build(b):
        mean, std = b.roll("avg", "volume", k), b.roll("std", "volume", k, minimum=2)
        return (F.col("volume") - mean) / (std + EPS)
    return build


def _distance(kind, column, k):
    def build(b):
        level = b.roll(kind, column, k)
        return F.when(level > 0, (F.col("close") - level) / level)
    return build


def _range_position(k):
    def build(b):
        top, bottom = b.roll("max", "high", k), b.roll("min", "low", k)
        span = top - bottom
        inside = F.least(F.lit(1.0), F.greatest(F.lit(0.0), (F.col("close") - bottom) / span))
        return F.when(span > EPS, inside).when(span.isNotNull(), F.lit(0.5))
    return build


def default_registry() -> FeatureRegistry:
    """The 43 standard features."""
    reg = FeatureRegistry()

    def add(name, group, requires, lookback, build, minimum=None):
        reg.register(Feature(name, group, requires, lookback, build, minimum or lookback))

    close, ohlc, hlc, vol = ("close",), ("high", "low", "close"), ("close", "high", "low"), ("volume",)
    for k in (1, 3, 5, 10, 21):
        add(f"return_{k}d", "PRICE", close, k, lambda b, k=k: b.change("close", k), k + 1)
    for k in (1, 5, 21):
        add(f"log_return_{k}d", "PRICE", close, k, _log_return(k), k + 1)
    for k in (5, 10, 21):
        add(f"momentum_{k}d", "MOMENTUM", close, k,
            lambda b, k=k: F.col("close") - b.lag("close", k), k + 1)
        add(f"roc_{k}d", "MOMENTUM", close, k,
            lambda b, k=k: b.change("close", k) * 100, k + 1)
    for k in (10, 20, 50):
        add(f"price_to_sma_{k}d", "MOMENTUM", close, k, _price_to_sma(k))
    add("sma_ratio_10_50", "MOMENTUM", close, 50, _sma_spread(10, 50))
    for k in (10, 20, 60):
        add(f"vol_std_{k}d", "VOLATILITY", close, k, _vol_std(k))
        add(f"realized_vol_{k}d", "VOLATILITY", close, k,
            _vol_std(k, math.sqrt(PERIODS_PER_YEAR)))
        add(f"dist_high_{k}d", "PRICE_STRUCTURE", ("close", "high"), k, _distance("max", "high", k))
        add(f"dist_low_{k}d", "PRICE_STRUCTURE", ("close", "low"), k, _distance("min", "low", k))
        add(f"range_pos_{k}d", "PRICE_STRUCTURE", hlc, k, _range_position(k))
    for k in (14, 21):
        add(f"atr_{k}d", "VOLATILITY", ohlc, k, _atr(k))
        add(f"natr_{k}d", "VOLATILITY", ohlc, k, _atr(k, normalized=True))
    for k in (1, 5):
        add(f"volume_change_{k}d", "VOLUME", vol, k, lambda b, k=k: b.change("volume", k), k + 1)
    for k in (10, 20):
        add(f"volume_to_sma_{k}d", "VOLUME", vol, k, _volume_ratio(k))
        add(f"volume_zscore_{k}d", "VOLUME", vol, k, _volume_z(k))
    return reg


REGISTRY = default_registry()


def multi_period_returns(periods) -> list[Feature]:
    """Simple returns for any list of periods."""
    return [Feature(f"return_{k}d", "PRICE", ("close",), k,
                    lambda b, k=k: b.change("close", k), k + 1) for k in periods]


def compute_features(bars: DataFrame, names=None, groups=None, *, registry=REGISTRY,
                     features: list[Feature] | None = None, grain: str = DAILY,
                     rows: int = CHUNK_ROWS, keep_bars: bool = False, parts: int | None = None) -> DataFrame:
    """Feature table keyed by (timestamp, symbol).

    Columns come out sorted by name, or in the order of an explicit list. `parts` comes with bars that lie by symbol.
    """
    chosen = features if features is not None else registry.select(names, groups)
    needed = sorted({c for f in chosen for c in f.requires} | {"timestamp", "symbol"})
    require_columns(bars, needed)
    back = max(f.lookback for f in chosen) + 1
    source = bars if keep_bars else bars.select(*needed)
    frame = open_frame(source, back, 0, grain, rows, parts=parts)
    builder = Builder(frame)
    columns = [f.build(builder).alias(f.name) for f in chosen]
    staged = frame.close(builder.apply(frame.df))
    keep = bars.columns if keep_bars else ["timestamp", "symbol"]
    return staged.select(*keep, *columns)


def apply_nan_policy(features: DataFrame, columns, policy: str = "keep") -> DataFrame:
    """keep rows with missing values, drop them, or raise when there is one."""
    if policy == "keep":
        return features
    if policy == "drop":
        return features.dropna("any", subset=list(columns))
    if policy == "error":
        any_missing = F.greatest(*[F.col(c).isNull().cast("int") for c in columns]) \
            if len(columns) > 1 else F.col(columns[0]).isNull().cast("int")
        if not features.filter(any_missing == 1).isEmpty():
            raise ValueError("feature table has missing values")
        return features
    raise ValueError(f"unknown missing-value policy {policy}")


def feature_report(features: DataFrame, columns) -> DataFrame:
    """Missing and infinite counts per feature with totals, in one pass."""
    counts = features.agg(
        F.count(F.lit(1)).alias("rows"),
        *[F.count_if(F.col(c).isNull()).alias(f"m_{c}") for c in columns],
        *[F.count_if(F.abs(F.col(c)) == float("inf")).alias(f"i_{c}") for c in columns],
    )
    entries = F.array(*[
        F.struct(F.lit(c).alias("feature"), F.col(f"m_{c}").alias("missing"),
                 F.col(f"i_{c}").alias("infinite")) for c in columns])
    return counts.select("rows", F.inline(entries))
