"""Forward-looking labels as window columns."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barloom.panel import CHUNK_ROWS, DAILY, open_frame
from barloom.schema import require_columns

PERIODS_PER_YEAR = 252
SHORTHAND = {"fwd_ret": "target_fwd_ret_{}d", "binary_up": "target_binary_up_{}d",
             "fwd_vol": "target_fwd_vol_{}d"}


@dataclass(frozen=True)
class Target:
    name: str
    kind: str  # forward_return, forward_log_return, binary or forward_volatility
    horizon: int
    threshold: float | None = None

    def __post_init__(self):
        if self.horizon < (2 if self.kind == "forward_volatility" else 1):
            raise ValueError(f"horizon {self.horizon} is too short for {self.kind}")

    @property
    def task(self) -> str:
        return "classification" if self.kind == "binary" else "regression"


class TargetRegistry:
    def __init__(self):
        self._items: dict[str, Target] = {}

    def register(self, target: Target) -> Target:
        if not target.name or target.name in self._items:
            raise ValueError(f"target name {target.name!r} is empty or taken")
        if target.kind == "binary" and target.threshold is None:
            target = Target(target.name, target.kind, target.horizon, 0.0)
        self._items[target.name] = target
        return target

    def get(self, name: str) -> Target:
        if name not in self._items:
            raise KeyError(f"unknown target {name}")
        return self._items[name]

    def select(self, names=None) -> list[Target]:
        if names:
            return [self.get(n) for n in names]
        return sorted(self._items.values(), key=lambda t: t.name)

    def catalog(self, spark) -> DataFrame:
        rows = [(t.name, t.kind, t.task, t.horizon, t.threshold) for t in self.select()]
        return spark.createDataFrame(
            rows, "name string, kind string, task string, horizon int, threshold double")


def default_registry() -> TargetRegistry:
    """The 18 standard targets."""
    reg = TargetRegistry()
    for h in (1, 3, 5, 10, 20, 21):
        reg.register(Target(f"target_fwd_ret_{h}d", "forward_return", h))
        reg.register(Target(f"target_binary_up_{h}d", "binary", h, 0.0))
    for h in (5, 10):
        reg.register(Target(f"target_binary_gt1pct_{h}d", "binary", h, 0.01))
    for h in (5, 10, 20, 21):
        reg.register(Target(f"target_fwd_vol_{h}d", "forward_volatility", h))
    return reg


REGISTRY = default_registry()


def resolve_target(name: str, horizon: int | None = None) -> str:
    """Full target name for a shorthand and a horizon."""
    if name in SHORTHAND:
        return SHORTHAND[name].format(horizon)
    return name


def _label(target: Target, frame) -> Column:
    close, ahead = F.col("close"), F.col(f"_ahead_{target.horizon}")
    simple = F.when(close > 0, (ahead - close) / close)
    if target.kind == "forward_return":
        return simple
    if target.kind == "forward_log_return":
        return F.when((close > 0) & (ahead > 0), F.log(ahead / close))
    if target.kind == "binary":
        return F.when(simple.isNotNull(), (simple > F.lit(target.threshold)).cast("double"))
    if target.kind == "forward_volatility":
        spread = F.stddev_samp("_r1").over(frame.rows(1, target.horizon))
        return F.when(ahead.isNotNull(), spread * F.lit(math.sqrt(PERIODS_PER_YEAR)))
    raise ValueError(f"unknown target kind {target.kind}")


def compute_targets(bars: DataFrame, names=None, *, registry=REGISTRY,
                    targets: list[Target] | None = None, grain: str = DAILY,
                    rows: int = CHUNK_ROWS, keep_bars: bool = True, parts: int | None = None) -> DataFrame:
    """Bars with one column per target; the last rows of a symbol stay missing."""
    chosen = targets if targets is not None else registry.select(names)
    require_columns(bars, ["timestamp", "symbol", "close"])
    source = bars if keep_bars else bars.select("timestamp", "symbol", "close")
    frame = open_frame(source, 1, max(t.horizon for t in chosen), grain, rows, parts=parts)
    prev = F.lag("close", 1).over(frame.window)
    staged = frame.df.withColumns(
        {f"_ahead_{h}": F.lead("close", h).over(frame.window)
         for h in sorted({t.horizon for t in chosen})}
        | {"_prev": prev}
    ).withColumn("_r1", F.when(F.col("_prev") != 0, (F.col("close") - F.col("_prev")) / F.col("_prev")))
    labelled = staged.withColumns({t.name: _label(t, frame) for t in chosen})
    keep = bars.columns if keep_bars else ["timestamp", "symbol"]
    return frame.close(labelled).select(*keep, *[t.name for t in chosen])


def target_report(labelled: DataFrame, columns) -> DataFrame:
    counts = labelled.agg(
        F.count(F.lit(1)).alias("rows"), F.countDistinct("symbol").alias("symbols"),
        *[F.count_if(F.col(c).isNull()).alias(f"m_{c}") for c in columns])
    entries = F.array(*[F.struct(F.lit(c).alias("target"), F.col(f"m_{c}").alias("missing"))
                        for c in columns])
    return counts.select("rows", "symbols", F.inline(entries))
