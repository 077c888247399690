"""Ordered windows over panels whose keys may be arbitrarily large.

A plain `Window.partitionBy("symbol")` sorts every row of a symbol in one task.
For daily bars that is safe by construction: (symbol, day) is unique, so a
symbol has at most 36 525 rows per century. For any finer grain, or for raw
rows, the series is cut into bounded blocks instead:

* `row_index`   exact per-key row numbers from per-block counts,
* `halo_chunks` equal-sized chunks with copied neighbour rows, so every
                bounded look-back or look-ahead is answered inside one chunk,
* `running`     cumulative sum / min / max / last value from block totals.

The only data that is gathered per key is one row per block.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from barloom.session import checkpoint_dir, compiled

DAILY = "day"
CHUNK_ROWS = 8192
# One century of days: the row bound of a symbol at the daily grain.
CALENDAR_ROWS = 36_525

GRAIN_SECONDS = {"1 minute": 60, "5 minutes": 300, "15 minutes": 900, "hour": 3600,
                 "day": 86400, "week": 604800}


def time_block(time: str | Column, seconds: int) -> Column:
    """Number of the fixed-width time block an instant falls into."""
    ts = F.col(time) if isinstance(time, str) else time
    return F.floor(F.unix_timestamp(ts.cast("timestamp")) / F.lit(seconds))


def grain_block(grain: str, rows: int = CHUNK_ROWS, time: str = "timestamp") -> Column:
    """Time block holding at most `rows` bars of the given grain."""
    return time_block(time, GRAIN_SECONDS[grain] * rows)


def row_index(df: DataFrame, keys: list[str], order: list[str], block: Column,
              out: str = "n") -> DataFrame:
    """Number rows 1.. per key without sorting a whole key in one task.

    `block` must grow with `order`; only one row per (key, block) meets in the
    prefix-sum window.
    """
    blocked = df.withColumn("_blk", block)
    before = Window.partitionBy(*keys).orderBy("_blk").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        blocked.groupBy(*keys, "_blk").agg(F.count(F.lit(1)).alias("_cnt"))
        .select(*keys, "_blk", F.coalesce(F.sum("_cnt").over(before), F.lit(0)).alias("_off"))
    )
    inside = Window.partitionBy(*keys, "_blk").orderBy(*order)
    return (
        blocked.withColumn("_rn", F.row_number().over(inside))
        .join(offsets, [*keys, "_blk"])
        .withColumn(out, F.col("_off") + F.col("_rn"))
        .drop("_blk", "_rn", "_off")
    )


def halo_chunks(df: DataFrame, back: int, ahead: int, rows: int = CHUNK_ROWS,
                index: str = "n") -> DataFrame:
    """Assign rows to chunks of `rows`, copying neighbours into adjacent chunks.

    Adds `_chunk` and `_own`; a row is owned by exactly one chunk. Copies per
    chunk are `back + ahead`, whatever the size of the key.
    """
    if rows < max(back, ahead, 1):
        raise ValueError("chunk must be at least as long as the look-back and look-ahead")
    pos = F.col(index) - 1
    chunk = F.floor(pos / F.lit(rows))
    inside = pos % F.lit(rows)
    homes = F.array_compact(F.array(
        chunk,
        F.when(inside >= rows - back, chunk + 1),
        F.when((inside < ahead) & (chunk > 0), chunk - 1),
    ))
    return (
        df.withColumn("_home", chunk)
        .withColumn("_chunk", F.explode(homes))
        .withColumn("_own", F.col("_chunk") == F.col("_home"))
        .drop("_home")
    )


@dataclass(frozen=True)
class Frame:
    """Rows ready for bounded windows, with the window to use and the way back."""

    df: DataFrame
    window: WindowSpec
    chunked: bool

    def rows(self, start: int, end: int) -> WindowSpec:
        return self.window.rowsBetween(start, end)

    def close(self, df: DataFrame) -> DataFrame:
        return df.filter("_own").drop("_own", "_chunk") if self.chunked else df


def open_frame(bars: DataFrame, back: int, ahead: int = 0, grain: str = DAILY,
               rows: int = CHUNK_ROWS, key: str = "symbol", time: str = "timestamp", parts: int | None = None) -> Frame:
    """Window layout for one-row-per-(key, time) data with row index `n`.

    Daily data uses one window per key (calendar bound); every finer grain is
    indexed and cut into halo chunks. Bars that lie in `parts` partitions by key
    (`resample_series`) stay where they are.
    """
    compiled(bars.sparkSession)
    if grain == DAILY:
        window = Window.partitionBy(key).orderBy(time)
        # A fixed partition count: windows widen rows many times over, so
        # coalescing by input bytes would leave too few tasks.
        parts = parts or int(bars.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        spread = bars.repartition(parts, key)
        return Frame(spread.withColumn("n", F.row_number().over(window)), window, False)
    indexed = row_index(bars, [key], [time], grain_block(grain, rows, time))
    chunks = halo_chunks(indexed, back, ahead, rows)
    return Frame(chunks, Window.partitionBy(key, "_chunk").orderBy("n"), True)


def cut(df: DataFrame) -> DataFrame:
    """Write `df` to the checkpoint folder and continue from there.

    `running` reads its input twice. Where several passes follow one another,
    cutting between them keeps the work proportional to the number of passes,
    and a lost executor costs one pass instead of the chain.
    """
    checkpoint_dir(df.sparkSession)
    return df.checkpoint()


_COMBINE = {
    "sum": (F.sum, lambda a, b: F.coalesce(a, F.lit(0)) + F.coalesce(b, F.lit(0))),
    "max": (F.max, lambda a, b: F.greatest(a, b)),
    "min": (F.min, lambda a, b: F.least(a, b)),
    "last": (None, lambda before, here: F.coalesce(here, before)),
    "prev": (None, lambda before, here: F.coalesce(here, before)),
}


def running(df: DataFrame, keys: list[str], order: list[str], block: Column,
            outputs: dict[str, tuple[str, str]]) -> DataFrame:
    """Inclusive running aggregates per key, in two levels.

    `outputs` maps a new column to (kind, source column); kinds are sum, max,
    min, last (last non-null) and prev (last non-null before this row). `order`
    must order the rows of a block totally. Level one aggregates inside
    (key, block), level two runs over one row per block.
    """
    blocked = df.withColumn("_blk", block)
    rank = F.struct(*order) if len(order) > 1 else F.col(order[0])
    totals, inside, carry = [], {}, []
    local = Window.partitionBy(*keys, "_blk").orderBy(*order).rowsBetween(
        Window.unboundedPreceding, 0)
    before = Window.partitionBy(*keys).orderBy("_blk").rowsBetween(Window.unboundedPreceding, -1)
    for name, (kind, source) in outputs.items():
        col = F.col(source)
        if kind in ("last", "prev"):
            reach = local if kind == "last" else local.rowsBetween(Window.unboundedPreceding, -1)
            totals.append(F.max_by(col, F.when(col.isNotNull(), rank)).alias(f"_t_{name}"))
            inside[f"_l_{name}"] = F.last(col, ignorenulls=True).over(reach)
            carry.append(F.last(f"_t_{name}", ignorenulls=True).over(before).alias(f"_c_{name}"))
        else:
            fn = _COMBINE[kind][0]
            totals.append(fn(col).alias(f"_t_{name}"))
            inside[f"_l_{name}"] = fn(col).over(local)
            carry.append(fn(f"_t_{name}").over(before).alias(f"_c_{name}"))
    prefix = blocked.groupBy(*keys, "_blk").agg(*totals).select(*keys, "_blk", *carry)
    joined = blocked.withColumns(inside).join(prefix, [*keys, "_blk"])
    return joined.select(
        *[F.col(c) for c in df.columns],
        *[_COMBINE[kind][1](F.col(f"_c_{name}"), F.col(f"_l_{name}")).alias(name)
          for name, (kind, _) in outputs.items()],
    )


def series_index(df: DataFrame, grain: str = DAILY, keys: Sequence[str] = ("symbol",), time: str = "timestamp",
                 rows: int = CHUNK_ROWS) -> DataFrame:
    """Adds `n`, the position of a row in its series, and `total`, its length."""
    keys = list(keys)
    if grain == DAILY:
        whole = Window.partitionBy(*keys)
        return df.withColumns({"n": F.row_number().over(whole.orderBy(time)),
                               "total": F.count(F.lit(1)).over(whole)})
    totals = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("total"))
    return row_index(df, keys, [time], grain_block(grain, rows, time)).join(totals, keys)


def cumulative(df: DataFrame, outputs: dict[str, tuple[str, str]], grain: str = DAILY,
               keys=("symbol",), time: str = "timestamp", rows: int = CHUNK_ROWS) -> DataFrame:
    """`running` over bars: one window per key at the daily grain, two levels otherwise."""
    keys = list(keys)
    if grain != DAILY:
        return running(cut(df), keys, [time], grain_block(grain, rows, time), outputs)
    past = Window.partitionBy(*keys).orderBy(time).rowsBetween(Window.unboundedPreceding, 0)
    columns = {}
    for name, (kind, source) in outputs.items():
        if kind == "last":
            columns[name] = F.last(source, ignorenulls=True).over(past)
        elif kind == "prev":
            columns[name] = F.last(source, ignorenulls=True).over(
                past.rowsBetween(Window.unboundedPreceding, -1))
        else:
            columns[name] = {"sum": F.sum, "max": F.max, "min": F.min}[kind](source).over(past)
    return df.withColumns(columns)
