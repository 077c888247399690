"""First passage: from a row of a series on, the first row whose values reach a bound.

The series is a tree of nodes. A node of the lowest level holds `WIDTH` rows, one of a higher level the
extremes of `WIDTH` nodes below, so a series of n rows has about log(n) / log(WIDTH) levels. A search looks through the
rest of its own node, then, level by level, through the rest of the node above, until a child can hold
a hit; from there it goes down again. Each step is an equi-join of the searches with one node, at any distance.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barloom.panel import cut

WIDTH = 64


@dataclass(frozen=True)
class PassageIndex:
    """Nodes of each level: (key, node, children); a child has `idx`, `last` (its last row), the extremes and, at the bottom, `row`."""

    levels: list[DataFrame]
    key: str
    width: int


def passage_index(series: DataFrame, lows: list[str], highs: list[str], payload: list[str], key: str = "symbol", index: str = "n",
                  width: int = WIDTH) -> PassageIndex:
    """Tree over `series`, whose rows are numbered 1.. per key by `index`.

    Searches may test the least value of `lows` and the greatest of `highs`; they return `payload`. A missing value reaches no bound.
    """
    def grouped(rows, extra):
        child = F.struct("idx", "last", *lows, *highs, *extra)
        return cut(rows.groupBy(key, F.floor(F.col("idx") / width).cast("bigint").alias("node")).agg(
            F.sort_array(F.collect_list(child)).alias("children"), F.max("last").alias("last"),
            *[F.min(c).alias(c) for c in lows], *[F.max(c).alias(c) for c in highs]))

    if width < 2:
        raise ValueError("a node holds two children at least")
    # A column that is tested both ways needs two names.
    if set(lows) & set(highs):
        raise ValueError("give a column that is tested both ways once under each of two names")
    bottom = series.select(key, (F.col(index) - 1).cast("bigint").alias("idx"), F.col(index).cast("bigint").alias("last"), *lows, *highs,
                           F.struct(*payload).alias("row"))
    levels = [grouped(bottom, ["row"])]
    while (levels[-1].agg(F.max("node")).first()[0] or 0) > 0:
        levels.append(grouped(levels[-1].select(key, F.col("node").alias("idx"), "last", *lows, *highs), []))
    return PassageIndex(levels, key, width)


def first_passage(searches: DataFrame, index: PassageIndex, start: Column, hit: Callable[[Column], Column], out: str) -> DataFrame:
    """Adds `out`: the payload of the first row at or behind `start` that hits, null if there is none.

    `hit(child)` is a condition on the columns of a search and the child's extremes and `last`. It must be monotone: true for
    a node exactly if it is true for one of its rows.
    """
    key, width = index.key, index.width
    # Searches that are not asked in a step carry a node number that no node has, many different ones, so they do not meet in one task.
    nowhere = -1 - F.pmod(F.xxhash64(key, "_idx"), F.lit(1_000_003))

    def step(df, level, node):
        nodes = index.levels[level].select(key, F.col("node").alias("_node"), F.col("children").alias("_children"))
        return df.withColumn("_node", node).join(nodes, [key, "_node"], "left")

    df = searches.withColumns({"_idx": (start - 1).cast("bigint"), "_level": F.lit(None).cast("int"), "_found": F.lit(None).cast("bigint"), out: F.lit(None)})
    top = len(index.levels)
    for level in range(top):
        df = step(df, level, F.when(F.col("_found").isNull(), F.floor(F.col("_idx") / width)).otherwise(nowhere))
        df = df.withColumn("_first", F.get(F.filter("_children", lambda c: (c["idx"] >= F.col("_idx")) & hit(c)), F.lit(0))).drop("_children")
        new = F.col("_found").isNull() & F.col("_first").isNotNull()
        values = {"_level": F.when(new, level).otherwise(F.col("_level")), "_found": F.coalesce("_found", F.col("_first.idx")),
                  "_idx": F.when(F.col("_found").isNull() & ~new, F.col("_node") + 1).otherwise(F.col("_idx"))}
        df = df.withColumns(values | ({out: F.col("_first.row")} if level == 0 else {}))
        df = cut(df) if level % 2 else df                # keeps the plan short, whatever the number of levels
    for level in range(top - 1, 0, -1):
        down = F.coalesce(F.col("_level") >= level, F.lit(False))
        df = step(df, level - 1, F.when(down, F.col("_found")).otherwise(nowhere))
        df = df.withColumn("_first", F.get(F.filter("_children", hit), F.lit(0))).drop("_children")
        values = {"_found": F.when(down, F.col("_first.idx")).otherwise(F.col("_found"))}
        df = df.withColumns(values | ({out: F.coalesce(out, F.col("_first.row"))} if level == 1 else {}))
        df = cut(df) if level % 2 == 0 else df
    return df.drop("_idx", "_level", "_found", "_node", "_first")
