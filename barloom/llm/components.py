"""Connected components of an edge table."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.llm.common import Scratch, unburdened

HELD = 1 << 17   # nodes that a task joins up at once


def _contracted(pairs: DataFrame) -> DataFrame:
    """Edges (a, b) of the same components: what a task reads is joined up, each node stands before the least one it is joined with there."""
    def contract(batches):
        parent = {}

        def find(x):
            parent.setdefault(x, x)
            while parent[x] != x:
                parent[x] = x = parent[parent[x]]
            return x

        def edges():
            found = [(x, root) for x in parent if (root := find(x)) != x]
            parent.clear()
            return pa.RecordBatch.from_arrays([pa.array([e[i] for e in found], pa.int64()) for i in (0, 1)], ["a", "b"])

        for batch in batches:
            for x, y in zip(*[column.to_pylist() for column in batch.columns], strict=True):
                x, y = find(x), find(y)
                if x != y:
                    parent[max(x, y)] = min(x, y)
            if len(parent) > HELD:
                yield edges()
        if parent:
            yield edges()

    return pairs.select("a", "b").mapInArrow(unburdened(contract), "a long, b long")


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of (a, b) edges; `root` is the least node of its component.

    Alternates two star steps until nothing changes: every node hands its larger
    neighbours, then its smaller ones, to the least node it knows; before each turn tasks
    join up what they read, which saves turns. Edges never grow in number. Each step is a
    minimum by node and a join; a turn is written to the shared folder, and the one
    before goes with its shuffle files.
    """
    scratch, turn, state = Scratch(edges.sparkSession, "components"), 0, None
    written = scratch.write(_contracted(edges), "pairs-0")
    while True:
        pairs = _contracted(written)
        # The larger node stands in `a`, so a node knows none smaller than itself but those it stands before.
        least = pairs.groupBy(F.col("a").alias("b")).agg(F.min("b").alias("m"))
        large = pairs.join(least, "b", "left").select("a", F.coalesce("m", "b").alias("b"))
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        handed = large.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b")
        written = scratch.write(handed.union(least), f"pairs-{turn + 1}")
        scratch.drop(f"pairs-{turn}")
        turn += 1
        now = written.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b") % 1_000_000_007)).first()
        if now == state:
            break
        state = now
    return written.select(F.col("a").alias("node"), F.col("b").alias("root")).union(
        written.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
