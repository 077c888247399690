"""Helpers that several operators share."""

from __future__ import annotations

import gc
import re
import uuid
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.session import checkpoint_dir

WORD = r"[^\x20\x09-\x0D]+"


# Bytes of rows that Spark hands a Python worker at once; Spark's own setting counts rows only.
BATCH_BYTES = 1 << 22
_BATCH_SETTING = "spark.sql.execution.arrow.maxBytesPerBatch"


def importable(spark: SparkSession) -> None:
    """Let Python workers on this machine import the package; a cluster gets it with --py-files.

    Bounds what a worker gets at once by bytes, unless the session has a lower bound: a batch of long texts is
    large at any number of rows. Results do not depend on it.
    """
    bound = spark.conf.get(_BATCH_SETTING)
    if re.fullmatch(r"\d+b?", bound) and int(bound.rstrip("b")) > BATCH_BYTES:
        spark.conf.set(_BATCH_SETTING, BATCH_BYTES)
    root, env = str(Path(__file__).resolve().parents[2]), spark.sparkContext.environment
    known = env.get("PYTHONPATH", "").split(":")
    if root not in known:
        env["PYTHONPATH"] = ":".join(filter(None, [*known, root]))


# For tables whose rows take megabytes. Parquet looks at the size of pages and row groups only after 100 rows, and Spark reads up to
# 4096 rows of a row group at once; so both would hold whatever an input split makes. Here a row group ends after some rows.
LARGE_ROWS = {"parquet.block.size": 1 << 23, "parquet.page.size.row.check.min": 1}

_held: dict = {}


def held(key: str, make):
    """`make()`, kept in a Python worker from task to task. A worker keeps one such thing."""
    if key not in _held:
        _held.clear()
        _held[key] = make()
    return _held[key]


def let_go() -> None:
    _held.clear()


def unburdened(step):
    """`step` of mapInArrow, for a worker that lets go what other operators' tasks left in it.

    Spark's workers live on from step to step; a tokenizer with its remembered units would stay beside all later work.
    """
    def run(batches):
        let_go()
        return step(batches)

    return run


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


class Scratch:
    """Tables of one run below the shared checkpoint folder; each goes once nothing reads it any more.

    Writing cuts the lineage: a lost executor costs a reread, not the steps before.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.home = spark, f"{checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"

    def write(self, df: DataFrame, name: str, **options) -> DataFrame:
        """Write `df` and continue from the files; `options` go to the writer."""
        df.write.options(**options).parquet(f"{self.home}/{name}")
        out = self.spark.read.schema(df.schema).parquet(f"{self.home}/{name}")
        # Shuffle files of finished steps go when the driver's garbage does; with a roomy heap that can be never.
        # A plan that is still named here would keep its own until the next step.
        del df
        gc.collect()
        self.spark.sparkContext._jvm.System.gc()
        return out

    def drop(self, *names: str) -> None:
        """Delete tables of this run; no later plan may read them."""
        for name in names:
            place = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.home}/{name}")
            place.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)


def written(df: DataFrame, name: str) -> DataFrame:
    """A single scratch table of `df` that stays."""
    return Scratch(df.sparkSession, name).write(df, "rows")


def shared_file(spark: SparkSession, name: str, content: bytes) -> str:
    """Write a small file into the shared checkpoint folder; its path, for Spark's readers."""
    path = f"{checkpoint_dir(spark).rstrip('/')}/{uuid.uuid4().hex}/{name}"
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    out = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(place)
    try:
        out.write(bytearray(content))
    finally:
        out.close()
    return path


def kept(df: DataFrame) -> DataFrame:
    """checkpoint() into the shared folder; for small tables inside loops."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint()


def text_of(name: str = "text") -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def word_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(WORD)).cast("long")


def let(value: Column, use) -> Column:
    """`use(value)` with `value` computed once per row, also inside lambdas."""
    return F.transform(F.array(value), use)[0]


def lower_bound(sorted_values: Column, length: Column, wanted, before=lambda a, b: a < b) -> Column:
    """How many leading elements stand before `wanted`: binary search in 31 steps."""
    def step(low, width):
        ahead = low + width
        return F.when((ahead <= length) & before(F.get(sorted_values, ahead - 1), wanted), ahead).otherwise(low)

    return F.aggregate(F.array(*[F.lit(1 << b) for b in range(30, -1, -1)]), F.lit(0), step)


def parts_of(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
