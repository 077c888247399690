"""Shards that all have the mixture of the whole: proportional stratified interleaving.

Rows are shuffled by a seeded hash inside their source; rank r of n gets the fraction
(2r - 1) / 2n. Sorted by fraction the sources are spread evenly over the whole
order, and cutting that order into equal pieces gives every shard its share of every source.

No sort meets a source or the table as a whole: ranks are counted per block (of the
hash, then of the fraction), blocks are summed up, and rows are sorted inside a block.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from barloom.llm.common import text_of

HASH_DIGITS = 3          # 4096 blocks of each source
FRACTION_BLOCKS = 4096
OVERHEAD = 16            # bytes that a row takes besides its text


def _ranked(rows: DataFrame, keys: list[str], block: Column, order: list, rank: str, total: str) -> DataFrame:
    """Adds the rank of a row among those of equal keys, from 0, and how many they are."""
    blocked = rows.withColumn("_b", block)
    upto = Window.partitionBy(*keys).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*keys)
    counts = blocked.groupBy(*keys, "_b").agg(F.count(F.lit(1)).alias("_n")).select(
        *[F.col(k).alias(f"_k_{k}") for k in keys], F.col("_b").alias("_k_b"), F.coalesce(F.sum("_n").over(upto), F.lit(0)).alias("_before"),
        F.sum("_n").over(whole).alias(total))
    same = F.col("_b") == F.col("_k_b")
    for k in keys:
        same &= F.col(k).eqNullSafe(F.col(f"_k_{k}"))
    inside = Window.partitionBy(*keys, "_b").orderBy(*order)
    return (blocked.withColumn("_r", F.row_number().over(inside)).join(counts, same)
            .withColumn(rank, F.col("_before") + F.col("_r") - 1).drop("_b", "_k_b", "_r", "_before", *[f"_k_{k}" for k in keys]))


def interleaved_shards(docs: DataFrame, shards: int = 40, seed: int = 0, source: str = "source") -> DataFrame:
    """(doc_id, source, size, text_crc32, shard, slot): the shards' row counts differ by one at most.

    `size` is the text's UTF-8 bytes plus `OVERHEAD`; a null text has no bytes, a null source
    is a source. Repeated rows are rows of their own; which of two equal rows goes where cannot
    be told from the result. With fewer rows than shards some shards are empty.
    """
    key = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(source).cast("string").alias("source"),
                       (F.octet_length(text_of()) + OVERHEAD).cast("long").alias("size"), F.crc32(text_of().cast("binary")).alias("text_crc32"), key.alias("_key"))
    ties = ["_key", "doc_id", "text_crc32", "size"]
    own = _ranked(rows, ["source"], F.conv(F.substring("_key", 1, HASH_DIGITS), 16, 10).cast("int"), ties, "_rank", "_of")
    own = own.withColumn("_f", (2 * F.col("_rank") + 1) / (2 * F.col("_of")))
    placed = _ranked(own, [], F.floor(F.col("_f") * FRACTION_BLOCKS).cast("int"), ["_f", *ties], "_at", "_rows")
    shard = F.expr(f"_at * {shards} div _rows")
    return (placed.withColumn("shard", shard.cast("int"))
            .withColumn("slot", F.col("_at") - F.expr(f"(shard * _rows + {shards - 1}) div {shards}"))
            .select("doc_id", "source", "size", "text_crc32", "shard", "slot"))
