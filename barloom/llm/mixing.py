"""Mixing sources to target weights by entropy balancing.

Each document gets a rate, the times it is taken. Of all rates that bring every source
to its token target the operator takes those nearest to the prior rates in relative
entropy over tokens: rate = min(cap, prior * exp(lambda of the source)). The lambdas
solve a convex dual, by Newton steps whose gradients and second derivatives Spark sums
over the documents. Rates are then rounded to copies so that each source stays at its target.

Documents of one source, prior and size are one cell; all sums run over cells.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from barloom.llm.common import kept, parts_of, text_of, word_count, written

CAP = 3.0              # copies of a document at most
TOLERANCE = 1e-9       # of a source's target
STEPS = 60
SALTS = 16
GROUP = 4096           # documents of a cell that are ranked together
_CELL = ["source", "prior", "size"]


def numbered(df: DataFrame, *order) -> DataFrame:
    """Adds `n`, the row's number from 0 in a global order, without a sort in one task."""
    ranged = kept(df.repartitionByRange(parts_of(df), *order).sortWithinPartitions(*order).withColumn("_id", F.monotonically_increasing_id()))
    part, inside = F.shiftright("_id", 33), F.col("_id").bitwiseAND(F.lit((1 << 33) - 1))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)   # one row per partition
    starts = ranged.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("_n")).select(
        "_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    return ranged.withColumn("_part", part).join(starts, "_part").withColumn("n", F.col("_start") + inside).drop("_part", "_id", "_start")


def source_targets(sources: DataFrame, weight: Column, cap: float = CAP) -> DataFrame:
    """(source, source_size, target): all tokens shared by weight, no source above `cap` times its size.

    What is above is shared again by weight: the level c in min(c * weight, cap * size)
    rises until everything is placed. Each round is one sum over the sources.
    """
    weighed = kept(sources.withColumn("_w", weight.cast("double")))
    total = weighed.agg(F.sum("source_size")).first()[0] or 0
    level = 0.0
    while True:
        full = F.lit(level) * F.col("_w") >= cap * F.col("source_size")
        held, rest = weighed.agg(F.sum(F.when(full, cap * F.col("source_size"))), F.sum(F.when(~full, F.col("_w")))).first()
        if not rest:
            break
        new = (total - (held or 0)) / rest
        if new <= level:
            break
        level = new
    return weighed.withColumn("target", F.least(F.lit(level) * F.col("_w"), cap * F.col("source_size"))).drop("_w")


def balance(cells: DataFrame, targets: DataFrame, cap: float = CAP, tolerance: float = TOLERANCE) -> DataFrame:
    """(source, source_size, target, lam): Newton's method on the dual, one sum over the cells per step.

    A step is held between -1 and 1, which keeps the method from overshooting; sources
    that can't move any more (all documents at the cap, or no tokens) stay.
    """
    state = kept(targets.withColumn("lam", F.lit(0.0)))
    for _ in range(STEPS):
        tilted = F.col("prior") * F.exp("lam")
        tokens = F.col("docs") * F.col("size")
        named = state.withColumnRenamed("source", "_of")
        sums = cells.join(named, F.col("source").eqNullSafe(F.col("_of"))).groupBy(F.col("_of").alias("source"), "source_size", "target", "lam").agg(
            F.sum(tokens * F.least(tilted, F.lit(cap))).alias("_g"), F.sum(F.when(tilted < cap, tokens * tilted).otherwise(0.0)).alias("_h"))
        gap = F.col("_g") - F.col("target")
        step = F.when(F.abs(gap) <= tolerance * F.col("target"), 0.0).when(F.col("_h") > 0, F.greatest(F.lit(-1.0), F.least(F.lit(1.0), gap / F.col("_h")))).when(
            gap > 0, 1.0).otherwise(0.0)
        state = kept(sums.select("source", "source_size", "target", (F.col("lam") - step).alias("lam"), step.alias("_step")))
        moved = state.agg(F.max(F.abs("_step"))).first()[0]
        state = state.drop("_step")
        if not moved:
            break
    return state


def round_cells(cells: DataFrame, cap: float = CAP) -> DataFrame:
    """Cells (source, prior, size, docs, rate) with whole `copies` and `extra`, the documents that get one more.

    Large documents first, a cell takes as many extra copies as its share and what
    earlier cells left over come to; so a source ends within half of its smallest size.
    A group is one row per distinct size and prior of a source, however many documents it has.
    """
    def spread(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["size", "prior"], ascending=False)
        left, extra = 0.0, []
        for size, docs, rate, copies in zip(frame["size"], frame["docs"], frame["rate"], frame["copies"], strict=True):
            want = (rate - copies) * docs * size + left
            k = 0 if size <= 0 or copies + 1 > cap else min(docs, max(0, round(want / size)))
            left = want - k * size
            extra.append(k)
        return frame.assign(extra=extra)

    whole = cells.withColumn("copies", F.floor(F.col("rate") + 1e-7).cast("long"))
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in whole.schema) + ", extra long"
    return whole.groupBy("source").applyInPandas(spread, schema)


def mix(docs: DataFrame, weight=None, cap: float = CAP, source: str = "source", prior: Column | None = None, seed: int = 0) -> DataFrame:
    """(doc_id, source, size, source_size, target, rate, copies, taken, row_hash) of every row of `docs`.

    `size` is the text's number of white-space words; null and empty texts have none and
    take nothing. `weight` maps the number of a source (from 0, by code point, null last)
    to its weight; 1, 2, 3 repeating if left out. Targets share all tokens by
    weight, at most `cap` times a source's own. `prior` are rates to stay near to, 1 by
    default. Which documents of a cell get the extra copy is decided by a seeded hash of
    id, so reruns agree; repeated rows are documents of their own.
    """
    weight = weight or (lambda n: n % 3 + 1)
    rows = written(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(source).cast("string").alias("source"), word_count(text_of()).alias("size"),
                               (F.lit(1.0) if prior is None else prior.cast("double")).alias("prior"),
                               F.xxhash64(F.lit(seed), "doc_id", text_of()).alias("_hash")), "mix-sizes")
    cells = written(rows.groupBy(*_CELL).agg(F.count(F.lit(1)).alias("docs")), "mix-cells")
    sources = numbered(cells.groupBy("source").agg(F.sum(F.col("size") * F.col("docs")).alias("source_size")), F.asc_nulls_last("source"))
    duals = balance(cells, source_targets(sources, weight(F.col("n")), cap).drop("n"), cap).withColumnRenamed("source", "_of")
    rated = cells.join(duals, F.col("source").eqNullSafe(F.col("_of"))).select(
        *_CELL, "docs", "source_size", "target", F.least(F.col("prior") * F.exp("lam"), F.lit(cap)).alias("rate"))
    rated = written(round_cells(rated, cap), "mix-rates")

    spread = rated.withColumn("_s", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))).select(
        *[F.col(c).alias(f"_{c}") for c in _CELL], "_s", "docs", "source_size", "target", "rate", "copies", "extra")
    same = (F.pmod(F.col("_hash"), F.lit(SALTS)) == F.col("_s")) & F.col("source").eqNullSafe(F.col("_source")) & (
        F.col("prior") == F.col("_prior")) & (F.col("size") == F.col("_size"))
    found = rows.join(spread, same).drop("_s", *[f"_{c}" for c in _CELL])
    # A cell may hold a third of all rows: it is ranked in groups, each with its share of the extra copies.
    found = found.withColumn("_g", F.pmod(F.xxhash64("_hash"), F.ceil(F.col("docs") / GROUP).cast("long")))
    by = [*_CELL, "_g"]
    groups = found.groupBy(*by).agg(F.count(F.lit(1)).alias("_n"), F.first("docs").alias("_docs"), F.first("extra").alias("_extra"))
    upto = F.sum("_n").over(Window.partitionBy(*_CELL).orderBy("_g"))
    share = lambda n: F.floor(F.col("_extra") * n / F.col("_docs"))
    groups = groups.withColumn("_upto", upto).select(*[F.col(c).alias(f"_k{c}") for c in by], (share(F.col("_upto")) - share(F.col("_upto") - F.col("_n"))).alias("_more"))
    same = (F.col("_g") == F.col("_k_g")) & F.col("source").eqNullSafe(F.col("_ksource")) & (F.col("prior") == F.col("_kprior")) & (F.col("size") == F.col("_ksize"))
    ranked = found.withColumn("_r", F.row_number().over(Window.partitionBy(*by).orderBy("_hash", "doc_id"))).join(groups, same)
    copies = (F.col("copies") + F.when(F.col("_r") <= F.col("_more"), 1).otherwise(0)).cast("long")
    return ranked.select("doc_id", "source", "size", "source_size", "target", "rate", copies.alias("copies"), (copies * F.col("size")).alias("taken"),
                         F.col("_hash").alias("row_hash"))


def mixture(docs: DataFrame, cap: float = CAP, seed: int = 0) -> DataFrame:
    """The rows of the mix with the columns of `docs`; a document taken n times stands there n times.

    Rows equal in id, source and text are one document: it stands there as often as its
    rows are taken together, with the other columns of one of them.
    """
    same = ("doc_id", "source", "row_hash")
    taken = mix(docs, cap=cap, seed=seed).filter("copies > 0").groupBy(F.struct(*same).alias("_same")).agg(F.sum("copies").alias("_copies"))
    row_hash = F.xxhash64(F.lit(seed), F.col("doc_id").cast("long"), text_of())
    key = F.struct(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), row_hash.alias("row_hash"))
    rows = docs.select(key.alias("_same"), F.struct("*").alias("_row")).dropDuplicates(["_same"])
    joined = rows.join(taken, "_same").withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_copies"))))
    return joined.select("_row.*")
