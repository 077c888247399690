"""Ranked lexical search over blocks of posting lists with range-maximum tables.

`build_index` turns documents into blocks, each with its own posting lists in ascending document
order. A search hands every block the items' terms with their weights. For the terms of the items a
block gets sparse tables: the largest impact of each power-of-two stretch of a posting list. The best
documents are found by intervals of documents: an interval's bound is the sum over the terms of their
range maxima, the best ones are opened first, each is split at a document of maximum impact, which is
scored, and what is left of it on either side is bounded anew. Intervals that are bounded below the
item's k-th best score are never opened, so the result is exact.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.llm.common import LARGE_ROWS, Scratch

BLOCK_DOCS = 4096          # documents of a block
BLOCK_BYTES = 1 << 23      # text after which a block is closed, too
OPENED = 48                # intervals that are split together
QUERY_TERMS = 1 << 18      # item terms that are handed out at once; further items are searched in further rounds
# Fixed value: everything but ASCII digits and letters and what lies beyond ASCII parts terms.
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b > 127 else 32 for b in range(256))

INDEX = ("block long, n_with_terms long, n_terms long, doc_ids array<long>, lens array<int>, terms array<string>, dfs array<int>, "
         "docs binary, tfs binary")
_INDEX_TYPES = [pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.list_(pa.string()), pa.list_(pa.int32()),
                pa.binary(), pa.binary()]
_INDEX_NAMES = [c.split()[0] for c in INDEX.split(", ")]


def terms_of(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(_FOLD).split()


def _block(number: int, ids: list, docs: list[list[bytes]]) -> pa.RecordBatch:
    order = sorted(range(len(ids)), key=lambda i: (ids[i] is None, ids[i] or 0))
    ids, docs = [ids[i] for i in order], [docs[i] for i in order]
    lens = np.array([len(d) for d in docs], np.int64)
    known: dict = {}
    words = np.array([known.setdefault(w, len(known)) for d in docs for w in d], np.int64)
    keys, tfs = np.unique(words * len(ids) + np.repeat(np.arange(len(ids)), lens), return_counts=True)
    dfs = np.bincount(keys // len(ids), minlength=len(known))
    row = [number, int((lens > 0).sum()), int(lens.sum()), ids, lens, [w.decode() for w in known], dfs,
           (keys % len(ids)).astype(np.uint32).tobytes(), tfs.astype(np.uint32).tobytes()]
    return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, _INDEX_TYPES, strict=True)], _INDEX_NAMES)


def build_index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Blocks of the inverted index over every row of `docs`, without a shuffle; write them to reuse them, with `LARGE_ROWS`.

    A row without an id is indexed with a null id, repeated rows are all indexed, null texts hold no
    term. A text beyond the block's size makes a block of its own; it needs about 150 bytes of memory a term.
    """
    def run(batches):
        first, number, ids, held, size = TaskContext.get().partitionId() << 32, 0, [], [], 0
        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                words = terms_of(text.as_py())
                ids.append(doc)
                held.append(words)
                size += sum(map(len, words))
                if len(ids) >= BLOCK_DOCS or size >= BLOCK_BYTES:
                    yield _block(first + number, ids, held)
                    number, ids, held, size = number + 1, [], [], 0
        if ids:
            yield _block(first + number, ids, held)

    return docs.select(F.col(id_col).cast("long"), F.col(text_col)).mapInArrow(run, INDEX)


class Block:
    """Posting lists of one block for the terms that items ask for, with their range-maximum tables."""

    def __init__(self, row: dict, asked: dict[str, int], n_docs: int, n_terms: int):
        self.ids, dfs = row["doc_ids"], np.array(row["dfs"], np.int64)
        last = np.cumsum(dfs)
        self.place = {t: i for i, t in enumerate(t for t in row["terms"] if t in asked)}
        here = np.array([i for i, t in enumerate(row["terms"]) if t in asked], np.int64)
        own = dfs[here]
        self.stop = np.cumsum(own)
        self.start = self.stop - own
        at = np.repeat(last[here] - own - self.start, own) + np.arange(int(own.sum()))
        docs, tfs = np.frombuffer(row["docs"], np.uint32)[at].astype(np.int64), np.frombuffer(row["tfs"], np.uint32)[at].astype(np.int64)
        m = 50 + 50 * np.array(row["lens"], np.int64)[docs] * n_docs // max(n_terms, 1)
        self.docs, self.impact = docs, 1_000_000_000 * tfs // (1000 * tfs + 20 * m)
        self.keys = np.repeat(np.arange(len(own)), own) * (len(self.ids) + 1) + docs
        levels = [self.impact << 32 | docs]                  # the impact with its document
        width = 1
        while 2 * width <= own.max(initial=0):
            levels.append(levels[-1].copy())
            np.maximum(levels[-2][:-width], levels[-2][width:], out=levels[-1][:-width])
            width *= 2
        self.table = np.stack(levels)
        self.log = np.maximum(np.frexp(np.arange(own.max(initial=0) + 2))[1] - 1, 0)

    def most(self, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        """Largest (impact, document) of each stretch of postings; -1 where it is empty."""
        size = stop - start
        some = size > 0
        k = self.log[size]
        i = np.where(some, start, 0)
        out = np.maximum(self.table[k, i], self.table[k, np.where(some, stop - (1 << k), 0)])
        return np.where(some, out, -1)

    def search(self, terms: list[str], weights: list[int], k: int, least: int) -> list[tuple[int, int]]:
        """(score, document's place) of the documents that can be among the `k` best and score `least` or more."""
        here = [(self.place[t], w) for t, w in zip(terms, weights, strict=True) if t in self.place and w > 0]
        if not here:
            return []
        lists, weight = np.array([i for i, _ in here]), np.array([w for _, w in here], np.int64)[:, None]
        base = (lists * (len(self.ids) + 1))[:, None]
        start, stop = self.start[lists][:, None], self.stop[lists][:, None]
        floor, scores, places = max(least, 1), np.zeros(0, np.int64), np.zeros(0, np.int64)

        def bounded(start, stop):
            top = self.most(start, stop)
            gain = np.where(top >= 0, (top >> 32) * weight, 0)
            lead = np.argmax(gain, 0)
            return gain.sum(0), top[lead, np.arange(top.shape[1])] & 0xFFFFFFFF

        bound, split = bounded(start, stop)
        while len(bound):
            open_ = np.argpartition(-bound, OPENED)[:OPENED] if len(bound) > OPENED else np.arange(len(bound))
            a, b, at = start[:, open_], stop[:, open_], split[open_]
            place = np.clip(np.searchsorted(self.keys, base + at), a, b)
            hit = place < b
            hit[hit] = self.docs[place[hit]] == np.broadcast_to(at, hit.shape)[hit]
            value = np.zeros(hit.shape, np.int64)
            value[hit] = self.impact[place[hit]]
            scores, places = np.concatenate([scores, (value * weight).sum(0)]), np.concatenate([places, at])
            if len(scores) > k:
                best = np.argpartition(-scores, k - 1)
                floor = max(floor, int(scores[best[k - 1]]))
                stay = scores >= floor
                scores, places = scores[stay], places[stay]
            parts = np.concatenate([a, place + hit], 1), np.concatenate([place, b], 1)
            own_bound, own_split = bounded(*parts)
            rest = np.ones(len(bound), bool)
            rest[open_] = False
            rest &= bound >= floor
            new = own_bound >= floor
            start, stop = np.concatenate([start[:, rest], parts[0][:, new]], 1), np.concatenate([stop[:, rest], parts[1][:, new]], 1)
            bound, split = np.concatenate([bound[rest], own_bound[new]]), np.concatenate([split[rest], own_split[new]])
        stay = scores >= floor
        return list(zip(scores[stay].tolist(), places[stay].tolist(), strict=True))


def terms_column(text: Column) -> Column:
    """Distinct terms of a text: the same as `terms_of`, without Python."""
    lower = F.translate(F.coalesce(text, F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.array_distinct(F.regexp_extract_all(lower, F.lit(TERM), 0))


def weighted_terms(index: DataFrame, items: DataFrame, n_docs: int, item_col: str, text_col: str) -> DataFrame:
    """(item, term, weight) of the items' terms that documents hold."""
    asked = items.select(F.col(item_col).cast("long").alias("item"), F.explode(terms_column(F.col(text_col))).alias("term")).distinct()
    postings = index.select(F.explode(F.arrays_zip("terms", "dfs")).alias("p")).select(F.col("p.terms").alias("term"), F.col("p.dfs").alias("df"))
    dfs = postings.join(asked.select("term").distinct(), "term", "left_semi").groupBy("term").agg(F.sum("df").alias("df"))
    weight = F.floor(1000 * F.log((2 * F.lit(n_docs) + 2) / (2 * F.col("df") + 1))).cast("long")
    return asked.join(dfs, "term").select("item", "term", weight.alias("weight"))


def _best_of_task(index: DataFrame, items: dict, k: int, n_docs: int, n_terms: int) -> DataFrame:
    """(item, doc_id, score): each task's `k` best of every item of `items`; what earlier blocks found prunes later ones."""
    shared = index.sparkSession.sparkContext.broadcast(items)

    def run(batches):
        asked = {t: 0 for terms, _ in shared.value.values() for t in terms}
        best: dict = {item: [] for item in shared.value}
        for batch in batches:
            for i in range(batch.num_rows):
                block = Block(batch.slice(i, 1).to_pylist()[0], asked, n_docs, n_terms)
                for item, (terms, weights) in shared.value.items():
                    held = best[item]
                    new = block.search(terms, weights, k, held[-1][1] if len(held) == k else 0)
                    if new:
                        held = held + [(block.ids[place], score) for score, place in new]
                        best[item] = sorted(held, key=lambda r: (-r[1], r[0] is None, r[0] or 0))[:k]
        rows = [(item, doc, score) for item, held in best.items() for doc, score in held]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], ["item", "doc_id", "score"])

    return index.mapInArrow(run, "item long, doc_id long, score long")


def search(index: DataFrame, items: DataFrame, k: int, item_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """(item_col, rank, doc_id, score): the `k` best documents of every item with a score above 0, equal scores by ascending id.

    A document's score adds up, over the item's distinct terms, w * ((10**9 * tf) div (1000 * tf + 20 * m)) with
    w = floor(1000 * ln((2 * N + 2) / (2 * df + 1))) and m = 50 + (50 * n * N) div L; N documents hold a term, L counts
    all terms, n the document's, df the documents with the term and tf its occurrences. Items of one id, also
    without an id, are one item with all their terms; an item without terms has no rows. Null document ids come last.

    The index is read once for every `QUERY_TERMS` terms of items: only so many are handed to the executors at once.
    """
    n_docs, n_terms = index.agg(F.sum("n_with_terms"), F.sum("n_terms")).first()
    found = None
    if n_docs:
        scratch = Scratch(index.sparkSession, "ranked-terms")
        weighted = scratch.write(weighted_terms(index, items, n_docs, item_col, text_col), "weights")
        rounds = max(1, -(-weighted.count() // QUERY_TERMS))
        for number in range(rounds):
            some: dict = {}
            for row in weighted.filter(F.pmod(F.xxhash64("item"), F.lit(rounds)) == number).toLocalIterator():
                terms, weights = some.setdefault(row.item, ([], []))
                terms.append(row.term)
                weights.append(row.weight)
            best = _best_of_task(index, some, k, n_docs, n_terms)
            found = best if found is None else found.union(best)
    else:
        found = index.sparkSession.createDataFrame([], "item long, doc_id long, score long")
    order = [F.desc("score"), F.col("doc_id").asc_nulls_last()]
    # Many tasks' best are cut in parts first, so that the last ranking of an item reads few rows.
    found = found.withColumn("_part", F.pmod(F.spark_partition_id(), F.lit(64)))
    found = found.withColumn("_rank", F.row_number().over(Window.partitionBy("item", "_part").orderBy(*order))).filter(F.col("_rank") <= k)
    found = found.withColumn("rank", F.row_number().over(Window.partitionBy("item").orderBy(*order))).filter(F.col("rank") <= k)
    return found.select(F.col("item").alias(item_col), F.col("rank").cast("int").alias("rank"), "doc_id", "score")


def search_documents(docs: DataFrame, items: DataFrame, k: int, item_col: str = "item_id") -> DataFrame:
    """Index all rows of `docs` in the shared folder, search the items, and delete the index again."""
    scratch = Scratch(docs.sparkSession, "ranked-index")
    index = scratch.write(build_index(docs), "index", **LARGE_ROWS)
    out = scratch.write(search(index, items, k, item_col), "found")
    scratch.drop("index")
    return out
