"""Exact Jaccard self-join of word n-gram sets by a prefix tree, and its components.

Each text is a set of hashed word n-grams in one global order: rare n-grams first,
by a count sketch of the whole corpus, ties by hash. Two sets at or above the
threshold share some of their first keys (the prefix), so sets meet by prefix key:

1. equal sets are collapsed into one class;
2. prefix keys that no other class of about the same size has are dropped, and then the
   classes with fewer keys left than any link of theirs must share; near copies remain;
3. each class meets others under its first shared keys with its whole set, in
   blocks of at most `BLOCK` sets, in a tree that compares, links and merges them;
4. keys whose classes are one component by now are done. Under the others one class of each
   component meets the others' ones, in blocks as before, which joins what step 3 left in parts;
5. all classes under keys that are still open meet again, block against block, first with
   prefixes alone, then, if they may link into another component, with whole sets; as many
   passes are made, each over a part of the groups, as keep what moves in proportion to the sets.

Step 5 makes the result complete: a link joins two classes that share a prefix key,
and under every such key either both are in one component already or they are compared.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from barloom.llm.common import Scratch, text_of, unburdened
from barloom.llm.components import components
from barloom.llm.prefix_tree import PrefixTree
from barloom.llm.words import ngram_hashes, word_hashes

SKETCH_BITS = 20      # 2**20 counters: 4 MB per task and for the driver, whatever the corpus
SKETCH_PARTS = 64
BLOCK = 2000          # sets that meet in one tree
FIRST_KEYS = 2        # shared keys under which a class meets others before the rest is looked at
ROUNDS = 1            # times that one class of each component meets the others'
ROUND_KEYS = 2        # keys under which it does
SLICE = 40            # a prefix is longer by this part of its set
BROADCAST_IDS = 1_000_000
PASS_BYTES = 1 << 26  # prefixes that step 5 moves at once, or
PASS_PART = 2         # this part of all sets, if that is more
# Documents without an id come last in the order of ids.
NO_ID = (1 << 63) - 1


def _ngrams(text: str | None, words: int) -> np.ndarray:
    return np.unique(ngram_hashes(word_hashes((text or "").encode().lower())[2], words))


def _sketch(docs: DataFrame, words: int) -> np.ndarray:
    """How often n-grams occur, by the first bits of their hash: one counter row over all texts."""
    cells, parts = 1 << SKETCH_BITS, SKETCH_PARTS

    def count(batches):
        total, held, size = np.zeros(cells, np.int64), [], 0
        for batch in batches:
            for text in batch.column(0):
                grams = _ngrams(text.as_py(), words)
                held.append((grams >> np.uint64(64 - SKETCH_BITS)).astype(np.int64))
                size += len(grams)
                if size > cells:
                    total += np.bincount(np.concatenate(held), minlength=cells)
                    held, size = [], 0
        if held:
            total += np.bincount(np.concatenate(held), minlength=cells)
        if total.any():
            chunks = np.split(np.minimum(total, (1 << 31) - 1).astype(np.int32), parts)
            yield pa.RecordBatch.from_arrays(
                [pa.array(range(parts), pa.int32()), pa.array([c.tobytes() for c in chunks], pa.binary())], ["part", "counts"])

    def add(key, table):
        total = np.zeros(cells // parts, np.int64)
        for value in table.column("counts"):
            total += np.frombuffer(value.as_py(), np.int32)
        return pa.table({"part": pa.array([key[0].as_py()], pa.int32()), "counts": pa.array([total.tobytes()], pa.binary())})

    sums = docs.select(text_of()).mapInArrow(unburdened(count), "part int, counts binary").groupBy("part").applyInArrow(
        add, "part int, counts binary").collect()
    out = np.zeros((parts, cells // parts), np.int64)
    for row in sums:
        out[row.part] = np.frombuffer(row.counts, np.int64)
    return out.reshape(-1)


def _profiles(docs: DataFrame, words: int, share: int, rank: bytes, whole: bool) -> DataFrame:
    """(doc_key, n, cls, keys) of each row: its set's size and class and its ordered prefix, or whole set."""
    bound = docs.sparkSession.sparkContext.broadcast(rank)

    def profile(batches):
        order = np.frombuffer(bound.value, np.uint8)
        for batch in batches:
            sizes, classes, keys = [], [], []
            for text in batch.column(1):
                grams = _ngrams(text.as_py(), words)
                n = len(grams)
                sizes.append(n)
                classes.append(xxhash.xxh3_64_intdigest(grams.tobytes()) >> 1)
                ordered = np.sort((order[grams >> np.uint64(64 - SKETCH_BITS)].astype(np.int64) << 58)
                                  | (grams >> np.uint64(6)).astype(np.int64))
                keys.append((ordered if whole else ordered[:n - -(-share * n // 100) + n // SLICE + 1] if n else ordered).tobytes())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(sizes, pa.int64()), pa.array(classes, pa.int64()), pa.array(keys, pa.binary())],
                ["doc_key", "n", "cls", "keys"])

    return docs.select("doc_key", "text").mapInArrow(unburdened(profile), "doc_key long, n long, cls long, keys binary")


def _postings(classes: DataFrame) -> DataFrame:
    """One row (t, pos, cls, n) per prefix key of a class."""
    def unpack(batches):
        for batch in batches:
            keys = [np.frombuffer(k.as_py(), np.int64) for k in batch.column("keys")]
            lengths = np.array([len(k) for k in keys], np.int64)
            if lengths.sum():
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys)), pa.array(np.concatenate([np.arange(x, dtype=np.int32) for x in lengths])), *[
                    pa.array(np.repeat(batch.column(c).to_numpy(), lengths)) for c in ("cls", "n")]], ["t", "pos", "cls", "n"])

    return classes.select("cls", "n", "keys").mapInArrow(unburdened(unpack), "t long, pos int, cls long, n long")


def _fewest(share: int):
    """How many prefix keys the class shares with any link of its, by its size `n`."""
    return F.floor(F.ceil(F.col("n") * share / 100) / SLICE) + 1


def _shared(classes: DataFrame, share: int, scratch: Scratch) -> DataFrame:
    """(t, pos, cls, n, own, df_own, df_next): prefix keys that several classes of about the same size have.

    The smaller of two linked sets has `share` percent of the larger at least, so they lie in
    one size bucket or in neighbours; a class stands in its bucket `own` and in the next, where
    it meets only those whose own that is. `df_own` and `df_next` count the classes
    that a key has in either; null where the class has no link under the key there. A prefix is
    longer by n / `SLICE` keys than one shared key would need; so linked sets share
    as many more, by the smaller one's size, and a class with fewer shared keys has no link.
    """
    postings = _postings(classes)
    # Most keys stand alone. Those that do not are written first, so that the shuffle of the counts is gone when postings move.
    repeated = scratch.write(postings.groupBy("t").agg(F.count(F.lit(1)).alias("_c")).filter("_c > 1").select("t"), "repeated")
    width = float(np.log(100 / share) * 1.0001) if share < 100 else 1e-9
    left = scratch.write(postings.join(repeated, "t").select(
        "t", "pos", "cls", "n", F.floor(F.log("n") / width).alias("own"), F.lit(0).cast("long").alias("df_own"),
        F.lit(0).cast("long").alias("df_next")), "twice")
    scratch.drop("repeated")
    none = F.lit(None).cast("long")
    for number in range(2):
        # Counted by own bucket, then laid into both: few rows move for a key that many classes have.
        counts = left.groupBy("t", "own").agg(F.count("df_own").alias("_o"), F.count("df_next").alias("_x"))
        groups = counts.select("t", F.inline(F.array(
            F.struct(F.col("own").alias("b"), F.col("_o").alias("_c"), (F.col("_o") > 0).alias("_m")),
            F.struct((F.col("own") + 1).alias("b"), F.col("_x").alias("_c"), F.lit(False).alias("_m"))))).groupBy("t", "b").agg(
            F.sum("_c").alias("df"), F.max("_m").alias("_m")).filter("df > 1 and _m")
        sizes = groups.select("t", F.inline(F.array(
            F.struct(F.col("b").alias("own"), F.col("df").alias("_o"), none.alias("_x")),
            F.struct((F.col("b") - 1).alias("own"), none.alias("_o"), F.col("df").alias("_x"))))).groupBy("t", "own").agg(
            F.max("_o").alias("_o"), F.max("_x").alias("_x"))
        found = left.join(sizes, ["t", "own"]).select(
            "t", "pos", "cls", "n", "own", F.when(F.col("df_own").isNotNull(), F.col("_o")).alias("df_own"),
            F.when(F.col("df_next").isNotNull(), F.col("_x")).alias("df_next")).filter("df_own is not null or df_next is not null")
        enough = found.groupBy("cls").agg(F.count("df_own").alias("_o"), F.count("df_next").alias("_x"), F.first("n").alias("n")).select(
            "cls", (F.col("_o") >= _fewest(share)).alias("_o"), (F.col("_x") >= _fewest(share)).alias("_x")).filter("_o or _x")
        left = scratch.write(found.join(enough, "cls").select(
            "t", "pos", "cls", "n", "own", F.when(F.col("_o"), F.col("df_own")).alias("df_own"),
            F.when(F.col("_x"), F.col("df_next")).alias("df_next")).filter("df_own is not null or df_next is not null"), f"shared-{number}")
        scratch.drop("twice" if number == 0 else "shared-0")
    return left


def _bucketed(rows: DataFrame) -> DataFrame:
    """One row (b, mine, df) for each size bucket in which a row of `_shared` still counts."""
    buckets = F.filter(F.array(
        F.struct(F.col("own").alias("b"), F.lit(1).alias("mine"), F.col("df_own").alias("df")),
        F.struct((F.col("own") + 1).alias("b"), F.lit(0).alias("mine"), F.col("df_next").alias("df"))), lambda x: x["df"].isNotNull())
    return rows.select(*[c for c in rows.columns if c not in ("own", "df_own", "df_next")], F.inline(buckets))


def _meet(rows: DataFrame, share: int, first: bool, merge: bool) -> DataFrame:
    """Hits (a, b, t, bucket) among the sets (t, b, i, j, cls, root, n, keys) of each (t, b, i, j)."""
    def walk(batches):
        here, tree = None, None
        for batch in batches:
            out = []
            columns = [batch.column(c).to_pylist() for c in ("t", "b", "i", "j", "cls", "root", "n", "keys")]
            for t, b, i, j, cls, root, n, keys in zip(*columns, strict=True):
                if (t, b, i, j) != here:
                    here, tree = (t, b, i, j), PrefixTree(share, t if first else None, merge)
                out += [(cls, other, t, b) for other in tree.add(cls, root, n, np.frombuffer(keys, np.int64).tolist())]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*out, strict=True)], ["a", "b", "t", "bucket"])

    return (rows.select("t", "b", "i", "j", "cls", "root", "n", "keys").repartition("t", "b", "i", "j")
            .sortWithinPartitions("t", "b", "i", "j", "cls").mapInArrow(unburdened(walk), "a long, b long, t long, bucket long"))


def _blocked(rows: DataFrame, members: str) -> DataFrame:
    """Adds the pairs of blocks (i, j) in which a set meets all others of its key."""
    n = F.ceil(F.col(members) / BLOCK).cast("int")
    own = F.pmod(F.xxhash64("cls"), F.col("_n")).cast("int")
    pairs = F.transform(F.sequence(F.lit(0), F.col("_n") - 1), lambda k: F.struct(
        F.least(F.col("_own"), k).alias("i"), F.greatest(F.col("_own"), k).alias("j")))
    return rows.withColumn("_n", n).withColumn("_own", own).withColumn("_p", F.explode(pairs)).select(
        "*", "_p.i", "_p.j").drop("_n", "_own", "_p")


def _rooted(rows: DataFrame, roots: DataFrame) -> DataFrame:
    """`rows` with the component of each class."""
    return rows.join(roots.withColumnRenamed("node", "cls"), "cls", "left").withColumn("root", F.coalesce("root", "cls"))


def _open(rows: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """The rows under keys (t, b) where several components meet, `m` rows of size `least` or more.

    Components only grow, so the other keys are done for good.
    """
    keys = rows.groupBy("t", "b").agg(
        F.min("root").alias("_a"), F.max("root").alias("_b"), F.count(F.lit(1)).alias("m"), F.max("mine").alias("_m"),
        F.min("n").alias("least")).filter("_a < _b and _m = 1").select("t", "b", "m", "least")
    return scratch.write(rows.join(keys, ["t", "b"]).select("t", "b", "pos", "cls", "n", "mine", "root", "m", "least"), name)


def linked_classes(docs: DataFrame, words: int, share: int) -> tuple[DataFrame, DataFrame]:
    """(doc_key, n, cls) of the rows of (doc_key, text), and (cls, root) of the linked classes."""
    order = np.minimum(np.log2(_sketch(docs, words) + 1), 31).astype(np.uint8).tobytes()
    scratch = Scratch(docs.sparkSession, "ngram")
    profiles = scratch.write(_profiles(docs, words, share, order, whole=False), "profiles")
    classes = scratch.write(profiles.filter("n > 0").groupBy("cls").agg(F.min_by(F.struct("doc_key", "n", "keys"), "doc_key").alias("r"))
                            .select("cls", "r.doc_key", "r.n", "r.keys"), "classes")
    ids_of = scratch.write(profiles.select("doc_key", "n", "cls"), "ids")
    scratch.drop("profiles")
    total = classes.agg(F.sum("n")).first()[0] or 0
    shared = _shared(classes, share, scratch)

    wanted = classes.select("cls", "doc_key").join(shared.select("cls").distinct(), "cls", "left_semi")
    ids = wanted.select("doc_key").distinct()
    if ids.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS:
        ids = F.broadcast(ids)
    sets = scratch.write(_profiles(docs.join(ids, "doc_key", "left_semi"), words, share, order, whole=True).select("cls", "keys")
                         .join(wanted.select("cls"), "cls", "left_semi").groupBy("cls").agg(F.first("keys").alias("keys")), "sets")
    scratch.drop("classes")

    ahead = Window.partitionBy("cls").orderBy("t", "b")
    near = _bucketed(shared).withColumn("_k", F.row_number().over(ahead)).filter(F.col("_k") <= FIRST_KEYS).select(
        "t", "b", "cls", "n", F.col("cls").alias("root"), F.lit(0).alias("i"),
        F.pmod(F.xxhash64("cls"), F.ceil(F.col("df") / BLOCK)).cast("int").alias("j"))
    edges = scratch.write(_meet(near.join(sets, "cls"), share, False, True).select("a", "b"), "edges")
    met = _bucketed(_rooted(shared, components(edges)))
    for number in range(ROUNDS):
        met = _open(met, scratch, f"open-{number}")
        scratch.drop("shared-1" if number == 0 else f"open-{number - 1}")
        one = met.groupBy("t", "b", "root").agg(F.min_by(F.struct("cls", "n"), "cls").alias("r"))
        ahead = Window.partitionBy("root").orderBy("t", "b")
        heads = scratch.write(one.withColumn("_k", F.row_number().over(ahead)).filter(F.col("_k") <= ROUND_KEYS).select(
            "t", "b", "r.cls", "r.n", "root"), f"heads-{number}")
        # Unlinked classes are components of their own, so a key may have as many heads as classes.
        members = heads.groupBy("t", "b").agg(F.count(F.lit(1)).alias("_m"))
        heads = heads.join(members, ["t", "b"]).select(
            "t", "b", "cls", "n", "root", F.lit(0).alias("i"), F.pmod(F.xxhash64("cls"), F.ceil(F.col("_m") / BLOCK)).cast("int").alias("j"))
        edges = edges.union(scratch.write(_meet(heads.join(sets, "cls"), share, False, True).select("a", "b"), f"edges-{number}"))
        scratch.drop(f"heads-{number}")
        met = _rooted(met.drop("root", "m", "least"), components(edges))

    met = _open(met, scratch, "open")
    scratch.drop(f"open-{ROUNDS - 1}")
    # All keys that two unjoined links share are open, `_fewest` at least; the first one leaves as many behind it in both.
    # A class with fewer open keys has no link left, and its last keys are no pair's first.
    own = Window.partitionBy("cls", "b")
    met = met.repartition("cls").withColumns({"_c": F.count(F.lit(1)).over(own), "_k": F.row_number().over(own.orderBy("t"))}).filter(
        F.col("_k") <= F.col("_c") - _fewest(share) + 1)
    # Keys before the first shared one are lost for an overlap; a class that has too many of them,
    # even for the smallest partner under the key, has its first shared key elsewhere.
    partner = F.greatest(F.col("least"), F.ceil(F.col("n") * share / 100))
    early = F.col("pos") <= F.col("n") - F.ceil(share * (F.col("n") + partner) / (100 + share)) + 1
    left = scratch.write(_blocked(met.filter(early), "m").select("t", "b", "i", "j", "cls", "root", "n"), "left")
    scratch.drop("open")
    size = (F.length("keys") / 8).cast("long")
    prefix = size - F.ceil(size * share / 100) + F.floor(size / SLICE) + 1
    begun = sets.select("cls", F.substring("keys", F.lit(1), (8 * prefix).cast("int")).alias("keys"))
    # A class moves once per key and pair of blocks; passes over whole groups bound what moves at once.
    moved = left.agg(F.sum(F.col("n") - F.ceil(F.col("n") * share / 100) + F.floor(F.col("n") / SLICE) + 1)).first()[0] or 0
    passes = -(-8 * moved // max(PASS_BYTES, 8 * total // PASS_PART)) or 1
    for number in range(passes):
        some = left.filter(F.pmod(F.xxhash64("t", "b", "i", "j"), F.lit(passes)) == number)
        maybe = scratch.write(_meet(some.join(begun, "cls"), share, True, False), f"maybe-{number}")
        again = maybe.select("t", F.col("bucket").alias("b"), F.col("a").alias("cls")).union(maybe.select("t", "bucket", "b")).distinct()
        late = _meet(some.join(again, ["t", "b", "cls"], "left_semi").join(sets, "cls"), share, True, True).select("a", "b")
        edges = edges.union(scratch.write(late, f"late-{number}"))
        scratch.drop(f"maybe-{number}")
    roots = components(edges).select(F.col("node").alias("cls"), "root")
    scratch.drop("sets", "left", "edges", *(f"edges-{number}" for number in range(ROUNDS)), *(f"late-{number}" for number in range(passes)))
    return ids_of, roots


def ngram_components(docs: DataFrame, words: int = 5, share: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row of `docs`.

    Sets are the distinct runs of `words` words (white-space words, A-Z lowered; a
    shorter text is one run). Rows link when 100 * intersection >= `share` * union;
    component_id is the least id reachable. Null and empty texts have no set, link
    with nothing and are their own component. Repeated rows and equal texts share a
    class. A null id takes part; a component of null ids alone has a null id. Other
    columns are not read. n-grams are compared by 58-bit hashes, classes by 63-bit ones.
    """
    rows = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("doc_key"), F.col(text_col).alias("text"))
    profiles, roots = linked_classes(rows, words, share)
    least = profiles.filter("n > 0").groupBy("cls").agg(F.min("doc_key").alias("doc_key"))
    named = least.join(roots, "cls", "left").withColumn("root", F.coalesce("root", "cls"))
    tops = named.groupBy("root").agg(F.min("doc_key").alias("component_id"))
    by_class = named.join(tops, "root").select("cls", "component_id")
    out = profiles.join(by_class, "cls", "left")
    component = F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_key"))
    return out.select(
        F.nullif("doc_key", F.lit(NO_ID)).alias("doc_id"), F.col("n").alias("n_shingles"),
        F.nullif(component, F.lit(NO_ID)).alias("component_id"))


def drop_near_copies(docs: DataFrame, words: int = 5, share: int = 80) -> DataFrame:
    """Keep one row of each component: the one with the least id, ids before none; of these one text.

    Texts without words have no component and stay. Rows are told apart by the 64-bit
    hash of id and text: a row repeated with both is kept once, one that repeats an id
    with another text is judged by its own text. All columns return, whatever their names.
    """
    key = F.xxhash64("doc_id", "text")
    profiles, roots = linked_classes(docs.select(key.alias("doc_key"), "text"), words, share)
    ids = docs.select(key.alias("doc_key"), F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("id")).distinct()
    classes = profiles.select("doc_key", "n", "cls").distinct()
    named = classes.filter("n > 0").join(roots, "cls", "left").join(ids, "doc_key")
    heads = named.groupBy(F.coalesce("root", "cls").alias("top")).agg(F.min(F.struct("id", "doc_key")).alias("head"))
    keep = heads.select("head.doc_key").unionByName(classes.filter("n = 0").select("doc_key"))
    rows = docs.select(key.alias("doc_key"), F.struct("*").alias("row"))
    return rows.join(keep, "doc_key", "left_semi").dropDuplicates(["doc_key"]).select("row.*")
