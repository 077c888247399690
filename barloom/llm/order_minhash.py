"""Order MinHash of whole texts with DataFrame functions only.

A text is its sequence of k-mers of white-space words. Equal k-mers are told apart by an
occurrence number, and each (k-mer, number) gets one hash. Sketch i selects the `pick`
least hashes in the cyclic order that starts at i / sketches, puts them back in text
order and hashes the k-mers in that order. So one sort serves all sketches; the
rotations stand for the independent permutations.

Everything happens inside the row: sorted arrays of longs that hold a hash in their upper
bits and the position in the lower ones, as many bits as the text's length needs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from barloom.llm.common import let, lower_bound, parts_of, text_of

K = 3            # words in a k-mer
PICK = 2         # k-mers in a tuple
SKETCHES = 64
DIGITS = 4       # hex digits of a sketch
SPLIT = r"[\x20\x09-\x0D]+"


def _packed(hashes: Column, bits: Column, n: Column) -> Column:
    """Sorted longs: the upper bits of each hash (as unsigned, without the sign), then its position."""
    keep = F.lit((1 << 63) - 1) - F.call_function("shiftleft", F.lit(1).cast("long"), bits) + 1
    return F.sort_array(F.zip_with(hashes, F.sequence(F.lit(0), n - 1), lambda h, i: h.bitwiseAND(keep).bitwiseOR(i.cast("long"))))


def fingerprint(text: Column, k: int = K, pick: int = PICK, sketches: int = SKETCHES) -> Column:
    """Fingerprint of a text: `sketches` groups of hex digits; empty for a text without words.

    Texts of fewer than `k` words are one k-mer, and a sketch of fewer than `pick`
    k-mers holds those there are.
    """
    def of_words(words):
        hashed = F.transform(words, lambda w: F.xxhash64(w))
        return let(hashed, lambda h: F.when(F.size(h) > 0, of_hashes(h)).otherwise(F.lit("")))

    def of_hashes(h):
        m = F.least(F.lit(k), F.size(h))
        kmers = F.transform(F.sequence(F.lit(0), F.size(h) - m),
                            lambda i: F.xxhash64(*[F.get(h, i + j) for j in range(k)])) if k > 1 else h
        short = F.transform(F.array(F.lit(0)), lambda _: F.xxhash64(*[F.get(h, F.lit(j)) for j in range(k)]))
        return let(F.when(m < k, short).otherwise(kmers), numbered)

    def numbered(x):
        n, bits = F.size(x), F.length(F.bin(F.size(x).cast("long")))
        low = F.call_function("shiftleft", F.lit(1).cast("long"), bits) - 1
        return let(F.struct(_packed(x, bits, n).alias("s"), low.alias("low"), n.alias("n"), x.alias("x")), occurrences)

    def occurrences(p):
        s, n, low = p["s"], p["n"], p["low"]
        hash_bits = F.bitwise_not(low).bitwiseAND(F.lit((1 << 63) - 1))

        def mark(v, number):
            return F.xxhash64(v.bitwiseOR(low), number).bitwiseAND(hash_bits).bitwiseOR(v.bitwiseAND(low))

        # Where a new k-mer begins in the sorted list; the running number inside each run follows from that.
        starts = F.filter(F.sequence(F.lit(0), n - 1), lambda i: (i == 0) | (
            F.get(s, i).bitwiseOR(low) != F.get(s, i - 1).bitwiseOR(low)))

        def marked(at):
            ends = F.concat(F.slice(at, F.lit(2), F.size(at)), F.array(n))
            runs = F.flatten(F.zip_with(at, ends, lambda a, e: F.sequence(F.lit(0), e - a - 1)))
            return F.when(F.size(at) == n, F.transform(s, lambda v: mark(v, F.lit(0)))).otherwise(F.zip_with(s, runs, mark))

        return let(F.struct(F.sort_array(let(starts, marked)).alias("r"), low.alias("low"), n.alias("n"), p["x"].alias("x")), chosen)

    def chosen(p):
        r, n, low, x = p["r"], p["n"], p["low"], p["x"]
        marks = F.array(*[F.lit((i << 63) // sketches) for i in range(sketches)])

        def sketch(mark):
            at = lower_bound(r, n, mark)
            places = F.array_sort(F.array_distinct(F.array(*[F.get(r, (at + j) % n).bitwiseAND(low).cast("int") for j in range(pick)])))
            picked = let(places, lambda q: F.xxhash64(*[F.get(x, F.get(q, F.lit(j))) for j in range(pick)]))
            return F.substring(F.lpad(F.hex(picked), 16, "0"), 1, DIGITS)

        return F.lower(F.array_join(F.transform(marks, sketch), ""))

    return let(F.array_remove(F.split(text, SPLIT, -1), ""), of_words)


def likeness(a: Column, b: Column, sketches: int = SKETCHES) -> Column:
    """Share of equal sketches; two empty fingerprints are alike, an empty and another are not."""
    same = F.aggregate(F.sequence(F.lit(0), F.lit(sketches - 1)), F.lit(0), lambda n, i: n + F.when(
        F.substring(a, i * DIGITS + 1, F.lit(DIGITS)) == F.substring(b, i * DIGITS + 1, F.lit(DIGITS)), 1).otherwise(0))
    return F.when((a == "") | (b == ""), (a == b).cast("double")).otherwise(same / F.lit(float(sketches)))


def with_next(docs: DataFrame) -> DataFrame:
    """(doc_id, text, fingerprint, next_text, next_fingerprint): each row with the next text in descending order of id, the last with the first.

    Ids are dealt to blocks by quantiles; a block sees its own rows and a copy of the
    first rows of the block behind it, so a text is shuffled once and no task gets
    more than a block. Repeated ids follow one another by text; null ids come last.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"))
    blocks = 8 * parts_of(docs)
    cuts = rows.agg(F.percentile_approx("doc_id", [i / blocks for i in range(1, blocks)], 10 * blocks).alias("c")).first()
    cuts = sorted(set(cuts["c"] or []), reverse=True)
    bounds = F.lit(cuts) if cuts else F.array().cast("array<long>")
    block = F.when(F.col("doc_id").isNull(), len(cuts) + 1).otherwise(
        lower_bound(bounds, F.lit(len(cuts)), F.col("doc_id"), before=lambda a, b: a >= b))
    rows = rows.withColumn("_b", block)
    firsts = rows.groupBy("_b").agg(F.max("doc_id").alias("_first"))      # one row per block
    order = Window.orderBy("_b")
    firsts = firsts.select(F.col("_b").alias("_of"), "_first", F.coalesce(
        F.lag("_b").over(order), F.max("_b").over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))).alias("_to"))
    tagged = rows.withColumn("fingerprint", fingerprint(F.col("text"))).join(F.broadcast(firsts), F.col("_b") == F.col("_of"))
    homes = F.array(F.struct(F.col("_b").alias("b"), F.lit(0).alias("copy")), F.struct(F.col("_to").alias("b"), F.lit(1).alias("copy")))
    homes = F.when(F.col("doc_id").eqNullSafe(F.col("_first")), homes).otherwise(F.slice(homes, 1, 1))
    placed = tagged.select("doc_id", "text", "fingerprint", F.explode(homes).alias("_h"))
    ahead = Window.partitionBy("_h.b").orderBy("_h.copy", F.desc_nulls_last("doc_id"), "text")
    following = {f"next_{c}": F.lead(c).over(ahead) for c in ("text", "fingerprint")}
    return placed.withColumns(following).filter("_h.copy = 0").drop("_h")


def edited_text(text: Column, n_chars: Column, following: Column) -> Column:
    """The last third of the code points replaced by as many, or all there are, of the next text."""
    third = F.floor(n_chars / 3).cast("int")
    return F.concat(F.substring(text, F.lit(1), (n_chars - third).cast("int")), F.substring(following, F.lit(1), third))


def edit_fingerprints(docs: DataFrame) -> DataFrame:
    """Fingerprints of every text, of its edited text and their likeness, and that to the next text.

    A null text is an empty one. Rows come back as often as they stand there; an only
    row is its own next. Other columns are not read.
    """
    near = with_next(docs).withColumn("n_chars", F.char_length("text").cast("long"))
    near = near.withColumn("edited", edited_text(F.col("text"), F.col("n_chars"), F.col("next_text")))
    prints = near.select("doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), "fingerprint",
                         fingerprint(F.col("edited")).alias("edited_fingerprint"), "next_fingerprint")
    return prints.withColumn("near_edited", likeness(F.col("fingerprint"), F.col("edited_fingerprint"))).withColumn(
        "near_next", likeness(F.col("fingerprint"), F.col("next_fingerprint"))).drop("next_fingerprint")
