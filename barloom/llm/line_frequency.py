"""Quality rules by cross-document line frequency.

One pass over the texts writes a narrow profile: the counts of the base rules and,
per distinct normalised line, its hash and its words. Everything after that works
on hashes: how many distinct texts of a host have a line, which lines are above the
limit, and how many words a document loses with them.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from barloom.llm.common import unburdened, written
from barloom.llm.words import ngram_hashes, word_hashes

MIN_WORDS = 50          # fixed by the base rule
REPEAT_SHARE = 50       # percent; fixed by the base rule
MIN_DOCS = 20           # a line in at most so many texts of a host is never removed
MAX_SHARE = 0.01        # of a host's texts
ENOUGH = 400            # a line in more texts of a host is removed by `keep_good`, however large the host is
DEPLETED = 0.5          # share of words a document must keep
SALTS = 16
_SYMBOLS = "#*$%&|<>"
_BLANKS = "\t\n\x0b\x0c\r "


def normalised(line: str) -> bytes:
    """A-Z lowered, ASCII white space joined into single spaces and trimmed."""
    return b" ".join(line.encode().lower().split())


def line_hash(line: bytes) -> int:
    return xxhash.xxh3_64_intdigest(line) >> 1


def _repeated_words(words: np.ndarray) -> int:
    """Words inside runs of three words that occur twice or more."""
    if len(words) < 4:
        return 0
    runs = ngram_hashes(words, 3)
    _, place, times = np.unique(runs, return_inverse=True, return_counts=True)
    if len(times) == len(runs):
        return 0
    hit = np.zeros(len(words), bool)
    at = np.flatnonzero(times[place] > 1)
    for i in range(3):
        hit[at + i] = True
    return int(hit.sum())


def base_counts(text: str) -> tuple[int, int, int, int, int]:
    """Words, code points in words, symbols, repeated lines, words in repeated 3-word windows."""
    words = word_hashes(text.encode())[2]
    seen, again = set(), 0
    for line in text.split("\n"):
        if line in seen:
            again += bool(line.strip(_BLANKS))
        else:
            seen.add(line)
    return (len(words), len(text) - sum(map(text.count, _BLANKS)), sum(map(text.count, _SYMBOLS)), again,
            _repeated_words(words))


def _lines(text: str) -> dict[int, int]:
    """Words held by each distinct normalised line, by its hash."""
    out: dict[int, int] = {}
    for line in text.split("\n"):
        line = normalised(line)
        if line:
            h = line_hash(line)
            out[h] = out.get(h, 0) + line.count(b" ") + 1
    return out


_PROFILE = ("doc_id long, host string, text_hash long, n_words long, word_chars long, n_symbols long, n_dup_lines long,"
            " n_repeat_words long, lines array<struct<h:long,w:int>>")


def _profile(batches):
    kind = pa.list_(pa.struct([("h", pa.int64()), ("w", pa.int32())]))
    names = ["doc_id", "host", "text_hash", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "lines"]
    for batch in batches:
        hashes, counts, lines = [], [], []
        for text in batch.column("text"):
            text = text.as_py() or ""
            hashes.append(xxhash.xxh3_64_intdigest(text.encode()) >> 1)
            counts.append(base_counts(text))
            lines.append([{"h": h, "w": w} for h, w in _lines(text).items()])
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), batch.column("host"), pa.array(hashes, pa.int64()),
             *[pa.array([c[i] for c in counts], pa.int64()) for i in range(5)], pa.array(lines, kind)], names)


def profile(docs: DataFrame, host: str = "source") -> DataFrame:
    """The written profile of `docs`, one row per row, numbered by `row_id`."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(host).cast("string").alias("host"), "text")
    return written(rows.mapInArrow(unburdened(_profile), _PROFILE).withColumn("row_id", F.monotonically_increasing_id()), "line-profile")


def frequent_lines(profiles: DataFrame, min_docs: int = MIN_DOCS, max_share: float = MAX_SHARE, enough: int | None = None) -> DataFrame:
    """(host, h, docs) of the lines that stand in more distinct texts of a host than the limit.

    The limit is `min_docs` or, if larger, `max_share` of the host's texts, but no more than `enough`.

    Equal texts count once, so exact copies neither raise a line's count nor a host's size.
    """
    texts = profiles.groupBy("host", "text_hash").agg(F.first("row_id").alias("row_id"))
    sizes = texts.groupBy("host").agg(F.count(F.lit(1)).alias("texts"))
    lines = (profiles.select("host", "text_hash", F.explode("lines.h").alias("h")).distinct()
             .groupBy("host", "h").agg(F.count(F.lit(1)).alias("docs")).filter(F.col("docs") > min_docs))
    above = F.col("docs") > max_share * F.col("texts")
    return lines.join(sizes, lines["host"].eqNullSafe(sizes["host"])).filter(
        above if enough is None else above | (F.col("docs") > enough)).select(lines["host"], "h", "docs")


def verdicts(profiles: DataFrame, frequent: DataFrame, depleted: float = DEPLETED) -> DataFrame:
    """Profiles without lines, with the words removed, and `kept`.

    A frequent line may stand in a third of all documents: it is copied to
    `SALTS` partitions and each document meets one of the copies.
    """
    salted = frequent.withColumn("_s", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    spread = profiles.select("row_id", "host", F.explode("lines").alias("l")).select(
        "row_id", F.col("host").alias("_host"), F.col("l.h").alias("_h"), "l.w", F.pmod(F.xxhash64("row_id"), F.lit(SALTS)).cast("int").alias("_t"))
    lost = spread.join(salted, spread["_host"].eqNullSafe(salted["host"]) & (F.col("_h") == F.col("h")) & (F.col("_t") == F.col("_s"))).groupBy(
        "row_id").agg(F.sum("w").alias("_lost"), F.collect_set("h").alias("removed_lines"))
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > REPEAT_SHARE * F.col("n_words"))
    left = F.col("n_words") - F.col("n_removed_words")
    return (profiles.drop("lines").join(lost, "row_id", "left").withColumn("n_removed_words", F.coalesce("_lost", F.lit(0)).cast("long"))
            .withColumn("base_failed", failed).withColumn("kept", ~failed & (left >= depleted * F.col("n_words"))).drop("_lost"))


def line_quality(docs: DataFrame, host: str = "source", min_docs: int = MIN_DOCS, max_share: float = MAX_SHARE,
                 depleted: float = DEPLETED, enough: int | None = None) -> DataFrame:
    """Base counts and verdict of every row of `docs`.

    A line is removed if more than `min_docs` and more than `max_share` of the
    distinct texts of its host have it, or more than max(`min_docs`, `enough`) if
    `enough` is given; without it the limit rises with the host. A document is rejected by the base rules or
    if fewer than `depleted` of its words are left. A null text has no words and
    fails the base rule; a null host is a host of its own; repeated rows come back
    as often as they stand there; other columns are not read.
    """
    p = profile(docs, host)
    return verdicts(p, frequent_lines(p, min_docs, max_share, enough), depleted)


def _strip(batches):
    for batch in batches:
        texts = []
        for text, removed in zip(batch.column("text").to_pylist(), batch.column("_q_removed").to_pylist(), strict=True):
            if removed:
                gone = set(removed)
                text = "\n".join(x for x in text.split("\n") if line_hash(normalised(x)) not in gone)
            texts.append(text)
        at = batch.schema.get_field_index("text")
        yield batch.set_column(at, batch.schema.field(at), pa.array(texts, pa.string()))


def keep_good(docs: DataFrame, host: str = "source") -> DataFrame:
    """Rows of `docs` that pass, without their frequent lines; a number in `n_chars` is brought up to date.

    Rows are matched by id, host and text, so repeated ids are no trouble; equal rows share their verdict.
    """
    found = line_quality(docs, host, enough=ENOUGH).filter("kept").groupBy(
        F.col("doc_id").alias("_q_doc"), F.col("host").alias("_q_host"), F.col("text_hash").alias("_q_text")).agg(
        F.first("removed_lines").alias("_q_removed"))

    def hashed(batches):
        for batch in batches:
            texts = batch.column("text").to_pylist()
            yield batch.append_column("_q_own", pa.array([xxhash.xxh3_64_intdigest((t or "").encode()) >> 1 for t in texts], pa.int64()))

    rows = docs.mapInArrow(unburdened(hashed), StructType([*docs.schema.fields, StructField("_q_own", LongType())]))
    joined = rows.join(found, F.col("doc_id").cast("long").eqNullSafe(F.col("_q_doc")) & F.col(host).cast("string").eqNullSafe(
        F.col("_q_host")) & (F.col("_q_own") == F.col("_q_text"))).select(*docs.columns, "_q_removed")
    clean = joined.mapInArrow(unburdened(_strip), joined.schema).drop("_q_removed")
    return clean.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else clean

