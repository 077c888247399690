"""Token ids in grammar-compressed files (Re-Pair), readable by document.

Documents are dealt to shards by ascending id. Each shard is cut into segments of a bounded
number of ids; a segment holds its own grammar: in every round its most frequent pairs of
symbols become new symbols, until no pair pays. A file row is one segment:

    shard, segment            place in the order of ids
    n_ids, first_doc, last_doc
    doc_ids, doc_lens         ids of the documents and their numbers of token ids, end id included
    doc_symbols               symbols that each document takes in `symbols`
    base                      number of the first rule
    rules                     pairs of symbols, little-endian uint32; rule k makes symbol base + k
    lengths                   token ids that each rule expands to, little-endian uint32
    symbols                   the compressed sequence, little-endian uint32

No symbol reaches over the end of a document, so a document is decoded from its own symbols alone,
and with the expansion lengths any range of ids is found without expanding what lies before.
"""

from __future__ import annotations

import hashlib
import os
import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

SEGMENT = 1 << 21        # token ids of a segment; a longer document has a segment of its own
ROUND_RULES = 1 << 13    # rules that one round adds at most
LEAST = 8                # occurrences from which a pair is worth a rule
ROUNDS = 24
LEAST_GAIN = 0.02        # a round that shortens the sequence by less is the last
CACHED_UNITS = 600_000   # units of a generation with their ids; a worker remembers two
BATCH_CHARS = 1 << 18    # characters of the texts that are encoded together
_BUCKETS = 1 << 20
_MARKS, _PLAIN_LETTERS = ".,;:!?", "\u0250"
_ODD_SPACE = re.compile(r" (?<=\s )")
_SPACE_BEHIND_WORD = re.compile(r"(?<=\S) ")


class UnitEncoder:
    """Encodes texts with a tokenizer of the tokenizers library; each unit between spaces is encoded once and remembered.

    A space that follows a character other than white space starts a new piece of a byte-level
    vocabulary, so texts can be cut there. Texts that hold an added token are encoded whole. Units are
    remembered in two generations: when the newer one is full, it becomes the older one, which is forgotten.
    """

    def __init__(self, spec: str, most: int = CACHED_UNITS):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(spec)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.marks = dict(zip(_MARKS, self.whole(list(_MARKS)), strict=True))
        self.most, self.bare, self.known, self.older = most, {}, {}, {}
        vocab = self.tokenizer.get_vocab(with_added_tokens=True)
        self.opens = np.zeros(max(vocab.values()) + 1, bool)
        space = self.tokenizer.encode(" ", add_special_tokens=False).tokens[0]
        self.opens[[i for token, i in vocab.items() if token.startswith(space)]] = True

    def whole(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian uint32, straight from the library."""
        found = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [np.array(e.ids, np.uint32).tobytes() for e in found]

    def _learn(self, known: dict, older: dict, units: list[str], before: str) -> None:
        """Add the ids of units that stand behind `before`, which `known` lacks."""
        new, marked = {}, []
        for u in units:
            if (packed := older.get(u)) is not None:
                known[u] = packed
            elif u[-1:] in _MARKS and (stem := u[:-1]).isalpha() and max(stem) < _PLAIN_LETTERS:
                # Letters and the mark behind them are pieces of their own.
                marked.append(u)
                if stem not in known:
                    if (packed := older.get(stem)) is not None:
                        known[stem] = packed
                    else:
                        new[stem] = None
            else:
                new[u] = None
        # Words behind one space are encoded together: the tokens that open with a space tell them apart.
        plain = [u for u in new if before and u and " " not in u]
        for start in range(0, len(plain), 256):
            some = plain[start:start + 256]
            packed = self.whole([before + before.join(some)])[0]
            at = (np.flatnonzero(self.opens[np.frombuffer(packed, np.uint32)]) * 4).tolist() + [len(packed)]
            known.update(zip(some, [packed[i:j] for i, j in zip(at, at[1:], strict=False)], strict=True))
        odd = [u for u in new if u not in known]
        known.update(zip(odd, self.whole([before + u for u in odd]), strict=True))
        for u in marked:
            known[u] = known[u[:-1]] + self.marks[u[-1]]

    def _look_up(self, cut: dict[int, list[str]], known: dict, older: dict, before: str) -> dict[int, list[bytes]]:
        get, found, missing = known.get, {}, set()
        for i, units in cut.items():
            found[i] = packed = list(map(get, units))
            if None in packed:
                missing.update([u for u, p in zip(units, packed, strict=True) if p is None])
        if missing:
            self._learn(known, older, list(missing), before)
            for i, packed in found.items():
                if None in packed:
                    found[i] = [known[u] if p is None else p for u, p in zip(cut[i], packed, strict=True)]
            for u in missing:
                if len(u) > 100:
                    del known[u]
        return found

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian uint32."""
        out, heads, rest = [b""] * len(texts), {}, {}
        added = {i for i, t in enumerate(texts) if any(a in t for a in self.added)}
        for i, packed in zip(added, self.whole([texts[i] for i in added]), strict=True):
            out[i] = packed
        for i, t in enumerate(texts):
            if t and i not in added:
                units = _SPACE_BEHIND_WORD.split(t) if t[0] == " " or _ODD_SPACE.search(t) else t.split(" ")
                heads[i] = [units[0]]
                rest[i] = units[1:]
        if len(self.known) + len(self.bare) > self.most:
            self.known, self.older, self.bare = {}, self.known, {}
        first = self._look_up(heads, self.bare, {}, "")
        for i, packed in self._look_up(rest, self.known, self.older, " ").items():
            out[i] = b"".join(first[i] + packed)
        return out


def _bucket(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    h = a * np.uint32(0x9E3779B1) ^ b * np.uint32(0x85EBCA77)
    return (h ^ (h >> np.uint32(15))) & np.uint32(_BUCKETS - 1)


def compress(ids: np.ndarray, ends: np.ndarray, base: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Re-Pair in rounds: (rules, lengths, symbols, ends); `ends` marks the last symbol of each document.

    A round counts all pairs inside documents and gives the most frequent ones a rule each. Where
    chosen pairs overlap, the more frequent one is replaced; in a run of one symbol every other one.
    """
    seq, ends = ids.astype(np.uint32), ends.copy()
    rules, next_symbol = [], base
    for _ in range(ROUNDS):
        if len(seq) < 2:
            break
        a, b, inside = seq[:-1], seq[1:], ~ends[:-1]
        bucket = _bucket(a, b)
        hot = np.bincount(bucket[inside], minlength=_BUCKETS)[bucket] >= LEAST
        place = np.flatnonzero(hot & inside)
        both, bucket = a[place].astype(np.uint64) << np.uint64(32) | b[place], bucket[place]
        pairs, times = np.unique(both, return_counts=True)
        order = np.argsort(-times, kind="stable")[:ROUND_RULES]
        pairs = pairs[order[times[order] >= LEAST]]
        if not len(pairs):
            break
        left, right = (pairs >> np.uint64(32)).astype(np.uint32), pairs.astype(np.uint32)
        owner = np.full(_BUCKETS, -1, np.int32)
        owner[_bucket(left, right)[::-1]] = np.arange(len(pairs), dtype=np.int32)[::-1]
        rank = owner[bucket]
        match = (rank >= 0) & (pairs[rank] == both)
        at, rank = place[match], rank[match]
        beside = at[1:] == at[:-1] + 1
        again = np.concatenate([[False], beside & (rank[1:] == rank[:-1])]) if len(at) else np.zeros(0, bool)
        if again.any():                                  # every other pair of a run of one symbol
            count = np.arange(len(at))
            other = (count - np.maximum.accumulate(np.where(again, 0, count)) & 1) == 0
            at, rank = at[other], rank[other]
            beside = at[1:] == at[:-1] + 1
        chosen = np.ones(len(at), bool)
        chosen[1:] &= ~(beside & (rank[1:] >= rank[:-1]))
        chosen[:-1] &= ~(beside & (rank[:-1] > rank[1:]))
        at, rank = at[chosen], rank[chosen]
        pays = np.bincount(rank, minlength=len(pairs)) >= LEAST // 2
        at, rank = at[pays[rank]], rank[pays[rank]]
        if len(at) < LEAST_GAIN * len(seq):
            break
        number = next_symbol + np.cumsum(pays, dtype=np.uint32) - 1
        next_symbol += int(pays.sum())
        rules.append(np.stack([left[pays], right[pays]], 1))
        stay = np.ones(len(seq), bool)
        stay[at + 1] = False
        seq[at] = number[rank]
        ends[at] = ends[at + 1]
        seq, ends = seq[stay], ends[stay]
    known = np.ones(next_symbol, np.uint32)
    at = base
    for some in rules:
        known[at:at + len(some)] = known[some[:, 0]] + known[some[:, 1]]
        at += len(some)
    lengths = known[base:]
    return np.concatenate(rules) if rules else np.zeros((0, 2), np.uint32), lengths, seq, ends


class Grammar:
    """Expands symbols of one segment."""

    def __init__(self, base: int, rules: bytes, lengths: bytes):
        self.base, pairs = base, np.frombuffer(rules, np.uint32).reshape(-1, 2)
        own = np.frombuffer(lengths, np.uint32).astype(np.int64)
        flat = np.arange(base, base + len(pairs), dtype=np.uint32)
        while len(more := np.flatnonzero(flat >= base)):
            width = np.ones(len(flat), np.int64)
            width[more] = 2
            place = np.cumsum(width) - width
            longer = np.empty(int(width.sum()), np.uint32)
            longer[place] = flat
            longer[place[more]], longer[place[more] + 1] = pairs[flat[more] - base].T
            flat = longer
        self.flat = np.concatenate([np.arange(base, dtype=np.uint32), flat])
        self.width = np.concatenate([np.ones(base, np.int64), own])
        self.start = np.concatenate([np.arange(base), base + np.cumsum(own) - own])

    def expand(self, symbols: np.ndarray) -> np.ndarray:
        width = self.width[symbols]
        last = np.cumsum(width)
        total = int(last[-1]) if len(last) else 0
        return self.flat[np.repeat(self.start[symbols] - (last - width), width) + np.arange(total)]

    def between(self, symbols: np.ndarray, start: int, stop: int) -> np.ndarray:
        """Ids `start` to `stop` of the sequence; only the symbols that they lie in are expanded."""
        last = np.cumsum(self.width[symbols])
        if stop <= start or not len(last):
            return np.zeros(0, np.uint32)
        i, j = np.searchsorted(last, start, "right"), np.searchsorted(last, min(stop, last[-1]), "left")
        skip = start - (int(last[i - 1]) if i else 0)
        return self.expand(symbols[i:j + 1])[skip:skip + stop - start]


SEGMENTS = ("shard int, segment int, n_ids long, first_doc long, last_doc long, doc_ids array<long>, doc_lens array<int>, "
            "doc_symbols array<int>, base int, rules binary, lengths binary, symbols binary")
_SEGMENT_TYPES = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int32()),
                  pa.list_(pa.int32()), pa.int32(), pa.binary(), pa.binary(), pa.binary()]
_SEGMENT_NAMES = [c.split()[0] for c in SEGMENTS.split(", ")]


def _segment(shard: int, number: int, docs: list, packed: list[bytes], base: int) -> pa.RecordBatch:
    lens = [len(p) // 4 for p in packed]
    ids = np.frombuffer(b"".join(packed), np.uint32)
    ends = np.zeros(len(ids), bool)
    ends[np.cumsum(lens) - 1] = True
    rules, lengths, symbols, ends = compress(ids, ends, base)
    per_doc = np.diff(np.flatnonzero(ends), prepend=-1)
    known = [d for d in docs if d is not None]
    row = [shard, number, len(ids), min(known, default=None), max(known, default=None), docs, lens, per_doc.tolist(), base,
           rules.tobytes(), lengths.tobytes(), symbols.tobytes()]
    return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, _SEGMENT_TYPES, strict=True)], _SEGMENT_NAMES)


_ready: dict = {}


def _encoder(key: str, spec) -> UnitEncoder:
    if key not in _ready:
        _ready.clear()
        _ready[key] = UnitEncoder(spec.value)
    return _ready[key]


def write_token_files(docs: DataFrame, path: str, vocabulary: str, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text",
                      segment: int = SEGMENT) -> None:
    """Encode every text, append `end_id`, and write the ids in ascending order of `id_col` below `path`.

    `vocabulary` is a file of the tokenizers library. Null texts are empty. Rows of equal ids stand in
    the order of their texts' hashes, rows without an id at the end; repeated rows are all written. A task
    holds one segment; a document beyond that takes about 60 bytes of memory an id. Other columns are not read.
    An empty table leaves a table without rows.
    """
    spark = docs.sparkSession
    with open(vocabulary, encoding="utf-8") as file:
        spec = spark.sparkContext.broadcast(file.read())
    base = max(UnitEncoder(spec.value).tokenizer.get_vocab(with_added_tokens=True).values()) + 1
    base, end, key = max(base, end_id + 1), np.uint32(end_id).tobytes(), hashlib.sha256(spec.value.encode()).hexdigest()

    def run(batches):
        encoder, shard, number = _encoder(key, spec), TaskContext.get().partitionId(), 0
        held_docs, held, size = [], [], 0
        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), batch.column(1)
            at = 0
            while at < len(ids):
                some, chars = [], 0
                while at + len(some) < len(ids) and chars < BATCH_CHARS:
                    some.append(texts[at + len(some)].as_py() or "")
                    chars += len(some[-1])
                for doc, packed in zip(ids[at:at + len(some)], encoder.encode(some), strict=True):
                    if held and size + len(packed) // 4 >= segment:
                        yield _segment(shard, number, held_docs, held, base)
                        held_docs, held, size, number = [], [], 0, number + 1
                    held_docs.append(doc)
                    held.append(packed + end)
                    size += len(packed) // 4 + 1
                at += len(some)
        if held:
            yield _segment(shard, number, held_docs, held, base)

    # The text's hash and the row's place split an id that many rows share.
    rows = docs.select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).alias("_text"), F.xxhash64(text_col).alias("_hash"),
                       F.monotonically_increasing_id().alias("_row"))
    keys = [F.col("_id").asc_nulls_last(), F.col("_hash").asc(), F.col("_row").asc()]
    rows = rows.repartitionByRange(*keys).sortWithinPartitions(*keys).select("_id", "_text")
    rows.mapInArrow(run, SEGMENTS).write.option("compression", "zstd").parquet(path)


def _documents(batches, with_ids: bool, wanted=None):
    names = ["shard", "segment", "place", "doc_id", "offset", "n_tokens", "ids_crc32"] + ["ids"] * with_ids
    types = [pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64()] + [pa.list_(pa.int32())] * with_ids
    for batch in batches:
        for row in batch.to_pylist():
            grammar, symbols = Grammar(row["base"], row["rules"], row["lengths"]), np.frombuffer(row["symbols"], np.uint32)
            lens, last = np.array(row["doc_lens"], np.int64), np.cumsum(row["doc_symbols"])
            offsets, out = np.cumsum(lens) - lens, [[] for _ in names]
            picked = [k for k, d in enumerate(row["doc_ids"]) if wanted is None or d in wanted]
            if wanted is None:
                whole = grammar.expand(symbols)
            for k in picked:
                if wanted is None:
                    ids = whole[offsets[k]:offsets[k] + lens[k]]
                else:
                    ids = grammar.expand(symbols[last[k] - row["doc_symbols"][k]:last[k]])
                values = [row["shard"], row["segment"], k, row["doc_ids"][k], offsets[k], lens[k], zlib.crc32(ids.astype("<u4").tobytes())]
                for column, v in zip(out, values + [ids] * with_ids, strict=True):
                    column.append(v)
            if picked:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types, strict=True)], names)


_DOCUMENTS = "shard int, segment int, place int, doc_id long, offset long, n_tokens long, ids_crc32 long"


def token_files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(SEGMENTS).parquet(path)


def segment_starts(files: DataFrame) -> DataFrame:
    """(shard, segment, first): token ids before each segment. Shards are summed first, so the ordering of all is over one row a shard."""
    parts = files.select("shard", "segment", "n_ids")
    shards = parts.groupBy("shard").agg(F.sum("n_ids").alias("n"))
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    shards = shards.select("shard", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    own = Window.partitionBy("shard").orderBy("segment").rowsBetween(Window.unboundedPreceding, -1)
    inside = parts.select("shard", "segment", F.coalesce(F.sum("n_ids").over(own), F.lit(0)).alias("inside"))
    return inside.join(shards, "shard").select("shard", "segment", (F.col("first") + F.col("inside")).alias("first"))


def read_documents(files: DataFrame, with_ids: bool = True) -> DataFrame:
    """One row per document of the files: doc_id, start (ids of all documents before it), n_tokens, ids_crc32 and, `with_ids`, ids."""
    schema = _DOCUMENTS + (", ids array<int>" if with_ids else "")
    rows = files.mapInArrow(lambda batches: _documents(batches, with_ids), schema).join(segment_starts(files), ["shard", "segment"])
    return rows.select("doc_id", (F.col("first") + F.col("offset")).alias("start"), "n_tokens", "ids_crc32", *["ids"] * with_ids)


def read_some(files: DataFrame, doc_ids: list[int]) -> DataFrame:
    """The token ids of single documents: file rows are skipped by their id ranges, of the others only these documents are expanded."""
    wanted = set(doc_ids)
    near = F.lit(False)
    for d in wanted:
        near = near | F.lit(d).between(F.col("first_doc"), F.col("last_doc"))
    rows = files.filter(near).mapInArrow(lambda batches: _documents(batches, True, wanted), _DOCUMENTS + ", ids array<int>")
    return rows.select("doc_id", "n_tokens", "ids_crc32", "ids")
