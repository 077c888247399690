"""Byte-level BPE with a lexicon of frequent words.

The corpus is counted once for its frequent words. Their pieces, with the ids that the
merges give, are compiled into a minimal automaton in the shared folder; Spark hands the
file to every executor, whose workers map it into memory. A piece that is not in the
lexicon is merged exactly, so the lexicon changes the time and never the ids.
"""

from __future__ import annotations

import hashlib
import json
import re
import uuid
from array import array
from heapq import heapify, heappop, heappush
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.llm.common import held, shared_file
from barloom.llm.lexicon import Lexicon, compile_lexicon
from barloom.llm.words import word_hashes

LEXICON_WORDS = 50_000   # most frequent white-space words of the corpus that are compiled
CACHED_UNITS = 200_000   # units a worker remembers; emptied when full
# Fixed value: the pattern by which the public byte-level vocabularies cut texts into pieces.
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
LONG_PIECE = 200
OUT_BYTES = 1 << 24        # ids and texts of a batch that goes back to Spark
_ID = (1 << 32) - 1
_NONE = 1 << 90
_SPACE_INSIDE = re.compile(r"\s ")


def byte_alphabet() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    spare = iter(range(256, 512))
    own = {b: chr(b) for b in plain}
    return [own.get(b) or chr(next(spare)) for b in range(256)]


class Bpe:
    """Vocabulary and merges of a byte-level BPE file; encodes one piece, decodes ids."""

    def __init__(self, spec: dict):
        alphabet = byte_alphabet()
        back = {c: b for b, c in enumerate(alphabet)}
        vocab = spec["model"]["vocab"]
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        self.pieces = [b""] * (max([*vocab.values(), *self.special.values()]) + 1)
        for token, i in vocab.items():
            self.pieces[i] = bytes(back[c] for c in token) if all(c in back for c in token) else token.encode()
        for token, i in self.special.items():
            self.pieces[i] = token.encode()
        self.single = [vocab[alphabet[b]] for b in range(256)]
        self.merges = {}
        for rank, merge in enumerate(spec["model"]["merges"]):
            left, right = merge if isinstance(merge, list) else merge.split(" ")
            self.merges[vocab[left], vocab[right]] = rank << _ID.bit_length() | vocab[left + right]
        self.text = [str(i) for i in range(len(self.pieces))]

    def merge(self, piece: bytes) -> list[int]:
        """Apply the merges to one piece, always the earliest merge first, from the left."""
        ids = [self.single[b] for b in piece]
        if len(ids) > LONG_PIECE:
            return self._merge_long(ids)
        get = self.merges.get
        ranks = [get(p, _NONE) for p in zip(ids, ids[1:], strict=False)]
        while ranks:
            best = min(ranks)
            if best == _NONE:
                break
            i = ranks.index(best)
            ids[i:i + 2] = [best & _ID]
            del ranks[i]
            if i < len(ranks):
                ranks[i] = get((ids[i], ids[i + 1]), _NONE)
            if i:
                ranks[i - 1] = get((ids[i - 1], ids[i]), _NONE)
        return ids

    def _merge_long(self, ids: list[int]) -> list[int]:
        """The same with a heap of merges over linked places, for pieces of any length."""
        get, n = self.merges.get, len(ids)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, i) for i in range(n - 1) if (r := get((ids[i], ids[i + 1]), _NONE)) != _NONE]
        heapify(heap)
        while heap:
            rank, i = heappop(heap)
            j = after[i]
            if rank == _NONE or ids[i] < 0 or j >= n or get((ids[i], ids[j]), _NONE) != rank:
                continue
            ids[i], ids[j] = rank & _ID, -1
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                heappush(heap, (get((ids[i], ids[k]), _NONE), i))
            if (h := before[i]) >= 0:
                heappush(heap, (get((ids[h], ids[i]), _NONE), h))
        return [i for i in ids if i >= 0]

    def decode(self, ids) -> str:
        return b"".join(map(self.pieces.__getitem__, ids)).decode("utf-8", "replace")


class _Units(dict):
    """Remembered ids of units that stand behind `before`; unknown ones are worked out, all are forgotten when it is full.

    Ids are kept as packed bytes: small, joined in one go, and no work for the garbage collector.
    """

    def __init__(self, before: str, ids_of, most: int):
        super().__init__()
        self.before, self.ids_of, self.most = before, ids_of, most

    def __missing__(self, unit: str) -> bytes:
        ids = self.ids_of(self.before + unit)
        if len(unit) < 100:
            if len(self) >= self.most:
                self.clear()
            self[unit] = ids
        return ids


class Encoder:
    """Encodes whole texts; units between white space are looked up, then pieces, then merged."""

    def __init__(self, bpe: Bpe, lexicon: Lexicon | None, remember: int = CACHED_UNITS):
        self.bpe, self.lexicon = bpe, lexicon
        self.bare, self.spaced = _Units("", self.unit, remember // 4), _Units(" ", self.unit, remember)
        self.cut = regex.compile(PIECES)
        self.special = sorted(bpe.special, key=len, reverse=True)
        self.split = re.compile("(" + "|".join(map(re.escape, self.special)) + ")") if self.special else None

    def piece(self, raw: bytes) -> bytes:
        found = self.lexicon.get(raw) if self.lexicon else None
        return array("I", self.bpe.merge(raw) if found is None else found).tobytes()

    def unit(self, unit: str) -> bytes:
        if unit.isascii() and unit.removeprefix(" ").isalpha():
            return self.piece(unit.encode())
        pieces = self.cut.findall(unit)
        if len(pieces) == 1:
            return self.piece(unit.encode())
        # A word with a mark behind it shares the word's ids with the word alone.
        return b"".join([self.spaced[p[1:]] if p[0] == " " and len(p) > 1 and not p.isspace() else self.bare[p] for p in pieces])

    def _plain(self, text: str) -> np.ndarray:
        if not text:
            return np.zeros(0, np.uint32)
        # No piece reaches over a space that follows a non-space, so the text is cut there:
        # all spaces if each follows a non-space, otherwise at runs of white space.
        if text[0] == " " or _SPACE_INSIDE.search(text):
            packed = b"".join(map(self.bare.__getitem__, re.findall(r"\s*\S+|\s+", text)))
        else:
            first, *rest = text.split(" ")
            packed = self.bare[first] + b"".join(map(self.spaced.__getitem__, rest))
        return np.frombuffer(packed, np.uint32)

    def encode(self, text: str) -> list[int]:
        return self.packed(text).tolist()

    def packed(self, text: str) -> np.ndarray:
        """Ids of a text; strings of special tokens get their ids, as in the library's default."""
        if not any(s in text for s in self.special):
            return self._plain(text)
        parts = self.split.split(text)
        return np.concatenate([np.array([self.bpe.special[p]], np.uint32) if i % 2 else self._plain(p) for i, p in enumerate(parts)])


def frequent_words(docs: DataFrame, text_col: str = "text", most: int = LEXICON_WORDS) -> DataFrame:
    """(word, n): the `most` frequent white-space words of all texts."""
    def count(batches):
        for batch in batches:
            raws = [t.encode() for t in batch.column(0).to_pylist() if t]
            while raws:
                some, size = [], 0
                while raws and size < 1 << 22:
                    some.append(raws.pop())
                    size += len(some[-1])
                raw = b" ".join(some)
                starts, ends, hashes = word_hashes(raw)
                if len(hashes):
                    _, first, times = np.unique(hashes, return_index=True, return_counts=True)
                    words = [raw[a:b] for a, b in zip(starts[first].tolist(), ends[first].tolist(), strict=True)]
                    yield pa.RecordBatch.from_arrays([pa.array(words, pa.binary()), pa.array(times, pa.int64())], ["word", "n"])

    counts = docs.select(F.col(text_col)).mapInArrow(count, "word binary, n long").filter("length(word) < 64")
    return counts.groupBy("word").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "word").limit(most)


def load_spec(path: str) -> dict:
    with open(path, encoding="utf-8") as file:
        return json.load(file)


def build_lexicon(docs: DataFrame, bpe: Bpe, text_col: str = "text", most: int = LEXICON_WORDS) -> bytes:
    """Automaton of the pieces of the corpus's frequent words, after a space and at a line's start."""
    cut, entries = regex.compile(PIECES), {}
    for row in frequent_words(docs, text_col, most).collect():
        word = bytes(row.word).decode("utf-8", "replace")
        for piece in {p for unit in (word, " " + word) for p in cut.findall(unit)}:
            raw = piece.encode()
            if raw not in entries:
                entries[raw] = bpe.merge(raw)
    return compile_lexicon(entries)


def _encoder(name: str, spec) -> Encoder:
    return held(name, lambda: Encoder(Bpe(spec.value), Lexicon(SparkFiles.get(name))))


def publish_lexicon(spark: SparkSession, automaton: bytes) -> str:
    """Write the automaton to the shared folder and have Spark hand it to the executors; its name there."""
    name = f"lexicon-{uuid.uuid4().hex}.bin"
    spark.sparkContext.addFile(shared_file(spark, name, automaton))
    return name


def _column(values: list, kind: pa.DataType) -> pa.Array:
    if not pa.types.is_list(kind):
        return pa.array(values, kind)
    ends = np.cumsum([0, *map(len, values)])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate([*values, np.zeros(0, np.uint32)]).astype(np.int32)))


def encode_documents(docs: DataFrame, vocabulary: str, text_col: str = "text", most: int = LEXICON_WORDS,
                     with_ids: bool = True) -> DataFrame:
    """Rows of `docs` with `n_tokens`, `ids_sha256`, `decoded_sha256` and, `with_ids`, `ids` and `decoded`.

    `vocabulary` is a byte-level BPE file in the tokenizers library's format. The
    ids equal that library's for whole texts; null and empty texts have none.
    Existing columns of these names are replaced, all others are carried along.
    """
    spark, spec = docs.sparkSession, load_spec(vocabulary)
    name = publish_lexicon(spark, build_lexicon(docs, Bpe(spec), text_col, most))
    shared = spark.sparkContext.broadcast({"model": {"vocab": spec["model"]["vocab"], "merges": spec["model"]["merges"]},
                                           "added_tokens": spec.get("added_tokens", [])})
    added = {"n_tokens": pa.int64(), "ids_sha256": pa.string(), "decoded_sha256": pa.string()} | (
        {"ids": pa.list_(pa.int32()), "decoded": pa.string()} if with_ids else {})
    rest = docs.select(*[c for c in docs.columns if c not in added])

    def run(batches):
        encoder = _encoder(name, shared)
        numbers, decode = encoder.bpe.text, encoder.bpe.decode
        for batch in batches:
            texts, at = batch.column(text_col), 0
            while at < batch.num_rows:
                first, size, out = at, 0, {k: [] for k in added}
                while at < batch.num_rows and size < OUT_BYTES:
                    packed = encoder.packed(texts[at].as_py() or "")
                    ids = packed.tolist()
                    decoded = decode(ids)
                    out["n_tokens"].append(len(ids))
                    out["ids_sha256"].append(hashlib.sha256(",".join(map(numbers.__getitem__, ids)).encode()).hexdigest())
                    out["decoded_sha256"].append(hashlib.sha256(decoded.encode()).hexdigest())
                    if with_ids:
                        out["ids"].append(packed)
                        out["decoded"].append(decoded)
                        size += 5 * len(ids) + len(decoded)
                    at += 1
                yield pa.RecordBatch.from_arrays([*batch.slice(first, at - first).columns, *[_column(out[k], t) for k, t in added.items()]],
                                                 [*batch.schema.names, *added])

    kinds = {"n_tokens": "long", "ids_sha256": "string", "decoded_sha256": "string", "ids": "array<int>", "decoded": "string"}
    schema = rest.limit(0).select("*", *[F.lit(None).cast(kinds[k]).alias(k) for k in added]).schema
    return rest.mapInArrow(run, schema)

