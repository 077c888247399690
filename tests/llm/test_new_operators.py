"""Periodic runs, ranked search and grammar-compressed token files against plain versions."""

import hashlib
import math
import random
import re
import tracemalloc
import zlib
from collections import Counter
from pathlib import Path

import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from barloom.llm import ranked, repair_files, runs, words
from barloom.llm.common import LARGE_ROWS, importable
from barloom.llm.queries import QUERIES, VOCABULARY

SCHEMA = "doc_id long, text string, runs string, term string, item string, _text string, _id long, block long, score double"
EXTRA = ("r", "t", "i", "x", 5, 6, 0.5)


def frame(spark, rows):
    importable(spark)
    return spark.createDataFrame([(i, t, *EXTRA) for i, t in rows], SCHEMA)


@pytest.fixture(scope="module")
def odd_rows():
    rnd = random.Random(5)
    words = [f"w{i}" for i in range(60)] + ["Über", "你好", "don't", "A1"]
    texts = [" ".join(rnd.choice(words) for _ in range(rnd.choice([3, 40, 300]))) for _ in range(60)]
    texts += [" ".join([" ".join(texts[0].split()[:7])] * 9) + " tail", "la " * 50, None, "", "  \n\t ", "x" * 20_000, "a  b\n\n c <|endoftext|> d"]
    texts += [" ".join(rnd.choice(words[:3]) for _ in range(30_000))]
    rows = list(enumerate(texts))
    return [*rows, rows[3], (4, "same id, other text"), (None, "no id at all"), (None, "no id, either w1 w2"), (None, None)]


# --- periodic runs

def plain_runs(words, least):
    """All maximal repetitions by comparing the text with itself, for every period."""
    found = []
    for q in range(1, len(words) // 2 + 1):
        same = [words[i] == words[i + q] for i in range(len(words) - q)] + [False]
        start = None
        for i, s in enumerate(same):
            if s and start is None:
                start = i
            elif not s and start is not None:
                n, a, start = i - start + q, start, None
                part = words[a:a + n]
                if n >= max(least, 2 * q) and not any(part[p:] == part[:-p] for p in range(1, q)):
                    found.append((a, n, q))
    return sorted(found, key=lambda r: (r[0], r[2]))


@pytest.mark.parametrize("least", [2, 5, 12])
def test_runs_equal_comparison_for_every_period(least):
    rnd = random.Random(least)
    for _ in range(400):
        letters, n = rnd.choice([1, 2, 3, 6]), rnd.randrange(70)
        words = [rnd.randrange(letters) for _ in range(n)]
        if rnd.random() < 0.5 and n:
            block = words[:rnd.randrange(1, 14)]
            words = words[:n // 3] + (block * 12)[:n] + words[n // 2:]
        assert runs.word_runs(words, least) == plain_runs(words, least), words


def test_runs_of_long_texts_and_deep_repeats():
    fib = ["a", "a b"]
    while len(fib[-1]) < 4000:
        fib.append(fib[-1] + " " + fib[-2])
    words = fib[-1].split()
    assert runs.word_runs(words) == plain_runs(words, 12)
    assert runs.word_runs(["z"] * 50_000) == [(0, 50_000, 1)]
    assert runs.word_runs([]) == [] and runs.word_runs(["a"] * 11) == []


def test_periodic_runs_query(spark, odd_rows, tmp_path):
    frame(spark, odd_rows[:70] + [r for r in odd_rows[70:] if len(r[1] or "") < 50_000]).write.parquet(f"{tmp_path}/documents.parquet")
    got = {(r.doc_id, r.collapsed_sha256): r for r in QUERIES["op11_periodic_runs"](spark, str(tmp_path)).collect()}
    n_changed = 0
    for doc, text in odd_rows:
        if len(text or "") >= 50_000:
            continue
        words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
        n = len(words)
        h = zlib.crc32(str(doc).encode()) if doc is not None else 1
        if h % 10 == 0 and n:
            n_changed += 1
            a = h // 10 % n
            p = 1 + (n - a) // (3 + h // 10 % 8)
            words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
        found = plain_runs(words, 12)
        keep = [w for i, w in enumerate(words) if not any(s + q <= i < s + m for s, m, q in found)]
        row = got[doc, hashlib.sha256(" ".join(keep).encode()).hexdigest()]
        best = min(found, key=lambda r: (-r[1], r[0], r[2]), default=(None, None, None))
        assert (row.n_runs, row.start, row.length, row.period) == (len(found), *best)
        assert row.exponent_milli == (1000 * best[1] // best[2] if found else None)
        assert row.runs_sha256 == hashlib.sha256("".join(f"{s},{m},{q}\n" for s, m, q in found).encode()).hexdigest()
    assert n_changed > 2


def test_periodic_runs_carry_other_columns(spark, odd_rows):
    docs = frame(spark, odd_rows)
    out = runs.periodic_runs(docs)
    assert set(out.columns) == set(docs.columns) | {"n_text_words", "collapsed"} and dict(out.dtypes)["runs"].startswith("array")
    assert out.count() == len(odd_rows)
    assert runs.periodic_runs(docs.filter("false")).collect() == []


# --- ranked search

def plain_search(rows, items, k):
    cut = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", "".join(c.lower() if c.isascii() else c for c in t or ""))
    docs = [(d, Counter(cut(t))) for d, t in rows]
    n_docs, n_terms = sum(bool(c) for _, c in docs), sum(sum(c.values()) for _, c in docs)
    df = Counter(t for _, c in docs for t in c)
    asked = {}
    for item, text in items:
        asked.setdefault(item, set()).update(cut(text))
    out = []
    for item, terms in asked.items():
        scored = []
        for d, c in docs:
            m = 100 - 50 + (50 * sum(c.values()) * n_docs) // n_terms if n_terms else 0
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 20 * m)) for t in terms if c[t])
            if s > 0:
                scored.append((-s, d is None, d or 0))
        out += [(item, r, None if none else d, -s) for r, (s, none, d) in enumerate(sorted(scored)[:k], 1)]
    return sorted(out, key=str)


@pytest.mark.parametrize("k, block_docs, opened, query_terms", [(50, 4096, 48, 1 << 18), (3, 7, 2, 9), (200, 16, 1, 40)])
def test_search_equals_scoring_every_document(spark, odd_rows, monkeypatch, k, block_docs, opened, query_terms):
    for name, value in (("BLOCK_DOCS", block_docs), ("OPENED", opened), ("QUERY_TERMS", query_terms)):
        monkeypatch.setattr(ranked, name, value)
    items = [(i, t) for i, t in enumerate(["w1 W2 w3 w3 über", "你好, w5! don't", None, "", "nowhere-else", "w9", " ".join(f"w{i}" for i in range(60))])]
    items += [(0, "w40"), (None, "w7 x")]
    found = ranked.search_documents(frame(spark, odd_rows).repartition(3), frame(spark, items).withColumnRenamed("doc_id", "item_id"), k)
    assert sorted([tuple(r) for r in found.collect()], key=str) == plain_search(odd_rows, items, k)


def test_search_of_empty_tables(spark, odd_rows):
    docs = frame(spark, odd_rows)
    items = docs.withColumnRenamed("doc_id", "item_id")
    assert ranked.search_documents(docs.filter("false"), items, 5).collect() == []
    assert ranked.search_documents(docs, items.filter("false"), 5).collect() == []
    assert ranked.search_documents(docs.withColumn("text", F.lit(None).cast("string")), items, 5).collect() == []


def test_index_is_written_and_read_a_few_blocks_at_once(spark, monkeypatch):
    """Spark reads up to 4096 rows of a row group at once, so a row group must not hold whatever a task indexes."""
    importable(spark)
    text = F.expr("array_join(transform(sequence(1, 50000), x -> hex(xxhash64(x, id))), ' ')")
    docs = spark.range(0, 40, 1, 1).select(F.col("id").alias("doc_id"), text.alias("text"))
    items = docs.limit(1).select(F.lit(7).alias("item_id"), F.substring("text", 1, 40).alias("text"))
    kept = []
    monkeypatch.setattr(ranked, "BLOCK_BYTES", 1 << 19)
    monkeypatch.setattr(ranked.Scratch, "drop", lambda self, *names: kept.extend(f"{self.home}/{n}" for n in names))
    found = ranked.search_documents(docs, items, 5)
    files = [f for d in kept for f in Path(d.removeprefix("file:")).glob("*.parquet")]
    groups = [m.row_group(i) for f in files for m in [pq.ParquetFile(f).metadata] for i in range(m.num_row_groups)]
    assert found.count() == 1 and sum(g.num_rows for g in groups) == 40
    assert max(g.total_byte_size for g in groups) < 3 * LARGE_ROWS["parquet.block.size"] < sum(g.total_byte_size for g in groups)


# --- token files

def test_encoder_equals_library():
    with open(VOCABULARY, encoding="utf-8") as file:
        encoder = repair_files.UnitEncoder(file.read(), most=50)
    rnd = random.Random(2)
    for _ in range(60):
        texts = ["".join(rnd.choice(" \n\t\x0b\x1c\x85\xa0　abé1'!.-<|>") for _ in range(rnd.randrange(40))) for _ in range(40)]
        texts += ["x<|endoftext|> y", "a b", ""]
        assert encoder.encode(texts) == encoder.whole(texts)


def test_grammar_round_trip():
    rnd = np.random.default_rng(1)
    for n, symbols in ((0, 5), (1, 5), (3000, 2), (20_000, 4), (20_000, 300), (5000, 1)):
        ids = rnd.integers(0, symbols, n).astype(np.uint32)
        ends = rnd.random(n) < 0.01
        ends[-1:] = True
        rules, lengths, seq, last = repair_files.compress(ids, ends, 1000)
        grammar = repair_files.Grammar(1000, rules.tobytes(), lengths.tobytes())
        assert (grammar.expand(seq) == ids).all() and last.sum() == ends.sum()
        for a, b in ((0, n), (n // 3, n // 2), (5, 5), (max(n - 3, 0), n)):
            assert (grammar.between(seq, a, b) == ids[a:b]).all()
        if n > 10 and symbols < 10:
            assert len(seq) < n / 2


@pytest.mark.parametrize("segment", [1 << 21, 500])
def test_token_files_hold_what_the_library_gives(spark, odd_rows, tmp_path, segment):
    repair_files.write_token_files(frame(spark, odd_rows).repartition(3), f"{tmp_path}/files", VOCABULARY, segment=segment)
    files = repair_files.token_files(spark, f"{tmp_path}/files")
    got = repair_files.read_documents(files).collect()
    library = Tokenizer.from_file(VOCABULARY)
    expected = [(d, [*library.encode(t or "", add_special_tokens=False).ids, 0]) for d, t in odd_rows]
    assert sorted((str(r.doc_id), list(r.ids)) for r in got) == sorted((str(d), ids) for d, ids in expected)
    at, order = 0, sorted(got, key=lambda r: r.start)
    for row in order:
        assert row.start == at and row.n_tokens == len(row.ids)
        assert row.ids_crc32 == zlib.crc32(np.array(row.ids, "<u4").tobytes())
        at += row.n_tokens
    ids = [r.doc_id for r in order]
    assert ids == sorted(ids, key=lambda d: (d is None, d or 0))
    some = {(r.doc_id, tuple(r.ids)) for r in repair_files.read_some(files, [0, 4, 61]).collect()}
    assert some == {(d, tuple(t)) for d, t in expected if d in (0, 4, 61)}


def test_token_files_of_an_empty_table(spark, odd_rows, tmp_path):
    repair_files.write_token_files(frame(spark, odd_rows).filter("false"), f"{tmp_path}/files", VOCABULARY)
    assert repair_files.read_documents(repair_files.token_files(spark, f"{tmp_path}/files")).collect() == []


# --- word hashes in pieces

def test_word_hashes_do_not_depend_on_pieces(monkeypatch):
    rnd = random.Random(4)
    raw = b" ".join(bytes(rnd.choice(b"abc\xc3") for _ in range(rnd.choice([1, 3, 9, 40, 200]))) for _ in range(300)) + b" \n\t end"
    whole = words.word_hashes(raw)
    for piece in (7, 64, 1000):
        monkeypatch.setattr(words, "PIECE", piece)
        monkeypatch.setattr(words, "_powers", {b: np.ones(1, np.uint64) for b in words._powers})
        assert all((a == b).all() for a, b in zip(whole, words.word_hashes(raw), strict=True))
        assert max(map(len, words._powers.values())) <= piece + 1


def test_a_text_of_50_mb_needs_little_memory():
    raw = b"some words of a long text \xc3\xa9 " * 1_800_000
    tracemalloc.start()
    starts, _, hashes = words.word_hashes(raw[:50_000_000])
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(starts) > 10_000_000 and len(np.unique(hashes)) <= 8
    assert peak < 16 * 3 * len(starts) + 200 * words.PIECE
    assert len(words.word_hashes(b"x" * 5_000_000)[0]) == 1
