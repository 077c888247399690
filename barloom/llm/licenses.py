"""License notices in whole texts, exact and with a few errors.

A text is brought to its words, lowered and joined by single spaces. A notice with at most
e edits is found in two steps: cut into e + 1 pieces, one of which must occur unharmed
(pigeonhole), its seeds are looked up by one Aho-Corasick pass; around each hit the
regex library's bounded-error matching decides, counts the edits and gives the span.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

import ahocorasick
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# The base phrases and labels are fixed by the contract; the others are the operator's own.
BASE = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}
NOTICES = {
    "released under the mit license": "mit",
    "permission is hereby granted free of charge to any person obtaining a copy": "mit",
    "licensed under the apache license version 2 0": "apache-2",
    "licensed under cc by nc 4 0": "cc-by-nc",
    "licensed under the gnu general public license version 3": "gpl-3",
    "licensed under the gnu general public license version 2": "gpl-2",
    "gnu lesser general public license": "lgpl",
    "gnu affero general public license": "agpl",
    "mozilla public license version 2 0": "mpl-2",
    "redistribution and use in source and binary forms": "bsd",
    "creative commons attribution 4 0 international license": "cc-by",
    "creative commons attribution sharealike": "cc-by-sa",
    "this is free and unencumbered software released into the public domain": "unlicense",
    "boost software license version 1 0": "bsl-1",
    "eclipse public license version 2 0": "epl-2",
    "all rights reserved": "all-rights-reserved",
}
ERROR_EVERY = 12     # one edit is allowed per so many characters of a notice
MAX_ERRORS = 4
# Everything but ASCII letters and digits and bytes of other characters parts words.
_KEEP = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))


def words_of(text: str) -> str:
    """The words of a text, A-Z lowered, one space before, between and behind them."""
    words = text.encode().translate(_KEEP).split()
    return f" {b' '.join(words).decode()} " if words else ""


@dataclass(frozen=True)
class Span:
    label: str
    notice: str
    first_word: int
    last_word: int
    edits: int


def allowed_errors(notice: str) -> int:
    return min(MAX_ERRORS, len(notice) // ERROR_EVERY)


@dataclass(frozen=True)
class Scanner:
    """Finds notices with at most `allowed_errors` edits; matches start and end at word boundaries."""

    notices: tuple[tuple[str, str], ...] = tuple(NOTICES.items())

    @cached_property
    def _compiled(self):
        seeds, patterns = ahocorasick.Automaton(), []
        held: dict[str, list] = {}
        for number, (notice, _) in enumerate(self.notices):
            e = allowed_errors(notice)
            patterns.append(regex.compile(f"(?b)(?<= )(?:{regex.escape(notice, special_only=True, literal_spaces=True)}){{e<={e}}}(?= )"))
            cuts = [round(i * len(notice) / (e + 1)) for i in range(e + 2)]
            for a, b in zip(cuts, cuts[1:], strict=False):
                held.setdefault(notice[a:b], []).append((number, a, len(notice), e))
        for seed, uses in held.items():
            seeds.add_word(seed, (len(seed), uses))
        seeds.make_automaton()
        return seeds, patterns

    def windows(self, words: str):
        """For each notice, the joined stretches of text in which a match can lie."""
        stretches: dict[int, list[list[int]]] = {}
        for end, (length, uses) in self._compiled[0].iter(words):
            start = end + 1 - length
            for number, offset, whole, e in uses:
                a, b = max(0, start - offset - e - 1), start - offset + whole + e + 1
                mine = stretches.setdefault(number, [])
                if mine and a <= mine[-1][1]:
                    mine[-1][1] = max(mine[-1][1], b)
                else:
                    mine.append([a, b])
        return stretches

    def spans(self, words: str) -> list[Span]:
        """All matches in the text that `words_of` made, at most one per notice and place."""
        out = []
        for number, stretches in self.windows(words).items():
            notice, label = self.notices[number]
            for a, b in stretches:
                # The best match comes first; what lies before and behind it is searched again.
                parts = [(a, b)]
                while parts:
                    low, high = parts.pop()
                    m = self._compiled[1][number].search(words, low, high)
                    if m and m.group().strip():
                        parts += [(low, m.start()), (m.end(), high)]
                        first = words.count(" ", 0, m.start()) - 1
                        out.append(Span(label, notice, first, first + m.group().count(" "), sum(m.fuzzy_counts)))
        return sorted(out, key=lambda s: (s.first_word, s.last_word, s.notice))


def base_places(words: str) -> list[tuple[int, str]]:
    """(start word, label) of every place where a base phrase's words stand consecutively."""
    out = []
    for phrase, label in BASE.items():
        at = words.find(f" {phrase} ")
        while at >= 0:
            out.append((words.count(" ", 0, at + 1) - 1, label))
            at = words.find(f" {phrase} ", at + 1)
    return out


_SPAN = pa.list_(pa.struct([("label", pa.string()), ("first_word", pa.int32()), ("last_word", pa.int32()), ("edits", pa.int32())]))
_SCHEMA = ("doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double,"
           " spans array<struct<label:string,first_word:int,last_word:int,edits:int>>")


def scan_licenses(docs: DataFrame, notices: dict[str, str] | None = None, text_col: str = "text") -> DataFrame:
    """Word count, places of base phrases, labels, score and spans of every row of `docs`.

    `score` is the best match: 1 less its edits per character of the notice, 1 for a
    base phrase, 0 without any. A null or empty text has no words and no labels. Each
    row is judged alone: order, ties and repeated rows make no difference. Other columns are not read.
    """
    table = tuple((notices or NOTICES).items())
    state: dict = {}

    def scan(batches):
        scanner = state.setdefault("scanner", Scanner(table))
        for batch in batches:
            rows = []
            for text in batch.column("text"):
                words = words_of(text.as_py() or "")
                base, spans = base_places(words), scanner.spans(words) if words else []
                starts = [a for a, _ in base]
                score = max([1.0 if base else 0.0, *(1 - s.edits / len(s.notice) for s in spans)])
                rows.append((max(words.count(" ") - 1, 0), len(base), min(starts, default=None), max(starts, default=None),
                             ",".join(sorted({x for _, x in base})), ",".join(sorted({x for _, x in base} | {s.label for s in spans})), score,
                             [{"label": s.label, "first_word": s.first_word, "last_word": s.last_word, "edits": s.edits} for s in spans]))
            kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64(), _SPAN]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *[pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)]],
                                             ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "spans"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(scan, _SCHEMA)
