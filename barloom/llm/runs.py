"""Periodic runs of words: suffix automaton and link-cut access.

For every appended word the path from its prefix to the root of the suffix links is recoloured
with the word's place. The path falls into segments of one colour: the last place where the
segment's suffixes ended before. If the distance from there is at most the longest length of the
segment, the suffix is a square of that period; extended to the right it is a run, and its left
end is maximal already, because the segment's longest length is all that both places share.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LEAST_LENGTH = 12
OUT_BYTES = 1 << 24
_ODD = np.uint64(0x9E3779B97F4A7C15)


def suffix_automaton(words: list[int]) -> tuple[list[int], list[int], list[int]]:
    """(longest length and suffix link of each state, state of each prefix); state 0 is the empty word, its link is -1."""
    arcs, length, link, prefixes, last = [{}], [0], [-1], [], 0
    for n, w in enumerate(words, 1):
        state = len(length)
        arcs.append({})
        length.append(n)
        link.append(0)
        p = last
        while p >= 0 and w not in arcs[p]:
            arcs[p][w] = state
            p = link[p]
        if p >= 0:
            q = arcs[p][w]
            if length[q] != length[p] + 1:
                clone = len(length)
                arcs.append(arcs[q].copy())
                length.append(length[p] + 1)
                link.append(link[q])
                link[q] = clone
                while p >= 0 and arcs[p].get(w) == q:
                    arcs[p][w] = clone
                    p = link[p]
                q = clone
            link[state] = q
        prefixes.append(state)
        last = state
    return length, link, prefixes


class LinkCutTree:
    """Paths of one colour in a rooted tree, each a splay tree by depth; its splay root knows the colour.

    Nodes are numbered from 1; 0 stands for none.
    """

    def __init__(self, parents: list[int]):
        self.up, self.left, self.right = parents, [0] * len(parents), [0] * len(parents)
        self.colour = [-1] * len(parents)

    def splay(self, x: int) -> None:
        up, left, right, colour = self.up, self.left, self.right, self.colour
        while True:
            p = up[x]
            if not p:
                return
            on_left = left[p] == x
            if not on_left and right[p] != x:
                return
            g = up[p]
            zig = bool(g) and (left[g] == p or right[g] == p)
            if zig and (left[g] == p) == on_left:      # the same side twice: p goes over g first
                if on_left:
                    left[g] = c = right[p]
                    right[p] = g
                else:
                    right[g] = c = left[p]
                    left[p] = g
                if c:
                    up[c] = g
                k, up[g], up[p] = up[g], p, up[g]
                if k:
                    if left[k] == g:
                        left[k] = p
                    elif right[k] == g:
                        right[k] = p
                colour[p] = colour[g]
                g, zig = k, False
            if on_left:
                left[p] = c = right[x]
                right[x] = p
            else:
                right[p] = c = left[x]
                left[x] = p
            if c:
                up[c] = p
            g, up[p], up[x] = up[p], x, up[p]
            if g:
                if left[g] == p:
                    left[g] = x
                elif right[g] == p:
                    right[g] = x
            colour[x] = colour[p]

    def access(self, x: int, colour: int) -> list[tuple[int, int]]:
        """Give the path from `x` to the root one colour; (lowest node, colour before) of each segment on it, from below."""
        up, right, colours, below, segments = self.up, self.right, self.colour, 0, []
        while x:
            self.splay(x)
            segments.append((x, colours[x]))
            if right[x]:
                colours[right[x]] = colours[x]         # what hangs below keeps its colour
            right[x] = below
            below, x = x, up[x]
        colours[below] = colour
        return segments


def stretch_runs(words: list[int]) -> list[tuple[int, int, int]]:
    """(start, length, period) of all maximal repetitions of at least two periods; `words` are numbers."""
    length, link, prefixes = suffix_automaton(words)
    tree = LinkCutTree([0, *[p + 1 for p in link]])
    n, found, known_to = len(words), [], {}
    for i, state in enumerate(prefixes):
        for node, before in tree.access(state + 1, i):
            period, shared = i - before, length[node - 1]
            if before < 0 or period > shared or known_to.get(period, -1) >= i:
                continue
            stop = i + 1
            while stop < n and words[stop] == words[stop - period]:
                stop += 1
            known_to[period] = stop - 1
            start = before - shared + 1
            found.append((start, stop - start, period))
    return found


def repeated_stretches(words: np.ndarray, least: int = LEAST_LENGTH) -> list[tuple[int, int]]:
    """Stretches outside which no run of `least` words can lie.

    In a run of period q and at least max(least, 2 q) words, every word lies in a gram of least / 2
    words that stands again q words away, in the same run. Words without such a gram are left out,
    until nothing changes.
    """
    gram, todo, done = (least + 1) // 2, [(0, len(words))], []
    while todo:
        a, b = todo.pop()
        if b - a < least:
            continue
        part = words[a:b]
        hashes = np.zeros(b - a - gram + 1, np.uint64)
        for k in range(gram):
            hashes = (hashes ^ part[k:k + len(hashes)]) * _ODD
            hashes ^= hashes >> np.uint64(29)
        order = np.argsort(hashes, kind="stable")
        same = hashes[order[1:]] == hashes[order[:-1]]
        starts = np.zeros(b - a + 1, np.int32)
        twice = np.union1d(order[1:][same], order[:-1][same])
        if not len(twice):
            continue
        np.add.at(starts, twice, 1)
        np.add.at(starts, twice + gram, -1)
        covered = np.concatenate([[False], np.cumsum(starts[:-1]) > 0, [False]])
        edges = np.flatnonzero(covered[1:] != covered[:-1])
        pieces = [(a + int(i), a + int(j)) for i, j in zip(edges[::2], edges[1::2], strict=True)]
        if pieces == [(a, b)]:
            done.append((a, b))
        else:
            todo.extend(pieces)
    return sorted(done)


def word_runs(words: list, least: int = LEAST_LENGTH) -> list[tuple[int, int, int]]:
    """Runs of at least max(least, 2 periods) words, by start, then period."""
    number: dict = {}
    ids = [number.setdefault(w, len(number)) for w in words]
    out = []
    for a, b in repeated_stretches(np.array(ids, np.uint64), least):
        out += [(a + s, n, q) for s, n, q in stretch_runs(ids[a:b]) if n >= least]
    return sorted(out, key=lambda r: (r[0], r[2]))


def collapsed(words: list, runs: list[tuple[int, int, int]]) -> list:
    """`words` without those that stand in a run behind its first period."""
    if not runs:
        return words
    drop = np.zeros(len(words), bool)
    for start, n, period in runs:
        drop[start + period:start + n] = True
    return [w for w, gone in zip(words, drop.tolist(), strict=True) if not gone]


def periodic_runs(docs: DataFrame, text_col: str = "text", least: int = LEAST_LENGTH) -> DataFrame:
    """Rows of `docs` with `n_text_words`, `runs` (start, length, period by start, then period) and `collapsed`.

    Words are what stands between ASCII white space. A run is as long as at least `least` words and two
    periods; `collapsed` is the text without the words behind the first period of a run, joined by one
    space. Null and empty texts have no words, no runs and an empty `collapsed`. Existing columns of these
    names are replaced, all others are carried along. A text needs about 100 bytes of memory a word, and
    a kilobyte for each word of its longest repetitive stretch.
    """
    names = ["n_text_words", "runs", "collapsed"]
    rest = docs.select(*[c for c in docs.columns if c not in names])
    kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))

    def run(batches):
        for batch in batches:
            texts, at = batch.column(text_col), 0
            while at < batch.num_rows:
                first, size, counts, runs, kept = at, 0, [], [], []
                while at < batch.num_rows and size < OUT_BYTES:
                    words = (texts[at].as_py() or "").encode().split()
                    found = word_runs(words, least)
                    counts.append(len(words))
                    runs.append([{"start": s, "length": n, "period": q} for s, n, q in found])
                    kept.append(b" ".join(collapsed(words, found)))
                    size += len(kept[-1])
                    at += 1
                new = [pa.array(counts, pa.int64()), pa.array(runs, kind), pa.array(kept, pa.binary()).cast(pa.string())]
                yield pa.RecordBatch.from_arrays([*batch.slice(first, at - first).columns, *new], [*batch.schema.names, *names])

    kinds = {"n_text_words": "long", "runs": "array<struct<start:long,length:long,period:long>>", "collapsed": "string"}
    schema = rest.limit(0).select("*", *[F.lit(None).cast(t).alias(c) for c, t in kinds.items()]).schema
    return rest.mapInArrow(run, schema)
