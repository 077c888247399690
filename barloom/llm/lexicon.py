"""A minimal acyclic automaton that maps words to numbers, in one flat byte string.

States with the same continuations are one state, so common endings are stored
once. Every arc carries a number; the numbers on a word's path add up to the word's
rank among the sorted words, which finds the word's ids in a table behind the arcs.
"""

from __future__ import annotations

import mmap
import struct
from array import array


_BYTES = [bytes([b]) for b in range(256)]


def compile_lexicon(entries: dict[bytes, list[int]]) -> bytes:
    """The automaton of all words of `entries` with their ids."""
    register: dict[tuple, int] = {}
    sizes: list[int] = []            # words below a state
    states: list[tuple] = []         # (final, ((label, target), ...))

    def settle(final, arcs):
        key = (final, tuple(arcs))
        if key not in register:
            register[key] = len(states)
            states.append(key)
            sizes.append(final + sum(sizes[t] for _, t in arcs))
        return register[key]

    # The open path: one [final, arcs] per byte of the word read last; arcs of settled states only.
    path, word_before, words = [[False, []]], b"", sorted(entries)

    def close(depth):
        while len(path) > depth + 1:
            final, arcs = path.pop()
            path[-1][1].append((word_before[len(path) - 1], settle(final, arcs)))

    for word in words:
        same = 0
        while same < min(len(word), len(word_before)) and word[same] == word_before[same]:
            same += 1
        close(same)
        path.extend([False, []] for _ in word[same:])
        path[-1][0] = True
        word_before = word
    close(0)
    start = settle(*path[0])

    offsets, labels, targets, adds, finals = array("I", [0]), bytearray(), array("I"), array("I"), bytearray()
    for final, arcs in states:
        finals.append(final)
        rank = int(final)
        for label, target in arcs:
            labels.append(label)
            targets.append(target)
            adds.append(rank)
            rank += sizes[target]
        offsets.append(len(labels))
    firsts, ids = array("I", [0]), array("I")
    for word in words:
        ids.extend(entries[word])
        firsts.append(len(ids))
    labels.extend(b"\0" * (-len(labels) % 4))
    finals.extend(b"\0" * (-len(finals) % 4))
    parts = [offsets.tobytes(), bytes(labels), targets.tobytes(), adds.tobytes(), bytes(finals), firsts.tobytes(), ids.tobytes()]
    return struct.pack("<8I", start, *map(len, parts)) + b"".join(parts)


class Lexicon:
    """Looks words up in a compiled automaton without loading it: the file is mapped into memory."""

    def __init__(self, path: str):
        with open(path, "rb") as file:
            self.map = mmap.mmap(file.fileno(), 0, access=mmap.ACCESS_READ)
        start, *sizes = struct.unpack_from("<8I", self.map)
        at, view, places = 32, memoryview(self.map), []
        for size in sizes:
            places.append(at)
            at += size
        take = lambda k: view[places[k]:places[k] + sizes[k]].cast("I")
        self.start, self.labels, self.final = start, places[1], places[4]
        self.offsets, self.targets, self.adds, self.firsts, self.ids = map(take, (0, 2, 3, 5, 6))

    def get(self, word: bytes) -> list[int] | None:
        """Ids of `word`, or None if it is not in the lexicon."""
        state, rank, find, base, offsets = self.start, 0, self.map.find, self.labels, self.offsets
        for byte in word:
            at = find(_BYTES[byte], base + offsets[state], base + offsets[state + 1]) - base
            if at < 0:
                return None
            rank += self.adds[at]
            state = self.targets[at]
        if not self.map[self.final + state]:
            return None
        return self.ids[self.firsts[rank]:self.firsts[rank + 1]].tolist()
