"""Words and word n-grams of one text as 64-bit hashes, by whole-array arithmetic."""

from __future__ import annotations

import numpy as np

_SPACE = np.zeros(256, dtype=bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
PIECE = 1 << 20   # bytes that are hashed at once
_ODD = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(int(_ODD), -1, 1 << 64))
_powers = {_ODD: np.ones(1, dtype=np.uint64), _INVERSE: np.ones(1, dtype=np.uint64)}


def mix(x: np.ndarray) -> np.ndarray:
    """Spread every input bit over all output bits."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * _ODD)


def _power(base: np.uint64, n: int) -> np.ndarray:
    """At least the first `n` powers of an odd number, modulo 2**64; `n` is at most `PIECE`."""
    if len(_powers[base]) < n:
        _powers[base] = np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(min(2 * n, PIECE), base)]))
    return _powers[base]


def _piece_hashes(data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    blank = np.ones(len(data) + 2, dtype=bool)
    blank[1:-1] = _SPACE[data]
    edges = np.flatnonzero(blank[1:] != blank[:-1])
    starts, ends = edges[::2], edges[1::2]
    if not len(starts):
        return starts, ends, np.zeros(0, np.uint64)
    sums = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum(_BYTE[data] * _power(_ODD, len(data))[:len(data)], out=sums[1:])
    own = (sums[ends] - sums[starts]) * _power(_INVERSE, len(data))[starts]
    return starts, ends, mix(own + (ends - starts).astype(np.uint64))


def _long_word_hash(data: np.ndarray) -> np.uint64:
    """Hash of one word of any length, piece by piece."""
    own, far = 0, 1
    for at in range(0, len(data), PIECE):
        some = data[at:at + PIECE]
        own += far * int((_BYTE[some] * _power(_ODD, len(some))[:len(some)]).sum(dtype=np.uint64))
        far = far * pow(int(_ODD), len(some), 1 << 64) % (1 << 64)
    return mix(np.array([(own + len(data)) % (1 << 64)], np.uint64))[0]


def word_hashes(raw: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and hash of each run of bytes other than ASCII white space.

    A word's hash is a polynomial in its bytes: differences of running sums over
    the text, brought back to the word's own start by an inverse power. Long texts
    are taken in pieces cut at white space, so the work needs memory for the words
    and for one piece, whatever the text's length.
    """
    data = np.frombuffer(raw, dtype=np.uint8)
    if len(data) <= PIECE:
        return _piece_hashes(data)
    found, at = [], 0
    while at < len(data):
        stop = min(at + PIECE, len(data))
        if stop < len(data):
            blanks = np.flatnonzero(_SPACE[data[at:stop]])
            if not len(blanks):                          # inside a word that is longer than a piece
                while stop < len(data) and not _SPACE[data[stop]]:
                    ahead = np.flatnonzero(_SPACE[data[stop:stop + PIECE]])
                    stop += int(ahead[0]) if len(ahead) else min(PIECE, len(data) - stop)
                found.append((np.array([at]), np.array([stop]), np.array([_long_word_hash(data[at:stop])], np.uint64)))
                at = stop
                continue
            stop = at + int(blanks[-1]) + 1
        starts, ends, hashes = _piece_hashes(data[at:stop])
        found.append((starts + at, ends + at, hashes))
        at = stop
    return tuple(np.concatenate(c) for c in zip(*found, strict=True))


def ngram_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """Hash of every run of `n` words; of the whole sequence if there are fewer; none without words."""
    if not len(words):
        return words
    n = min(n, len(words))
    out = np.full(len(words) - n + 1, n, dtype=np.uint64)
    for i in range(n):
        out = (out ^ words[i:len(words) - n + 1 + i]) * _ODD
        out ^= out >> np.uint64(32)
    return mix(out)
