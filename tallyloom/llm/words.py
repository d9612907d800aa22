"""Vectorised word scanning, word hashes and shingle sets over Arrow text buffers."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

U = np.uint64
_BASE = 0x9C8F2D51B6A4E37D
_BASE_INVERSE = pow(_BASE, -1, 1 << 64)
_BLOCK = 1 << 20

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACED = np.ones(256, bool)
_SPACED[[9, 10, 11, 12, 13, 32]] = False
_LETTERS = np.zeros(256, bool)
_LETTERS[48:58] = _LETTERS[65:91] = _LETTERS[97:123] = _LETTERS[128:] = True


def _powers(base: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return np.cumprod(np.concatenate([[U(1)], np.full(_BLOCK - 1, U(base))]))


_POWER: dict[int, np.ndarray] = {}


def powers(base: int) -> np.ndarray:
    """First ``_BLOCK`` powers of ``base`` modulo 2**64."""
    if base not in _POWER:
        _POWER[base] = _powers(base)
    return _POWER[base]


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective 64-bit finaliser."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U(27))
    x = x * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


@dataclass
class Words:
    """Words of a chunk of documents: byte ranges, 64-bit hashes and where each document's words begin."""

    start: np.ndarray
    end: np.ndarray
    hash: np.ndarray
    first: np.ndarray  # documents + 1

    def count(self) -> np.ndarray:
        return np.diff(self.first)


def scan(data: np.ndarray, offs: np.ndarray, *, lower: bool, letters: bool = False) -> Words:
    """Words of each document ``data[offs[i]:offs[i+1]]``.

    A word is a longest run of bytes that are not ASCII white space, or, with
    ``letters``, of ASCII letters and digits and all non-ASCII bytes. With
    ``lower``, A-Z count as a-z in the hashes.
    """
    is_word = (_LETTERS if letters else _SPACED)[data]
    n = len(data)
    opens, closes = is_word.copy(), is_word.copy()
    if n:
        opens[1:] &= ~is_word[:-1]
        closes[:-1] &= ~is_word[1:]
        edges = offs[1:-1]
        inside = edges[(edges > 0) & (edges < n)]
        opens[inside] = is_word[inside]
        closes[inside - 1] = is_word[inside - 1]
    start = np.flatnonzero(opens)
    end = np.flatnonzero(closes) + 1
    return Words(start, end, hashes(data, start, end, lower), np.searchsorted(start, offs, side="left"))


def hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray, lower: bool) -> np.ndarray:
    """64-bit hash of each byte range, in blocks of bounded size."""
    out = np.empty(len(start), np.uint64)
    up, down = powers(_BASE), powers(_BASE_INVERSE)
    at = 0
    while at < len(start):
        low = start[at]
        to = max(at + 1, int(np.searchsorted(end, low + _BLOCK - 1, side="right")))
        high = end[to - 1]
        part = data[low:high]
        if lower:
            part = _LOWER[part]
        if len(part) < _BLOCK:
            sums = np.zeros(len(part) + 1, np.uint64)
            np.cumsum((part.astype(np.uint64) + U(1)) * up[: len(part)], out=sums[1:])
            s, e = start[at:to] - low, end[at:to] - low
            out[at:to] = mix((sums[e] - sums[s]) * down[s] + (e - s).astype(np.uint64) * U(0x9E3779B97F4A7C15))
        else:  # one word longer than a block
            total = U(0)
            with np.errstate(over="ignore"):
                for i in range(0, len(part), _BLOCK):
                    piece = part[i : i + _BLOCK].astype(np.uint64) + U(1)
                    total = mix(np.array([total + (piece * up[: len(piece)]).sum(dtype=np.uint64)]))[0]
                out[at] = mix(np.array([total + U(len(part))]))[0]
        at = to
    return out


def grams(word_hash: np.ndarray, k: int) -> np.ndarray:
    """Hash of each run of ``k`` consecutive words; ``len - k + 1`` of them."""
    n = len(word_hash) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.full(n, U(k))
    for i in range(k):
        out = mix(out * U(0xD6E8FEB86659FD93) + word_hash[i : i + n])
    return out


def shingle_sets(words: Words, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct ``k``-word shingle hashes of each document, flat, and their offsets.

    A document of fewer words, one at least, has its whole sequence as one shingle.
    """
    all_grams = grams(words.hash, k)
    sets, sizes = [], []
    for a, b in zip(words.first[:-1].tolist(), words.first[1:].tolist(), strict=True):
        if b - a >= k:
            own = np.unique(all_grams[a : b - k + 1])
        elif b > a:
            own = grams(words.hash[a:b], b - a)
        else:
            own = all_grams[:0]
        sets.append(own)
        sizes.append(len(own))
    flat = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
    return flat, np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
