"""Words of Arrow text columns as 64-bit hashes, over whole batches with numpy.

A word is a run of bytes other than space and 0x09-0x0D. Its hash is a sum of scrambled (byte, place) values, and the hash
of a run of words is built by scrambled joins of shorter runs; neither is a polynomial, so regular texts don't collide.
There are independent lanes of the hash. Where equal hashes stand for equal texts in a result, callers compare two lanes
(128 bits) or say what they compare.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np

_BASE, _STEP = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)
#: Places of a word whose scrambled values are looked up; later ones are computed.
_PLACES = 64


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit (the public splitmix64 finaliser)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def _scrambled(codes: np.ndarray, lane: int) -> np.ndarray:
    """One value for each (place * 256 + byte), as if drawn at random."""
    return mix(mix(codes * _BASE + np.uint64(2 * lane + 1)) ^ _STEP)


@lru_cache(maxsize=4)
def _letters(lane: int) -> np.ndarray:
    return _scrambled(np.arange(256 * _PLACES, dtype=np.uint64), lane)


@lru_cache(maxsize=1)
def _lower() -> np.ndarray:
    codes = np.arange(256, dtype=np.uint8)
    codes[65:91] += 32
    return codes


_BLANK = np.zeros(256, bool)
_BLANK[[0x20, 9, 10, 11, 12, 13]] = True


def span_hashes(data: np.ndarray, sizes: np.ndarray, lanes: int = 1) -> list[np.ndarray]:
    """For each lane the hashes of consecutive spans of data, of the given sizes (none is empty), that fill it."""
    if not len(sizes):
        return [np.zeros(0, np.uint64)] * lanes
    begin = np.cumsum(sizes) - sizes
    place = np.arange(len(data)) - np.repeat(begin, sizes)
    code = (place << 8) | data
    late = np.flatnonzero(place >= _PLACES)
    code_late = code[late].astype(np.uint64)
    code[late] = 0
    out = []
    for lane in range(lanes):
        values = _letters(lane)[code]
        values[late] = _scrambled(code_late, lane)
        out.append(mix(np.add.reduceat(values, begin) + sizes.astype(np.uint64)))
    return out


def word_hashes(offsets: np.ndarray, data: np.ndarray, fold: bool = False, lanes: int = 1) -> tuple[list[np.ndarray], np.ndarray]:
    """(for each lane the hash of every word, first word of every text: n + 1 long). fold: A-Z count as a-z."""
    n = len(data)
    first = np.zeros(len(offsets), np.int64)
    if not n:
        return [np.zeros(0, np.uint64)] * lanes, first
    solid = ~_BLANK[data]
    cuts = offsets[1:-1]
    cuts = cuts[cuts < n]
    begins = solid.copy()
    begins[1:] &= ~solid[:-1]
    begins[cuts] = solid[cuts]
    ends = solid.copy()
    ends[:-1] &= ~solid[1:]
    inner = cuts[cuts > 0] - 1
    ends[inner] = solid[inner]
    start, end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    letters = data[solid]
    return span_hashes(_lower()[letters] if fold else letters, end - start, lanes), np.searchsorted(start, offsets, "left")


def _joined(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    return mix(mix(left + _BASE) + right * _STEP)


def runs(words: np.ndarray, k: int) -> np.ndarray:
    """The hash of each k consecutive words (of one text or over two: the caller drops the latter)."""
    if len(words) < k:
        return np.zeros(0, np.uint64)
    out, have = words, 1
    for bit in bin(k)[3:]:
        out, have = _joined(out[: len(out) - have], out[have:]), 2 * have
        if bit == "1":
            out, have = _joined(out[: len(out) - 1], words[have:]), have + 1
    return out


def whole(words: np.ndarray, first: np.ndarray) -> np.ndarray:
    """One hash for the word sequence of each text."""
    counts = np.diff(first)
    out = np.zeros(len(counts), np.uint64)
    filled = np.flatnonzero(counts)
    if len(filled):
        place = np.arange(len(words)) - np.repeat(first[:-1], counts)
        out[filled] = np.add.reduceat(mix(words ^ mix(place.astype(np.uint64) * _BASE + _STEP)), first[:-1][filled])
    return mix(out + counts.astype(np.uint64))


def run_starts(first: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(start word of each run of k words that lies in one text, number of such runs of each text)."""
    counts = np.maximum(np.diff(first) - k + 1, 0)
    total = int(counts.sum())
    before = np.cumsum(counts) - counts
    return np.arange(total) + np.repeat(first[:-1] - before, counts), counts
