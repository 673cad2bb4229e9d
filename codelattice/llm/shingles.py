"""Word shingles of whole texts as 64-bit hashes, by numpy over an Arrow batch's bytes at once.

Words are the runs of bytes other than space and tab to carriage return, with A-Z lower-cased. A
word's hash is a polynomial over its bytes, taken as a difference of prefix sums; a shingle's hash
mixes the hashes of its words. A pair of different shingles of two texts meets with a chance of
about 2**-64.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

WORDS = 5
MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
PLACES = np.array([0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3], np.uint64)
LOWER = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], np.uint8)
SPACE = np.array([b == 32 or 9 <= b <= 13 for b in range(256)])
_POWERS: list[np.ndarray] = []


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the multiplier, and of its inverse, for places up to n."""
    if not _POWERS or len(_POWERS[0]) < n:
        size = max(1 << 20, 1 << (n - 1).bit_length())
        inverse = np.uint64(pow(int(MULTIPLIER), -1, 1 << 64))
        _POWERS[:] = [np.cumprod(np.append(np.uint64(1), np.full(size - 1, m, np.uint64)), dtype=np.uint64) for m in (MULTIPLIER, inverse)]
    return _POWERS[0], _POWERS[1]


def word_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words, and where each text's words begin and the last text's end. Nulls have none."""
    texts = texts.cast(pa.large_string()).fill_null("")
    n = len(texts)
    if not n:
        return np.empty(0, np.uint64), np.zeros(1, np.int64)
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + n + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
    offsets = offsets - offsets[0]
    if not len(data):
        return np.empty(0, np.uint64), np.zeros(n + 1, np.int64)
    solid = ~SPACE[data]
    begin = solid.copy()
    begin[1:] &= ~solid[:-1]
    firsts = offsets[:-1][offsets[:-1] < len(data)]
    begin[firsts] = solid[firsts]
    end = solid.copy()
    end[:-1] &= ~solid[1:] | begin[1:]
    starts, ends = np.flatnonzero(begin), np.flatnonzero(end) + 1
    up, down = powers(len(data))
    sums = np.empty(len(data) + 1, np.uint64)
    sums[0] = 0
    np.cumsum((LOWER[data].astype(np.uint64) + np.uint64(1)) * up[: len(data)], out=sums[1:])
    hashes = mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64) * PLACES[0])
    return hashes, np.searchsorted(starts, offsets)


def shingle_hashes(words: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all shingles in order, and where each text's begin and the last's end.

    A text of one to four words has its whole sequence as its only shingle; one without words has none.
    """
    n, counts = len(words), np.diff(bounds)
    reach = max(0, n - WORDS + 1)
    total = np.zeros(reach, np.uint64)
    for k in range(WORDS):
        total += words[k : k + reach] * PLACES[k]
    owner_last = np.repeat(bounds[1:], counts)  # end of each word's text
    full = np.arange(reach) + WORDS <= owner_last[:reach]
    hashes, place = mix(total[full]), np.flatnonzero(full)
    short = np.flatnonzero((counts > 0) & (counts < WORDS))
    if len(short):
        extra = np.array([int(mix(np.array([(words[bounds[t] : bounds[t + 1]] * PLACES[: counts[t]]).sum(dtype=np.uint64) + np.uint64(counts[t])], np.uint64))[0]) for t in short], np.uint64)
        at = np.searchsorted(place, bounds[short])
        hashes, place = np.insert(hashes, at, extra), np.insert(place, at, bounds[short])
    return hashes, np.searchsorted(place, bounds)
