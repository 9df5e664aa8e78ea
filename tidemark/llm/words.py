"""Words between blanks as 64-bit hashes, computed over the bytes of whole Arrow batches."""
from __future__ import annotations

import numpy as np

#: Longer words are hashed one by one; bytes are hashed in blocks.
LONG_WORD = 512
HASH_BLOCK = 1 << 19

_rng = np.random.default_rng(20240613)
_BYTE = _rng.integers(0, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
BASE = int(_rng.integers(2**61, 2**62)) * 2 + 1
_BLANK = np.zeros(256, bool)
_BLANK[[32, *range(9, 14)]] = True


def powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base % 2**64, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


_UP = powers(BASE, HASH_BLOCK + LONG_WORD + 1)
_DOWN = powers(pow(BASE, -1, 2**64), HASH_BLOCK + LONG_WORD + 1)


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xA0761D6478BD642F)
    return h ^ (h >> np.uint64(32))


def words_of(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start byte, end byte, row) of each word of some texts that stand end to end."""
    if not len(data):
        return (np.zeros(0, np.int64),) * 3
    ink = ~_BLANK[data]
    cut = np.zeros(len(data) + 1, bool)
    cut[offsets] = True
    starts = np.flatnonzero(ink & np.concatenate([[True], ~ink[:-1]]) | ink & cut[:-1])
    ends = np.flatnonzero(ink & np.concatenate([~ink[1:], [True]]) | ink & cut[1:]) + 1
    return starts, ends, np.searchsorted(offsets, starts, "right") - 1


def hash_words(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of each word's bytes; the same word has the same hash wherever it stands."""
    from xxhash import xxh64_intdigest

    out = np.empty(len(starts), np.uint64)
    size = ends - starts
    for base in range(0, len(data), HASH_BLOCK):
        lo, hi = np.searchsorted(starts, [base, base + HASH_BLOCK])
        if lo == hi:
            continue
        s = starts[lo:hi] - base
        e = s + np.minimum(size[lo:hi], LONG_WORD)
        sums = np.zeros(int(e.max()) + 1, np.uint64)
        np.cumsum(_BYTE[data[base:base + len(sums) - 1]] * _UP[:len(sums) - 1], out=sums[1:])
        out[lo:hi] = (sums[e] - sums[s]) * _DOWN[s]
    out = mixed(out + size.astype(np.uint64))
    for i in np.flatnonzero(size > LONG_WORD):
        out[i] = xxh64_intdigest(data[starts[i]:ends[i]].tobytes(), 7)
    return out
