"""Content-defined anchors: which stretches of text can hold a string of `length` bytes that also starts elsewhere.

Every window of `length` bytes picks the smallest-hashed gram of `gram` bytes in it (the leftmost of equals). Equal windows pick
the same gram at the same place, so a window can repeat only if its anchor's hash does. The windows that pick one anchor start
at consecutive positions; together they cover one segment of text, of which a hash is kept as well.
"""

from __future__ import annotations

import numpy as np

_SMALL = np.uint64(24)  # low bits that hold positions: a slice has under 2^24 bytes


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class RangeHasher:
    """Hashes of arbitrary byte ranges of one buffer, from prefix sums of byte * base^i (modulo 2^64)."""

    def __init__(self, base: int = 0x9E3779B97F4A7C15):
        self.base, self.inverse_base = base, pow(base, -1, 1 << 64)
        self.power, self.inverse = np.ones(1, np.uint64), np.ones(1, np.uint64)
        self.total = np.zeros(1, np.uint64)

    def load(self, data: np.ndarray) -> RangeHasher:
        n = len(data)
        if n >= len(self.power):
            for name, base in (("power", self.base), ("inverse", self.inverse_base)):
                steps = np.full(n + 1, base, np.uint64)
                steps[0] = 1
                setattr(self, name, np.cumprod(steps))
        self.total = np.concatenate((np.zeros(1, np.uint64), np.cumsum((data.astype(np.uint64) + np.uint64(1)) * self.power[:n])))
        return self

    def __call__(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.total[end] - self.total[start]) * self.inverse[start])

    def all_of(self, size: int) -> np.ndarray:
        """The hash of the `size` bytes from each position."""
        n = len(self.total) - size
        return mix((self.total[size:] - self.total[:n]) * self.inverse[:n]) if n > 0 else np.zeros(0, np.uint64)


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """Minimum of each `w` consecutive values, by prefix and suffix minima of blocks of `w`."""
    n = len(x)
    if n < w:
        return np.zeros(0, x.dtype)
    full = np.concatenate((x, np.full(-n % w, np.iinfo(x.dtype).max, x.dtype))).reshape(-1, w)
    left = np.minimum.accumulate(full, axis=1).reshape(-1)
    right = np.minimum.accumulate(full[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    return np.minimum(right[: n - w + 1], left[w - 1 : n])


def anchor_segments(data: np.ndarray, offsets: np.ndarray, hashers: tuple[RangeHasher, RangeHasher], length: int, gram: int) -> tuple[np.ndarray, ...]:
    """(text, first window start, last window start, anchor hash, segment hash) of every anchor; starts count from the text."""
    none = np.zeros(0, np.int64)
    if len(data) < length:
        return none, none, none, none, none
    h = hashers[0].load(data).all_of(gram)
    packed = (h >> _SMALL << _SMALL) | np.arange(len(h), dtype=np.uint64)
    best = sliding_min(packed, length - gram + 1)
    owner = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))[: len(best)]
    ok = np.arange(len(best)) + length <= offsets[1:][owner]
    at = (best & np.uint64((1 << 24) - 1)).astype(np.int64)
    fresh = np.ones(len(best), bool)
    fresh[1:] = (at[1:] != at[:-1]) | (owner[1:] != owner[:-1]) | ~ok[:-1]
    first = np.flatnonzero(fresh & ok)
    if not len(first):
        return none, none, none, none, none
    stop = np.flatnonzero(ok & np.append(fresh[1:] | ~ok[1:], True))
    key = h[at[first]]
    seg = hashers[1].load(data)(first, stop + length)
    text = owner[first]
    base = offsets[:-1][text]
    return text, first - base, stop - base, key.view(np.int64), seg.view(np.int64)


_BLANK = np.zeros(256, bool)
_BLANK[[9, 10, 11, 12, 13, 32]] = True
WORD = 4  # bytes of a word's code
SIGNS = 40  # values of such a byte: few, as the sort keeps a queue a value


def word_codes(data: np.ndarray, offsets: np.ndarray, hasher: RangeHasher) -> tuple[np.ndarray, np.ndarray]:
    """The texts with each word (run of bytes other than ASCII white space) as a code of `WORD` bytes, none of them 0, and their
    offsets: what compares bytes then compares words. There are 2,560,000 codes, so two passages that differ in one word only are
    taken for equal once in as many cases."""
    solid = ~_BLANK[data]
    edge = np.zeros(len(data), bool)
    edge[offsets[:-1][offsets[:-1] < len(data)]] = True  # a text's first byte begins a word, whatever stands before
    before = np.zeros(len(data), bool)
    before[1:] = solid[:-1]
    first = np.flatnonzero(solid & (~before | edge))
    after = np.ones(len(data), bool)
    after[:-1] = ~solid[1:] | edge[1:]
    end = np.flatnonzero(solid & after) + 1
    h = hasher.load(data)(first, end)
    code = np.empty((len(first), WORD), np.uint8)
    for k in range(WORD):
        code[:, k] = h % np.uint64(SIGNS) + np.uint64(1)
        h = h // np.uint64(SIGNS)
    return code.reshape(-1), np.searchsorted(first, offsets) * WORD
