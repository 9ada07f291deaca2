"""Suffix order and common prefixes of a shard by external induced sorting.

The suffixes that start a rise (LMS suffixes) are sorted first; every other suffix is then induced: scanning suffixes in order,
the suffix before each goes to the queue of its first byte. Queues are keyed by (first byte, order of arrival), which is the
suffix order, so one queue a byte is a priority queue whose smallest tuples leave in bulk. A tuple is (position, length of the
common prefix with the tuple before it); the common prefix of two neighbours in a queue is one more than the smallest value
scanned since the first of them, and these minima are carried from batch to batch. Queues spill to disk beyond
`memory_rows` tuples, and the text is mapped from a file beyond `memory_bytes`, but several numbers a text byte stay in memory, so a shard must fit.

LMS suffixes are sorted by a first induction over LMS substrings, which names them; where names repeat, the order of the
string of names is needed in turn. As common prefixes count only up to `cap`, that order is found to the depth of `cap` bytes:
each further level works on pairs of the names of the level before (twice the depth), at most nine levels for 400 bytes.
"""

from __future__ import annotations

import os
import shutil
import tempfile
from collections import deque

import numpy as np

from maskwright.llm.anchors import RangeHasher


class SpillQueues:
    """One first-in-first-out queue of (position, common prefix) tuples for each byte; the longest go to disk when many are held."""

    def __init__(self, folder: str, memory_rows: int):
        self.folder, self.most, self.held, self.files = folder, memory_rows, 0, 0
        self.parts: list[deque] = [deque() for _ in range(257)]

    def put(self, key: int, pos: np.ndarray, lcp: np.ndarray) -> None:
        self.parts[key].append((pos, lcp))
        self.held += len(pos)
        if self.held > self.most:
            self._spill()

    def _spill(self) -> None:
        sizes = [sum(len(p[0]) for p in q if not isinstance(p, str)) for q in self.parts]
        for key in np.argsort(sizes)[::-1]:
            if self.held <= self.most // 2:
                break
            for i, part in enumerate(self.parts[key]):
                if not isinstance(part, str):
                    name = f"{self.folder}/q{self.files}"
                    self.files += 1
                    with open(name, "wb") as f:
                        np.save(f, part[0])
                        np.save(f, part[1])
                    self.parts[key][i] = name
                    self.held -= len(part[0])

    def _read(self, part) -> tuple[np.ndarray, np.ndarray]:
        if isinstance(part, str):
            with open(part, "rb") as f:
                out = np.load(f), np.load(f)
            os.unlink(part)
            return out
        self.held -= len(part[0])
        return part

    def take(self, key: int, last: bool = False) -> tuple[np.ndarray, np.ndarray] | None:
        """The oldest batch of a queue, or its newest; None if the queue is empty. Small batches are joined."""
        q = self.parts[key]
        if not q:
            return None
        if last:
            return self._read(q.pop())
        batch = [self._read(q.popleft())]
        n = len(batch[0][0])
        while q and n < 1 << 18:
            batch.append(self._read(q.popleft()))
            n += len(batch[-1][0])
        return batch[0] if len(batch) == 1 else (np.concatenate([b[0] for b in batch]), np.concatenate([b[1] for b in batch]))


class RangeMin:
    """Minimum of x[a..b] (both included) for many ranges, from minima of power-of-two runs."""

    def __init__(self, x: np.ndarray):
        self.levels = [x]

    def __call__(self, a: np.ndarray, b: np.ndarray, empty: int) -> np.ndarray:
        size = b - a + 1
        out = np.full(len(a), empty, self.levels[0].dtype)
        level = np.where(size > 0, np.frexp(np.maximum(size, 1))[1] - 1, -1)
        for k in np.flatnonzero(np.bincount(level + 1)[1:]).tolist():
            while len(self.levels) <= k:
                low, step = self.levels[-1], 1 << (len(self.levels) - 1)
                self.levels.append(np.minimum(low[:-step], low[step:]))
            own = np.flatnonzero(level == k)
            run = self.levels[k]
            out[own] = np.minimum(run[a[own]], run[b[own] - (1 << k) + 1])
        return out


class Inducer:
    """The two scans over one text (uint8 array of at least one byte; the end counts as smaller than any byte)."""

    def __init__(self, text: np.ndarray, folder: str, cap: int, memory_rows: int):
        self.t, self.folder, self.cap, self.memory_rows = text, folder, cap, memory_rows
        n = len(text)
        rise = np.zeros(n, np.int8)
        rise[:-1] = np.sign(text[1:].astype(np.int16) - text[:-1])
        rise[-1] = -1
        at = np.where(rise != 0, np.arange(n), n - 1)
        self.small = rise[np.minimum.accumulate(at[::-1])[::-1]] > 0  # S type: smaller than the next suffix
        self.lms = np.flatnonzero(self.small[1:] & ~self.small[:-1]) + 1

    def common(self, a: int, b: int) -> int:
        """Length of the common prefix of two suffixes, up to the cap."""
        n = min(self.cap, len(self.t) - max(a, b))
        off = np.flatnonzero(self.t[a : a + n] != self.t[b : b + n])
        return int(off[0]) if len(off) else n

    def _step(self, queues: SpillQueues, carry: np.ndarray, full: np.ndarray, pos: np.ndarray, lcp: np.ndarray, to_small: bool) -> None:
        """Induce from one batch of scanned suffixes."""
        cap = self.cap
        j = np.flatnonzero(pos > 0)
        j = j[self.small[pos[j] - 1] == to_small]
        if len(j):
            before = pos[j] - 1
            key = self.t[before]
            order = np.argsort(key, kind="stable")
            j, before, key = j[order], before[order], key[order]
            head = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
            tail = np.append(head[1:], len(key))
            if not self.track:
                value = np.zeros(len(j), np.uint16)
                for k, a, b in zip(key[head].tolist(), head.tolist(), tail.tolist()):
                    queues.put(k, before[a:b], value[a:b])
                return
            since = np.append(0, j[:-1] + 1)  # first value scanned after the one before in this queue
            since[head] = 0
            low = RangeMin(lcp)(since, j, cap)
            low[head] = np.minimum(low[head], carry[key[head]])
            value = np.minimum(low + 1, cap).astype(np.uint16)
            value[head] = np.where(full[key[head]], value[head], 0)
            rest = np.append(np.minimum.accumulate(lcp[::-1])[::-1], np.uint16(cap))[j[tail - 1] + 1]
            np.minimum(carry, lcp.min(), out=carry)
            carry[key[head]] = rest
            full[key[head]] = True
            for k, a, b in zip(key[head].tolist(), head.tolist(), tail.tolist()):
                queues.put(k, before[a:b], value[a:b])
        elif len(lcp) and self.track:
            np.minimum(carry, lcp.min(), out=carry)

    def run(self, lms: np.ndarray, lcp: np.ndarray, emit, track: bool = True) -> None:
        """Scan up to sort the L suffixes, scan down to sort the S suffixes. track: whether common prefixes are wanted.

        lms: all LMS suffixes in order, lcp: common prefix of each with the one before. emit(position, common prefix with the
        next smaller scanned one): called batch by batch for the whole order, from its end.
        """
        cap, self.track = self.cap, track
        queues, sorted_l = SpillQueues(self.folder, self.memory_rows), SpillQueues(self.folder + "/l", self.memory_rows)
        os.makedirs(self.folder + "/l", exist_ok=True)
        carry, full = np.full(256, cap, np.uint16), np.zeros(256, bool)
        first = self.t[lms]
        cut = np.searchsorted(first, np.arange(257))
        if not self.small[-1]:
            queues.put(int(self.t[-1]), np.array([len(self.t) - 1]), np.zeros(1, np.uint16))  # induced by the end
            full[self.t[-1]] = True
            np.minimum(carry, 0, out=carry)
        for c in range(256):
            last = None
            while (batch := queues.take(c)) is not None:
                sorted_l.put(c, *batch)
                self._step(queues, carry, full, *batch, False)
                last = int(batch[0][-1])
            a, b = int(cut[c]), int(cut[c + 1])
            if b > a:
                own = lcp[a:b].copy()
                own[0] = 0 if last is None else self.common(last, int(lms[a]))
                self._step(queues, carry, full, lms[a:b], own, False)
        carry[:], full[:] = cap, False
        for c in range(255, -1, -1):
            last = None
            while (batch := queues.take(c)) is not None:
                emit(*batch)
                self._step(queues, carry, full, *batch, True)
                last = int(batch[0][-1])
            above = None  # the common prefix of a batch's last suffix with the first of the batch above it
            while (batch := sorted_l.take(c, last=True)) is not None:
                pos, low = batch[0][::-1], batch[1][::-1]
                down = np.append(np.uint16(0), low[:-1])  # from "with the one below" to "with the one above"
                down[0] = above if above is not None else 0 if last is None else self.common(last, int(pos[0]))
                emit(pos, down)
                self._step(queues, carry, full, pos, down, True)
                above = low[-1]


def _ranks(order: np.ndarray, fresh: np.ndarray) -> np.ndarray:
    rank = np.empty(len(order), np.int64)
    rank[order] = np.cumsum(fresh) - 1
    return rank


def lms_order(ind: Inducer, hasher: RangeHasher) -> tuple[np.ndarray, np.ndarray]:
    """The LMS suffixes in order (to the depth of the cap) and their common prefixes, up to the cap."""
    lms, n, cap = ind.lms, len(ind.t), ind.cap
    if not len(lms):
        return lms, np.zeros(0, np.uint16)
    got: list[np.ndarray] = []
    is_lms = np.zeros(n, bool)
    is_lms[lms] = True
    start = lms[np.argsort(ind.t[lms], kind="stable")]
    ind.run(start, np.zeros(len(start), np.uint16), lambda pos, _: got.append(pos[is_lms[pos]]), track=False)
    order = np.searchsorted(lms, np.concatenate(got)[::-1])
    end = np.append(lms[1:] + 1, n)  # a substring runs up to and with the next LMS position
    mark = hasher(lms, end)
    size = end - lms
    fresh = np.append(True, (mark[order[1:]] != mark[order[:-1]]) | (size[order[1:]] != size[order[:-1]]))
    rank, k = _ranks(order, fresh), 1
    bits = len(lms).bit_length()
    while not fresh.all() and 2 * k <= cap + 2:
        pair = (rank + 1) << bits
        pair[: len(pair) - k] |= rank[k:] + 1
        if 3 * bits <= 63:  # the place fits beside the names: numbers sort faster than places by them
            packed = np.sort((pair << bits) | np.arange(len(pair)))
            order, pair = packed & ((1 << bits) - 1), packed >> bits
        else:
            order = np.argsort(pair, kind="stable")
            pair = pair[order]
        fresh = np.append(True, pair[1:] != pair[:-1])
        rank, k = _ranks(order, fresh), 2 * k
    pos = lms[order]
    # A suffix is induced by the LMS suffix that follows, at most `gap` bytes on: shorter prefixes can't grow to the cap.
    gap = int(np.diff(lms, prepend=0, append=n).max())
    least = cap - 2 * gap - 8
    return pos, common_prefixes(pos, n, hasher, cap, least if least > gap else 0)


def common_prefixes(pos: np.ndarray, n: int, hasher: RangeHasher, cap: int, least: int = 0) -> np.ndarray:
    """Common prefix of each suffix with the one before, up to the cap, by bisection on range hashes; 0 for the first, and for
    prefixes shorter than `least`."""
    out = np.zeros(len(pos), np.uint16)
    own = np.flatnonzero(n - np.maximum(pos[:-1], pos[1:]) >= least)
    own = own[hasher(pos[own], pos[own] + least) == hasher(pos[own + 1], pos[own + 1] + least)]
    a, b = pos[own], pos[own + 1]
    low, high = np.full(len(a), least, np.int64), np.minimum(cap, n - np.maximum(a, b))
    while (low < high).any():
        mid = (low + high + 1) >> 1
        same = hasher(a, a + mid) == hasher(b, b + mid)
        low, high = np.where(same, mid, low), np.where(same, high, mid - 1)
    out[own + 1] = low
    return out


def repeated_starts(text: np.ndarray, length: int, memory_rows: int = 4_000_000, memory_bytes: int = 64 << 20, folder: str | None = None) -> np.ndarray:
    """Whether the `length` bytes from each position also start at another one. Bytes of value 0 separate texts: a string that
    holds one is never a repeat."""
    n = len(text)
    hit = np.zeros(n, bool)
    if n <= length:
        return hit
    own = tempfile.mkdtemp(prefix="induce-", dir=folder)
    try:
        if n > memory_bytes:
            text.tofile(f"{own}/text")
            text = np.memmap(f"{own}/text", np.uint8, "r")
        ind = Inducer(text, own, length, memory_rows)
        hasher = RangeHasher().load(np.asarray(text))
        pos, lcp = lms_order(ind, hasher)
        zeros = np.append(np.flatnonzero(text == 0), n)
        last = [-1]

        def emit(pos: np.ndarray, lcp: np.ndarray) -> None:
            # lcp is with the one emitted just before: both are repeats if it reaches the length and no separator is inside
            far = np.flatnonzero(lcp >= length)
            if len(far):
                p = pos[far]
                inside = zeros[np.searchsorted(zeros, p)] >= p + length
                far = far[inside]
                hit[pos[far]] = True
                above = np.where(far > 0, pos[far - 1], last[0])
                hit[above] = True
            last[0] = int(pos[-1])

        ind.run(pos, lcp, emit)
    finally:
        shutil.rmtree(own, ignore_errors=True)
    return hit
