"""Benchmark decontamination: size-partitioned MinHash containment search, verified by exact shingle containment.

A whole long document shares next to nothing with a short test item in Jaccard terms, so one signature a document would
miss it. Items are therefore partitioned by size: class p holds those of at most 16 * 2^p distinct five-word shingles (and
more than half of that). For each class in use, documents are cut into blocks of that many shingles, and each two
neighbouring blocks form a window, so that any passage as long as an item lies in one window, with a Jaccard similarity of
0.19 or more at containment 0.8. With 64 hash functions, one agreeing minimum making a candidate, a passage is missed with a
probability below 2e-6. The minima of a class are made from those of the class below, so more classes cost little.
Items of at most 8 shingles are in no class: every document shingle is looked up among theirs, so none of them is missed.
Every candidate is then verified: the item's distinct shingles in the document, as words, over the item's distinct shingles.

Documents are read once per block of items (one block up to `block_shingles` of them), in a map pass: nothing is shuffled,
and the only thing sent to the tasks is a block of items, whose size is bounded.

Words are maximal runs of ASCII letters and digits and of characters beyond ASCII, of the lower-cased text. Defined cases:
null text or text without words holds nothing; a text of fewer than five words has one shingle, its whole sequence, so such
an item is found only as a whole text; repeated documents are searched each; items that repeat an id are searched each and
reported once with the best containment; empty tables give no rows; extra columns pass by unread.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from maskwright.llm.common import materialize, slices

WIDTH = 5
_WORDS = re.compile("[a-z0-9\x80-\U0010ffff]+")
_IS_WORD = np.zeros(256, bool)
_IS_WORD[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
_BASE = 0x9E3779B97F4A7C15
_STEPS = np.array([0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB], np.uint64)
_FIRST = 16  # shingles of the smallest size class; items of at most half as many are looked up by every shingle


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers whose every output bit depends on every input bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def words_of(text: str | None) -> list[str]:
    return _WORDS.findall((text or "").lower())


def shingles_of(text: str | None, width: int = WIDTH) -> set[str]:
    w = words_of(text)
    return {" ".join(w[i : i + width]) for i in range(max(1, len(w) - width + 1))} if w else set()


class ShingleHasher:
    """Hashes all shingles of many texts at once. Prefix sums of byte * base^i give each word's hash by one subtraction."""

    def __init__(self) -> None:
        self.power, self.inverse = np.ones(0, np.uint64), np.ones(0, np.uint64)

    def _powers(self, n: int) -> None:
        if n > len(self.power):
            n = max(n, 2 * len(self.power))
            for name, base in (("power", _BASE), ("inverse", pow(_BASE, -1, 1 << 64))):
                steps = np.full(n, base, np.uint64)
                steps[:1] = 1
                setattr(self, name, np.cumprod(steps))

    def __call__(self, texts: list[str | None], width: int = WIDTH) -> tuple[np.ndarray, np.ndarray]:
        """(hashes of all shingles in a row, number of shingles of each text)."""
        parts = [(t or "").lower().encode("utf-8", "surrogatepass") for t in texts]
        data = np.frombuffer(b" ".join(parts) + b" ", np.uint8)
        self._powers(len(data))
        edge = np.diff(np.concatenate(([False], _IS_WORD[data])).view(np.int8))
        start, end = np.nonzero(edge == 1)[0], np.nonzero(edge == -1)[0]
        total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(data.astype(np.uint64) * self.power[: len(data)])))
        word = mix((total[end] - total[start]) * self.inverse[start])
        first = np.searchsorted(start, np.cumsum([0] + [len(p) + 1 for p in parts]))  # first word of each text
        n_words = np.diff(first)
        n = np.where(n_words, np.maximum(n_words - width + 1, 1), 0)
        at = np.repeat(first[:-1] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        padded = np.concatenate((word, np.zeros(width, np.uint64)))
        h = padded[at] * _STEPS[0]
        for k in range(1, width):
            h += padded[at + k] * _STEPS[k]
        for i in np.nonzero((n_words > 0) & (n_words < width))[0]:  # the whole sequence
            own = word[first[i] : first[i + 1]]
            h[np.cumsum(n)[i] - 1] = (own * _STEPS[: len(own)]).sum(dtype=np.uint64) + np.uint64(len(own))
        return mix(h), n


class ItemIndex:
    """Signatures of a block of items by size class, and their exact shingles."""

    def __init__(self, items: list[tuple[int, str]], hashes: int = 64, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.mul = rng.integers(0, 1 << 63, hashes, np.uint64) * np.uint64(2) + np.uint64(1)
        self.add = rng.integers(0, 1 << 63, hashes, np.uint64)
        items = [(i, t) for i, t in items if words_of(t)]
        self.ids = [i for i, _ in items]
        self.exact = [shingles_of(t) for _, t in items]
        h, n = ShingleHasher()([t for _, t in items])
        self.hashed = [np.unique(x) for x in np.split(h, np.cumsum(n)[:-1])] if items else []
        small = [k for k, x in enumerate(self.hashed) if len(x) <= _FIRST // 2]
        values = np.concatenate([self.hashed[k] for k in small]) if small else np.zeros(0, np.uint64)
        order = np.argsort(values, kind="stable")
        self.small = values[order], np.repeat(small, [len(self.hashed[k]) for k in small]).astype(np.int64)[order], np.zeros(1 << 20, bool)
        self.small[2][(values & np.uint64(0xFFFFF)).astype(np.int64)] = True
        self.classes: dict[int, list[tuple[np.ndarray, np.ndarray, np.ndarray]]] = {}
        large = [k for k, x in enumerate(self.hashed) if len(x) > _FIRST // 2]
        for p in sorted({self.size_class(len(self.hashed[k])) for k in large}):
            own = np.array([k for k in large if self.size_class(len(self.hashed[k])) == p])
            self.classes[p] = []
            for a, b in zip(self.mul, self.add):
                low = np.array([(self.hashed[k] * a + b).min() for k in own], np.uint64)
                order = np.argsort(low, kind="stable")
                flags = np.zeros(1 << 16, bool)
                flags[(low & np.uint64(0xFFFF)).astype(np.int64)] = True
                self.classes[p].append((low[order], own[order], flags))

    @staticmethod
    def size_class(n: int) -> int:
        return max(0, (n - 1).bit_length() - (_FIRST - 1).bit_length())

    def small_candidates(self, h: np.ndarray, n: np.ndarray, threshold: float) -> set[tuple[int, int]]:
        """(text, item) of every item of at most 8 shingles that has `threshold` of them in the text, by their hashes."""
        values, own, flags = self.small
        at = np.nonzero(flags[(h & np.uint64(0xFFFFF)).astype(np.int64)])[0] if len(values) else values
        found: set[tuple[int, int]] = set()
        if not len(at):
            return found
        lo, hi = np.searchsorted(values, h[at], "left"), np.searchsorted(values, h[at], "right")
        owner = np.searchsorted(np.cumsum(n), at, "right")
        pairs = np.unique(np.column_stack((owner, lo, hi))[hi > lo], axis=0)  # a shingle once a text
        sizes = np.array([len(x) for x in self.hashed])
        ends = np.searchsorted(pairs[:, 0], np.arange(len(n) + 1))
        for d in np.unique(pairs[:, 0]).tolist():
            shared = np.concatenate([own[a:b] for a, b in pairs[ends[d] : ends[d + 1], 1:].tolist()])
            items, counts = np.unique(shared, return_counts=True)
            found.update((d, k) for k in items[counts >= threshold * sizes[items] - 1e-9].tolist())
        return found

    def candidates(self, h: np.ndarray, n: np.ndarray) -> set[tuple[int, int]]:
        """(text, item) of every window that shares a minimum with an item of its class."""
        found: set[tuple[int, int]] = set()
        blocks = -(-n // _FIRST)
        live = np.nonzero(n)[0]
        if not len(live) or not self.classes:
            return found

        def starts(counts: np.ndarray, step: int) -> np.ndarray:
            k = -(-counts // step)
            return np.repeat(np.cumsum(counts) - counts, k) + (np.arange(k.sum()) - np.repeat(np.cumsum(k) - k, k)) * step

        cuts = [starts(n, _FIRST)]
        counts = [blocks]
        for _ in range(max(self.classes)):
            cuts.append(starts(counts[-1], 2))
            counts.append(-(-counts[-1] // 2))
        owners = {p: np.repeat(np.arange(len(n)), counts[p]) for p in self.classes}
        last = {p: np.concatenate((owners[p][1:] != owners[p][:-1], [True])) for p in self.classes}
        for i, (a, b) in enumerate(zip(self.mul, self.add)):
            low = np.minimum.reduceat(h * a + b, cuts[0])
            for p in range(max(self.classes) + 1):
                if p:
                    low = np.minimum.reduceat(low, cuts[p])
                if p not in self.classes:
                    continue
                window = np.where(last[p], low, np.minimum(low, np.concatenate((low[1:], low[:1]))))
                values, own, flags = self.classes[p][i]
                hit = np.nonzero(flags[(window & np.uint64(0xFFFF)).astype(np.int64)])[0]
                if not len(hit):
                    continue
                lo, hi = np.searchsorted(values, window[hit], "left"), np.searchsorted(values, window[hit], "right")
                for w, x, y in zip(hit[hi > lo].tolist(), lo[hi > lo].tolist(), hi[hi > lo].tolist()):
                    found.update((int(owners[p][w]), int(k)) for k in own[x:y])
        return found

    def search(self, hasher: ShingleHasher, texts: list[str | None], threshold: float) -> list[tuple[int, int, int, int]]:
        """(text, item id, shared shingles, item shingles) of each verified containment, best first for items of one id."""
        h, n = hasher(texts)
        ends = np.cumsum(n)
        best: dict[tuple[int, int], tuple[int, int]] = {}
        exact: dict[int, set[str]] = {}
        for d, k in sorted(self.candidates(h, n) | self.small_candidates(h, n, threshold)):
            size = len(self.exact[k])
            own = h[ends[d] - n[d] : ends[d]]
            if np.isin(self.hashed[k], own).sum() < threshold * size - 1e-9:
                continue
            if d not in exact:
                exact = {d: shingles_of(texts[d])}
            shared = len(self.exact[k] & exact[d])
            if shared >= threshold * size - 1e-9 and shared / size > (lambda x: x[0] / x[1])(best.get((d, self.ids[k]), (0, 1))):
                best[d, self.ids[k]] = (shared, size)
        return [(d, i, s, m) for (d, i), (s, m) in best.items()]


def item_blocks(items: DataFrame, block_shingles: int = 1_000_000) -> Iterator[tuple[ItemIndex, bool]]:
    """(index, whether it is the only one) of all items, in blocks of about `block_shingles` shingles. Callers write a block's
    result before they ask for the next one, so that one block is on the driver and in a worker at a time."""
    rows = items.select(F.col("item_id").cast("long").alias("item_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    n, words = rows.agg(F.count("*"), F.sum(F.length("text") / 5)).first()
    parts = max(1, -(-int(words or 0) // block_shingles))
    for k in range(parts if n else 0):
        yield ItemIndex([tuple(r) for r in rows.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(parts)) == k).collect()]), parts == 1


def contaminated(docs: DataFrame, items: DataFrame, threshold: float = 0.8, block_shingles: int = 1_000_000) -> DataFrame:
    """(doc_id, item_id, n_shared, n_item, containment) of each item contained in a document."""
    schema = "doc_id long, item_id long, n_shared long, n_item long"
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))

    def scan(index: ItemIndex) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            hasher = ShingleHasher()
            for b in slices(batches, limit=1 << 20):
                found = index.search(hasher, b.column("text").to_pylist(), threshold)
                if found:
                    at = pa.array([x[0] for x in found])
                    yield pa.record_batch([b.column("doc_id").take(at), *(pa.array([x[c] for x in found], pa.int64()) for c in (1, 2, 3))], ["doc_id", "item_id", "n_shared", "n_item"])

        return rows.mapInArrow(run, schema)

    out = docs.sparkSession.createDataFrame([], schema)
    for index, alone in item_blocks(items, block_shingles):
        out = scan(index) if alone else out.union(materialize(scan(index), "contained"))
        del index
    return out.withColumn("containment", F.col("n_shared") / F.col("n_item"))


def drop_contaminated(docs: DataFrame, items: DataFrame, threshold: float = 0.8, block_shingles: int = 1_000_000) -> DataFrame:
    """The documents that contain no item; a map pass over all columns for each block of items."""
    for index, alone in item_blocks(items, block_shingles):

        def run(batches: Iterator[pa.RecordBatch], index: ItemIndex = index) -> Iterator[pa.RecordBatch]:
            hasher = ShingleHasher()
            for b in slices(batches, limit=1 << 20):
                keep = np.ones(b.num_rows, bool)
                keep[[x[0] for x in index.search(hasher, b.column("text").to_pylist(), threshold)]] = False
                yield b.filter(pa.array(keep))

        docs = docs.mapInArrow(run, docs.schema) if alone else materialize(docs.mapInArrow(run, docs.schema), "uncontained")
        del index, run
    return docs


#: The same containments by plain set joins, for DuckDB.
ORACLE_SQL = r"""
WITH words AS (
  SELECT 'd' AS kind, doc_id AS id, regexp_extract_all(lower(coalesce(text, '')), '[^\x00-\x2f\x3a-\x60\x7b-\x7f]+') AS w FROM documents
  UNION ALL SELECT 'i', item_id, regexp_extract_all(lower(coalesce(text, '')), '[^\x00-\x2f\x3a-\x60\x7b-\x7f]+') FROM benchmark),
shingles AS (
  SELECT DISTINCT kind, id, array_to_string(w[i:i + 4], ' ') AS s
  FROM (SELECT kind, id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM words WHERE len(w) > 0)),
sizes AS (SELECT id, count(*) AS n_item FROM shingles WHERE kind = 'i' GROUP BY id),
shared AS (
  SELECT d.id AS doc_id, i.id AS item_id, count(*) AS n_shared
  FROM shingles d JOIN shingles i ON d.s = i.s AND d.kind = 'd' AND i.kind = 'i' GROUP BY ALL)
SELECT doc_id, item_id, n_shared, n_item, n_shared / n_item AS containment
FROM shared JOIN sizes ON item_id = sizes.id WHERE n_shared >= 0.8 * n_item - 1e-9
"""
