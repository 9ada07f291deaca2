"""Toxicity: a character n-gram linear classifier on features scaled by naive Bayes log-count ratios.

Features are the distinct character n-grams of the whole text, letters lower-cased: those that begin at a word's bound (3 to 10
code points with the bound, so stems, their inflected forms and whole short words) and those that begin at any letter of a word
(3 to 6 code points, its closing bound included, so stems after a prefix or in a compound), each kind hashed to 2^19 places of
its own. The second kind counts `INNER` times as much, since a word has several such n-grams for one of the first. Place j is scaled by r_j = log of (the share of toxic training texts with j, smoothed, over
the share of the others), so a place seen alike in both classes weighs next to nothing, and the vector is scaled to unit
length. A logistic regression on these vectors, with rare toxic texts weighted up, gives the score. Long texts are scored
whole, as presence does not grow with repetition.

The classifier is fitted on a bounded sample of labelled rows, `most_rows` (the documented parameter): those with the
smallest hash of their id; rows that the caller holds out are never read for it. Only hashed places of the sample reach the
driver, and only the two vectors of 2^20 numbers go to the tasks. Scoring is one map pass; nothing is shuffled but the join of
labels to documents for the sample.

Defined cases: null text is the empty text, which has no feature and so the base score; labels other than 0 and 1, null
labels and labels of unknown documents are not learned; a document that is labelled more than once counts as often; with
labels of one class only, or none, every score is that class's share (0.0 with no label); repeated rows are scored each; a
null doc_id stays null; an empty table gives no rows; extra columns pass by unread.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from maskwright.llm.common import slices

BITS = 19  # of the places of one kind
PLACES = 2 << BITS  # word starts, then all positions within words
LONGEST = 10
SHORTEST_INNER, LONGEST_INNER = 3, 6
INNER = 0.5
_GAP = re.compile(r"[\W_]+")
_MUL = np.uint64(0x9E3779B97F4A7C15)


class Places:
    """The distinct hashed n-grams of a text; one scratch table is reused for all texts."""

    def __init__(self) -> None:
        self.seen = np.zeros(PLACES, bool)

    def _mark(self, c: np.ndarray, start: np.ndarray, room: np.ndarray, h: np.ndarray, shortest: int, longest: int, base: int) -> None:
        """Marks the n-grams from each start; room: the code points from there to the word's end, its bound included."""
        for n in range(2, longest + 1):
            fits = room >= n
            start, room, h = start[fits], room[fits], h[fits]
            h = (h ^ (h >> np.uint64(29))) * _MUL + c[start + n - 1]
            if n >= shortest:
                self.seen[((h * _MUL) >> np.uint64(64 - BITS)).astype(np.int64) + base] = True

    def __call__(self, text: str | None) -> np.ndarray:
        clean = f" {_GAP.sub(' ', (text or '').lower()).strip()} "
        c = np.frombuffer(clean.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
        gaps = np.flatnonzero(c == 32)
        size = np.diff(gaps)
        self._mark(c, gaps[:-1], size + 1, np.full(len(size), 32, np.uint64), 3, LONGEST, 0)
        letters = np.flatnonzero(c != 32)
        left = np.repeat(gaps[1:], size - 1) - letters + 1  # to the closing bound
        self._mark(c, letters, left, c[letters], SHORTEST_INNER, LONGEST_INNER, 1 << BITS)
        found = np.flatnonzero(self.seen)
        self.seen[found] = False
        return found


class ToxicityModel:
    """weight: of a place in a unit vector, already times r; square: r squared, for the length; bias; or a constant share.
    Places within words count `INNER` times in both."""

    def __init__(self, places: list[np.ndarray], labels: np.ndarray, alpha: float = 1.0, penalty: float = 3e-5, rounds: int = 40):
        self.share = float(labels.mean()) if len(labels) else 0.0
        self.weight = self.square = np.zeros(PLACES, np.float32)
        self.bias = 0.0
        self.constant = not 0 < self.share < 1
        if self.constant:
            return
        y = labels.astype(float)
        pos, all_ = np.full(PLACES, alpha), np.full(PLACES, 2 * alpha)
        for p, label in zip(places, y):  # a text's places are distinct
            pos[p] += label
            all_[p] += 1
        r = np.log((pos / (y.sum() + alpha)) / ((all_ - pos) / ((1 - y).sum() + alpha)))
        # logistic loss with both classes of equal total weight to the power 1/2, by L-BFGS on (places in use, bias)
        # over the places of two texts or more
        often = all_ - 2 * alpha > 1
        used = np.flatnonzero(often)
        column = np.cumsum(often, dtype=np.int32) - 1
        scale = r.astype(np.float32)
        scale[1 << BITS :] *= INNER
        ends = np.concatenate(([0], np.cumsum([int(often[p].sum()) for p in places])))
        col, x = np.empty(ends[-1], np.int32), np.empty(ends[-1], np.float32)  # filled in place: the driver holds the sample once
        for a, b, p in zip(ends, ends[1:], places):
            own = p[often[p]]
            col[a:b] = column[own]
            x[a:b] = scale[own] / max(float(np.linalg.norm(scale[p])), 1e-9)
        w = np.where(y > 0, ((1 - y).sum() / y.sum()) ** 0.5, 1.0)
        w /= w.sum()
        step = 64  # texts at once: the products of all would take several times the sample

        def loss(v: np.ndarray) -> tuple[float, np.ndarray]:
            value, grad = 0.5 * penalty * float(v[:-1] @ v[:-1]), np.append(penalty * v[:-1], 0.0)
            for at in range(0, len(y), step):
                own = ends[at : at + step + 1]
                xs, cs, ys, ws = x[own[0] : own[-1]], col[own[0] : own[-1]], y[at : at + step], w[at : at + step]
                row = np.repeat(np.arange(len(ys)), np.diff(own))
                z = np.bincount(row, xs * v[cs], len(ys)) + v[-1]
                g = ws * (1 / (1 + np.exp(-np.clip(z, -40, 40))) - ys)
                value += float((ws * (np.logaddexp(0, z) - ys * z)).sum())
                grad[:-1] += np.bincount(cs, g[row] * xs, len(used))
                grad[-1] += g.sum()
            return value, grad

        v = minimize(loss, np.zeros(len(used) + 1), rounds)
        self.weight = np.zeros(PLACES, np.float32)
        self.weight[used] = (v[:-1] * scale[used]).astype(np.float32)
        self.square = np.where(often, r * r, 0).astype(np.float32)
        self.bias = float(v[-1])

    def score(self, places: np.ndarray) -> float:
        if self.constant:
            return self.share
        cut = int(np.searchsorted(places, 1 << BITS))
        length = float(self.square[places[:cut]].sum() + INNER * INNER * self.square[places[cut:]].sum()) ** 0.5
        z = (float(self.weight[places].sum()) / length if length else 0.0) + self.bias
        return float(1 / (1 + np.exp(-min(max(z, -40.0), 40.0))))


def minimize(loss, v: np.ndarray, rounds: int, memory: int = 8) -> np.ndarray:
    """L-BFGS with a backtracking line search."""
    value, grad = loss(v)
    steps: list[tuple[np.ndarray, np.ndarray]] = []
    for _ in range(rounds):
        q, kept = grad.copy(), []
        for s, y in reversed(steps):
            a = (s @ q) / (y @ s)
            q -= a * y
            kept.append(a)
        if steps:
            s, y = steps[-1]
            q *= (s @ y) / (y @ y)
        for (s, y), a in zip(steps, reversed(kept)):
            q += s * (a - (y @ q) / (y @ s))
        size = 1.0 if steps else min(1.0, 1.0 / max(np.abs(grad).sum(), 1e-12))
        slope = -(q @ grad)
        for _ in range(25):
            new = v - size * q
            new_value, new_grad = loss(new)
            if new_value <= value + 1e-4 * size * slope:
                break
            size /= 2
        else:
            break
        s, y = new - v, new_grad - grad
        if s @ y > 1e-12:
            steps = [*steps[1 - memory :], (s, y)] if len(steps) >= memory else [*steps, (s, y)]
        done = value - new_value < 1e-7 * max(1.0, abs(value))
        v, value, grad = new, new_value, new_grad
        if done:
            break
    return v


def fit(docs: DataFrame, labels: DataFrame, held_out: Column | None = None, most_rows: int = 4000) -> ToxicityModel:
    """A model of `labels` (doc_id, toxic) on the texts of `docs`."""
    key = F.pmod(F.xxhash64("doc_id", F.lit(23)), F.lit(1 << 30))
    rows = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).where("doc_id is not null and toxic in (0, 1)")
    rows = rows.where(~held_out) if held_out is not None else rows
    total = rows.count()
    share = min(1.0, (most_rows + 4 * most_rows**0.5) / total) if total else 0.0
    rows = rows.where(key < F.lit(share * float(1 << 30)))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    # the same hash bound on both sides: only the sample's texts reach the join
    sample = texts.where(F.col("doc_id").isNotNull() & (key < F.lit(share * float(1 << 30)))).join(rows, "doc_id").select(key.alias("key"), "text", "toxic")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        places = Places()
        for b in slices(batches):
            x = [places(t).astype("<i4").tobytes() for t in b.column("text").to_pylist()]
            yield pa.record_batch([b.column("key"), b.column("toxic"), pa.array(x, pa.binary())], ["key", "toxic", "x"])

    got = sample.mapInArrow(run, "key long, toxic int, x binary").toPandas() if total else None
    if got is None or not len(got):
        return ToxicityModel([], np.zeros(0))
    got = got.sort_values("key", kind="stable").head(most_rows)
    return ToxicityModel([np.frombuffer(v, "<i4") for v in got.x], got.toxic.to_numpy())


def score(docs: DataFrame, model: ToxicityModel) -> DataFrame:
    """`docs` with a column toxicity (0 to 1), whole texts, one map pass; a column of that name is replaced."""
    kept = docs.drop("toxicity")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema) + ", toxicity double"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        places = Places()
        for b in slices(batches):
            s = pa.array([model.score(places(t)) for t in b.column("text").to_pylist()], pa.float64())
            yield pa.record_batch([*b.columns, s], [*b.schema.names, "toxicity"])

    return kept.mapInArrow(run, schema)
