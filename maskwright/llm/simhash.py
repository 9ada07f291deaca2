"""SimHash near-duplicate groups: tiled exact Hamming comparison.

1. One map pass computes the 64-bit fingerprint of each whole text (Arrow batches, nothing is shuffled but ids).
2. Equal fingerprints collapse to one row (partial aggregation), so copies never meet as pairs.
3. Distinct fingerprints are dealt to tiles of one population-count band each. The triangle inequality says that two
   fingerprints differ in at least |popcount(a) - popcount(b)| bits, so tile pairs whose bands lie further apart than the
   radius are never built. Every other pair of tiles is compared in full with numpy exclusive-or and bit counts.
4. A tile pair returns a spanning star of what it links (fewer rows than its fingerprints), never the links themselves.
5. Components by star contraction in the shared folder, then one join back to the documents.

Defined cases: null text is empty text; texts without a word have fingerprint 0 and are linked like any other; texts of
fewer words than a shingle use their whole sequence; rows with a null doc_id get a fingerprint and take the component of
documents with that very fingerprint, else null; repeated doc_ids each get a row. Extra columns pass by unread.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from maskwright.llm.common import fresh, materialize, slices
from maskwright.llm.graph import connected_components

#: Fingerprints of a tile, whatever the size of the input: 128 KiB of them, and as much of ids.
TILE = 16_384


def fingerprint(text: str | None, width: int = 4, seed: int = 42) -> int:
    """SimHash of the whole text over all `width`-word shingles, repeats included."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: only ASCII case and ASCII white space
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    k = min(width, len(words))
    digest, n = xxhash.xxh64_intdigest, len(words) - k + 1
    h = np.fromiter((digest(joined[s:e], seed) for s, e in zip(starts[:n].tolist(), ends[k - 1 :].tolist())), np.uint64, n)
    ones = np.zeros(64, np.int64)
    for at in range(0, n, 1 << 16):  # bounds the unpacked bits of very long texts
        part = h[at : at + (1 << 16)].astype("<u8", copy=False).view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, width: int = 4, seed: int = 42) -> DataFrame:
    """(doc_id, fp) for every row; fp is the fingerprint as a signed 64-bit integer."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            fp = np.fromiter((fingerprint(t, width, seed) for t in b.column("text").to_pylist()), np.uint64, b.num_rows)
            yield pa.record_batch([b.column("doc_id"), pa.array(fp.view(np.int64))], ["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, fp long")


def merge_links(a: np.ndarray, b: np.ndarray | None, radius: int, block: int = 256, wide: int = 16_384) -> np.ndarray:
    """Component label (an index into a ++ b, the smallest of its component) of each fingerprint under links a-b, or a-a if b is None."""
    a = a.view(np.uint64)  # bit counts of signed numbers are those of their absolute values
    other = a if b is None else b.view(np.uint64)
    shift = 0 if b is None else len(a)
    label = np.arange(len(a) + (0 if b is None else len(other)))
    for at in range(0, len(a), block):
        rows = a[at : at + block]
        for to in range(0, len(other), wide):  # both sides in blocks: 256 x 16,384 exclusive-ors are 32 MiB
            part = other[to : to + wide]
            near = np.bitwise_count(rows[:, None] ^ part[None, :]) <= radius
            near &= label[at : at + len(rows), None] != label[None, shift + to : shift + to + len(part)]
            r, c = np.nonzero(near)
            r, c = r + at, c + shift + to
            while len(r):
                x, y = label[r], label[c]
                open_ = x != y
                if not open_.any():
                    break
                r, c, x, y = r[open_], c[open_], x[open_], y[open_]
                np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
                while True:  # point every label at its root
                    up = label[label]
                    if (up == label).all():
                        break
                    label = up
    return label


def tile_bands(counts: dict[int, int], tile: int) -> list[tuple[int, int, int]]:
    """Bands (lowest, highest population count, number of tiles) that cover `counts`; at most 65 rows of input."""
    bands: list[tuple[int, int, int]] = []
    low, held = None, 0
    for p in sorted(counts):
        low = p if low is None else low
        held += counts[p]
        if held >= tile // 2:
            bands.append((low, p, -(-held // tile)))
            low, held = None, 0
    if low is not None:
        bands.append((low, max(counts), 1))
    return bands


def near_duplicate_groups(docs: DataFrame, radius: int = 4, width: int = 4, seed: int = 42, tile: int = TILE) -> DataFrame:
    """(doc_id, fingerprint, component_id) for every row of `docs` (doc_id, text, ...)."""
    spark = docs.sparkSession
    prints = materialize(fingerprints(docs, width, seed), "simhash")
    nodes = materialize(prints.groupBy("fp").agg(F.min("doc_id").alias("node")), "simhash-nodes")

    counts = {r[0]: r[1] for r in nodes.where("node is not null").groupBy(F.bit_count("fp").alias("p")).count().collect()}  # 65 rows at most
    links = spark.createDataFrame([], "u long, v long")
    if counts:
        bands = tile_bands(counts, tile)  # 65 at most
        base = np.cumsum([0] + [k for _, _, k in bands]).tolist()
        band = spark.createDataFrame([(p, base[i], k) for i, (lo, hi, k) in enumerate(bands) for p in range(lo, hi + 1)], "p int, base int, k int")
        near = [(x, y) for x in range(len(bands)) for y in range(x, len(bands)) if bands[y][0] - bands[x][1] <= radius]
        n_pairs = sum(bands[x][2] * bands[y][2] if x != y else bands[x][2] * (bands[x][2] + 1) // 2 for x, y in near)
        # the pairs of tiles are written out by tasks: they grow with the square of the tiles
        spans = spark.createDataFrame([(base[x], base[x + 1] - 1, base[y], base[y + 1] - 1) for x, y in near], "a int, b int, c int, d int")
        pair = spans.select(F.explode(F.sequence("a", "b")).alias("i"), "c", "d").select("i", F.explode(F.sequence(F.greatest("c", "i"), F.col("d"))).alias("j"))
        tiles = (
            nodes.where("node is not null").join(F.broadcast(band), F.bit_count("fp") == F.col("p"))  # 65 rows
            .select((F.col("base") + F.pmod(F.xxhash64("fp"), F.col("k"))).cast("int").alias("tile"), "fp", "node")
            .groupBy("tile").agg(F.collect_list(F.struct("fp", "node")).alias("rows"))  # a tile holds about `tile` rows by construction
            .select("tile", F.col("rows.fp").alias("fp"), F.col("rows.node").alias("node"))
        )
        tiles = materialize(tiles, "simhash-tiles")
        def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for x in range(batch.num_rows):
                    i, j = batch.column("i")[x].as_py(), batch.column("j")[x].as_py()
                    fa, na = (batch.column(c)[x].values.to_numpy() for c in ("fa", "na"))
                    fb, nb = (batch.column(c)[x].values.to_numpy() for c in ("fb", "nb"))
                    label = merge_links(fa, None if i == j else fb, radius)
                    node = na if i == j else np.concatenate((na, nb))
                    at = np.nonzero(label != np.arange(len(label)))[0]
                    yield pa.record_batch([pa.array(node[label[at]]), pa.array(node[at])], ["u", "v"])

        a = tiles.select(F.col("tile").alias("i"), F.col("fp").alias("fa"), F.col("node").alias("na"))
        b = tiles.select(F.col("tile").alias("j"), F.col("fp").alias("fb"), F.col("node").alias("nb"))
        # comparing costs far more than reading, so partitions are made by number of pairs, not by size
        parts = min(n_pairs, max(16 * spark.sparkContext.defaultParallelism, n_pairs // 8))
        links = pair.join(a, "i").join(b, "j").repartition(parts, "i", "j").mapInArrow(compare, "u long, v long")

    roots = connected_components(links)
    groups = nodes.join(roots, nodes.node == roots.node, "left").select("fp", F.coalesce("root", nodes.node).alias("component_id"))
    groups = materialize(groups, "simhash-groups")
    return prints.join(groups, "fp", "left").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, groups: DataFrame, prints_of: Callable[[pd.Series], pd.Series]) -> DataFrame:
    """The rows of `docs` with one document left of each group of `groups` (doc_id, fingerprint, component_id): the smallest doc_id.

    Rows that repeat a doc_id count as copies: one of them stays (first by text). Rows with a null doc_id stay only if no
    named document has their fingerprint, one for each fingerprint. prints_of: the fingerprints of texts.
    """
    keep = materialize(groups.where("doc_id = component_id or component_id is null"), "simhash-keep")
    ids = keep.where("doc_id is not null").select("doc_id").distinct()
    named = docs.join(ids.hint("shuffle_hash"), "doc_id", "left_semi")
    if keep.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").limit(1).count():
        row = fresh("_row", docs.columns)
        named = named.withColumn(row, F.row_number().over(Window.partitionBy("doc_id").orderBy("text"))).where(F.col(row) == 1)
        named = named.select(docs.columns)
    if keep.where("doc_id is null").limit(1).count():
        mark = fresh("_print", docs.columns)
        alone = keep.where("doc_id is null").select(F.col("fingerprint").alias(mark)).distinct()

        @F.pandas_udf(T.StringType())
        def print_of(texts: pd.Series) -> pd.Series:
            return prints_of(texts)

        rest = docs.where("doc_id is null").withColumn(mark, print_of(F.col("text").cast("string"))).join(alone, mark, "left_semi")
        named = named.unionByName(rest.dropDuplicates([mark]).select(docs.columns))
    return named.select(docs.columns)


def keep_one_per_group(docs: DataFrame, radius: int = 4) -> DataFrame:
    """The rows of `docs` with one document left of each SimHash group, by the rules of `keep_one`."""
    return keep_one(docs, near_duplicate_groups(docs, radius), lambda texts: texts.map(lambda t: f"{fingerprint(t):016x}"))
