"""Quality classifier: an interpolated modified Kneser-Ney character model of trusted text.

Counts: every trusted text, whole, gives its character 5-grams (lower-cased, white space as one space, start and end marks);
tasks count in numpy and pre-aggregate, so the shuffle carries distinct 5-grams, not text positions. A gram is one 64-bit
number of five 12-bit characters (code points under 2048 as they are, the rest folded onto 2048 more), so contexts and
suffixes are shifts and masks in SQL. Lower orders are continuation counts: distinct grams of the order above by suffix.

Model: per order the three discounts come from the counts of counts; grams join their context's totals, and the
probabilities of the order below, in equi-joins sharded by key. Everything covers all trusted text, so the model grows with it.

Scores: a position needs the tables of one pair of preceding characters only (and orders 1 and 2, at most 4096^2 rows, which
every shard has). The model is cut into shards by that pair, each of at most `shard_rows` rows, the proven bound of what is
broadcast; each shard scores its own positions of every document, and sums are added. One shard, the common case, is one map
pass.

A document is kept if its perplexity is at most its language's threshold: `slack` times the quantile of the trusted documents'
perplexities in that language (very short texts have a long upper tail, which a bare quantile would cut off). Languages without a trusted document take the quantile over all trusted ones.

Defined cases: null text is the empty text, of which the end mark is scored; a null language is `und`; labels are matched by
doc_id, and a document is trusted if any of its labels says 1; repeated rows are scored each; null doc_ids are never
trusted; without trusted text every character has the same probability and, as there is no threshold, all rows are kept; an
empty table gives no rows; extra columns pass by unread.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from maskwright.llm.common import materialize, release_memory, slices, worker_cache

ORDER = 5
BITS = 12
START, END = 1, 2
_MIX = np.uint64(0x9E3779B97F4A7C15)


def gram_codes(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """(5-gram ending at each scored position of all texts, number of positions of each text)."""
    clean = [" ".join((t or "").lower().replace("\x01", " ").replace("\x02", " ").split()) for t in texts]
    lead = "\x01" * (ORDER - 1)
    data = "".join(f"{lead}{t}\x02" for t in clean).encode("utf-32-le", "surrogatepass")
    c = np.frombuffer(data, "<u4").astype(np.int64)
    c = np.where(c < 2048, c, 2048 + (c & 2047))
    g = c[ORDER - 1 :].copy()
    for k in range(1, ORDER):
        g |= c[ORDER - 1 - k : len(c) - k] << (BITS * k)
    return g[c[ORDER - 1 :] != START], np.array([len(t) + 1 for t in clean], np.int64)


def count_grams(docs: DataFrame) -> DataFrame:
    """(g, c): occurrences of every distinct 5-gram in all texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, counts, held = [], [], 0

        def merged() -> tuple[np.ndarray, np.ndarray]:
            k, at = np.unique(np.concatenate(keys), return_inverse=True)
            return k, np.bincount(at, np.concatenate(counts), len(k)).astype(np.int64)

        for b in slices(batches):
            k, c = np.unique(gram_codes(b.column("text").to_pylist())[0], return_counts=True)
            keys.append(k), counts.append(c)
            held += len(k)
            if held > 2_000_000:
                k, c = merged()
                if len(k) > 1_000_000:
                    yield pa.record_batch([pa.array(k), pa.array(c)], ["g", "c"])
                    keys, counts, held = [], [], 0
                else:
                    keys, counts, held = [k], [c], len(k)
        if keys:
            k, c = merged()
            yield pa.record_batch([pa.array(k), pa.array(c)], ["g", "c"])

    return docs.select("text").mapInArrow(run, "g long, c long").groupBy("g").agg(F.sum("c").alias("c"))


def discounts(n1: int, n2: int, n3: int, n4: int) -> tuple[float, float, float]:
    """The three discounts from counts of counts; where these are zero, the usual constants."""
    if not (n1 and n2):
        return 0.5, 0.75, 0.9
    y = n1 / (n1 + 2 * n2)
    d1 = 1 - 2 * y * n2 / n1
    d2 = 2 - 3 * y * n3 / n2
    d3 = 3 - 4 * y * n4 / n3 if n3 else d2
    return tuple(float(min(max(d, 0.05), k - 0.05)) for d, k in ((d1, 1), (d2, 2), (d3, 3)))


def build(trusted: DataFrame) -> DataFrame:
    """The model as rows (k, key, v): log probability of gram `key` of order k, and, as order -k, the log weight that context
    `key` of order k passes on to the order below."""
    count = materialize(count_grams(trusted), "kn-5")
    tables = {ORDER: count}
    for k in range(ORDER - 1, 0, -1):
        tables[k] = materialize(tables[k + 1].select((F.col("g").bitwiseAND((1 << BITS * k) - 1)).alias("g")).groupBy("g").agg(F.count("*").alias("c")), f"kn-{k}")
    lower, parts = None, []
    for k in range(1, ORDER + 1):
        n = tables[k].agg(*(F.sum((F.col("c") == j).cast("int")) for j in (1, 2, 3, 4))).first()
        d1, d2, d3 = discounts(*(int(x or 0) for x in n))
        cut = F.when(F.col("c") == 1, d1).when(F.col("c") == 2, d2).otherwise(d3)
        rows = tables[k].select("g", "c", F.shiftright("g", BITS).alias("ctx"), cut.alias("d"))
        context = rows.groupBy("ctx").agg(F.sum("c").alias("total"), (F.sum("d") / F.sum("c")).alias("pass"))
        joined = rows.join(context, "ctx").select("g", ((F.col("c") - F.col("d")) / F.col("total")).alias("own"), "pass")
        if k == 1:
            p = joined.select("g", (F.col("own") + F.col("pass") / float(1 << BITS)).alias("p"))
        else:
            suffix = F.col("g").bitwiseAND((1 << BITS * (k - 1)) - 1)
            p = joined.join(lower.select(F.col("g").alias("s"), F.col("p").alias("q")), suffix == F.col("s")).select("g", (F.col("own") + F.col("pass") * F.col("q")).alias("p"))
        lower = materialize(p, f"kn-p{k}")
        parts.append(lower.select(F.lit(k).alias("k"), F.col("g").alias("key"), F.log("p").cast("float").alias("v")))
        parts.append(context.select(F.lit(-k).alias("k"), F.col("ctx").alias("key"), F.log("pass").cast("float").alias("v")))
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return materialize(out, "kn-model")


class Lookup:
    """Values of 64-bit keys: keys sorted by a mixed hash, an index by its leading bits, and a short scan from there."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        self.bits = max(1, int(len(keys)).bit_length())
        h = self._hash(keys)
        order = np.argsort(h, kind="stable")
        self.keys, self.values = np.append(keys[order], -1), np.append(values[order], np.float32(0))
        at = np.bincount(h.astype(np.int64), minlength=1 << self.bits)
        self.first = np.concatenate(([0], np.cumsum(at)))[:-1].astype(np.int32)
        self.longest = int(at.max()) if len(keys) else 0

    def _hash(self, keys: np.ndarray) -> np.ndarray:
        x = keys.astype(np.uint64) * _MIX
        return ((x ^ (x >> np.uint64(32))) * _MIX) >> np.uint64(64 - self.bits)

    def __call__(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(value or 0, whether found) of each key."""
        at = self.first[self._hash(keys).astype(np.int64)]
        found = self.keys[at] == keys
        value = np.where(found, self.values[at], np.float32(0))
        open_ = np.flatnonzero(~found)
        for step in range(1, self.longest):
            if not len(open_):
                break
            to = np.minimum(at[open_] + step, len(self.keys) - 1)
            hit = self.keys[to] == keys[open_]
            value[open_[hit]] = self.values[to[hit]]
            found[open_[hit]] = True
            open_ = open_[~hit]
        return value, found


class Shard:
    """Tables of the positions whose two preceding characters fall to this shard; built where they are first used."""

    def __init__(self, k: np.ndarray, key: np.ndarray, v: np.ndarray, number: int, of: int):
        self.rows, self.number, self.of = (k, key, v), number, of
        self.name = uuid.uuid4().hex

    @property
    def tables(self) -> dict[int, Lookup]:
        built = worker_cache("kneser_ney")
        if self.name not in built:  # a worker builds the tables of a shard once, and keeps those of one shard
            k, key, v = self.rows
            built.clear()
            built[self.name] = {int(j): Lookup(key[k == j], v[k == j]) for j in np.unique(k)}
        return built[self.name]

    def log_probability(self, g: np.ndarray) -> np.ndarray:
        """Natural logarithm of each 5-gram's last character given the four before it; 0 where another shard has it."""
        out = np.zeros(len(g), np.float64)
        if self.of > 1:
            own = np.flatnonzero(shard_of(g >> BITS & ((1 << 2 * BITS) - 1), self.of) == self.number)
        else:
            own = np.arange(len(g))
        tables = self.tables
        for k in range(ORDER, 0, -1):
            if not len(own):
                break
            if k in tables:
                gram = g[own] & ((1 << BITS * k) - 1)
                value, found = tables[k](gram)
                out[own] += value
                own, gram = own[~found], gram[~found]
                if len(own):
                    out[own] += tables[-k](gram >> BITS)[0]  # an unseen context passes everything on: log 1
        out[own] -= np.log(float(1 << BITS))
        return out


def shard_of(pair: np.ndarray, of: int) -> np.ndarray:
    return (pair * 2654435761 & 0xFFFFFFFF) % of


def shards(model: DataFrame, shard_rows: int = 4_000_000) -> Iterator[Shard]:
    """The model's shards, one on the driver at a time."""
    sizes = {r[0]: r[1] for r in model.groupBy("k").count().collect()}  # ten rows
    of = max(1, -(-sum(n for k, n in sizes.items() if abs(k) > 2) // shard_rows))
    # a gram's pair stands before its last character, a context's pair at its end
    pair = F.when(F.col("k") > 0, F.shiftright("key", BITS)).otherwise(F.col("key")).bitwiseAND((1 << 2 * BITS) - 1)
    owner = F.pmod((pair * 2654435761).bitwiseAND(0xFFFFFFFF), F.lit(of))
    for s in range(of):
        got = (model.where((F.abs("k") <= 2) | (owner == s)) if of > 1 else model).toArrow()
        yield Shard(*(got.column(c).to_numpy() for c in ("k", "key", "v")), s, of)
        del got
        release_memory()


def score(docs: DataFrame, model: DataFrame, shard_rows: int = 4_000_000) -> DataFrame:
    """(doc_id, lang, n_scored, perplexity) of every row of `docs`."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"))
    rows = rows.withColumn("h", F.xxhash64("text"))
    schema = "doc_id long, lang string, h long, n_scored long, lp double"

    def scan(shard: Shard) -> DataFrame:
        sent = docs.sparkSession.sparkContext.broadcast(shard)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            table = sent.value
            for b in slices(batches, limit=1 << 20, keep="kneser_ney"):
                g, n = gram_codes(b.column("text").to_pylist())
                lp = np.add.reduceat(table.log_probability(g), np.cumsum(n) - n)
                yield pa.record_batch([b.column("doc_id"), b.column("lang"), b.column("h"), pa.array(n), pa.array(lp)], ["doc_id", "lang", "h", "n_scored", "lp"])

        return rows.mapInArrow(run, schema)

    out, of = None, 0
    for shard in shards(model, shard_rows):
        out, of = scan(shard) if out is None else out.union(scan(shard)), shard.of
    if of > 1:  # a row has a part from each shard; equal rows have equal parts, and are counted
        same = ["doc_id", "lang", "h", "n_scored"]
        whole = out.groupBy(*same).agg(F.sum("lp").alias("lp"), (F.count("*") / of).cast("int").alias("m"))
        out = whole.withColumn("_", F.explode(F.expr("sequence(1, m)"))).withColumn("lp", F.col("lp") / F.col("m"))
    return out.select("doc_id", "lang", "n_scored", F.exp(-F.col("lp") / F.col("n_scored")).alias("perplexity"))


def classify(docs: DataFrame, labels: DataFrame, quantile: float = 0.995, slack: float = 2.0, accuracy: int = 10_000, shard_rows: int = 4_000_000) -> DataFrame:
    """(doc_id, lang, n_scored, perplexity, threshold, kept) of every row; `labels` (doc_id, quality) names the trusted texts."""
    trusted = labels.where("quality = 1").select(F.col("doc_id").cast("long").alias("doc_id")).distinct()
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    model = build(texts.join(trusted.hint("shuffle_hash"), "doc_id", "left_semi"))
    scored = materialize(score(docs, model, shard_rows), "kn-scores")
    known = scored.join(trusted, "doc_id", "left_semi")
    bound = materialize(known.groupBy("lang").agg(F.percentile_approx("perplexity", quantile, accuracy).alias("own")), "kn-bounds")
    if bound.count() <= 10_000:  # a row a language: with so few, one language holding most rows meets in no task
        bound = F.broadcast(bound)
    general = known.agg(F.percentile_approx("perplexity", quantile, accuracy).alias("general"))
    out = scored.join(bound, "lang", "left").crossJoin(F.broadcast(general)).withColumn("threshold", F.coalesce("own", "general") * slack)  # one row
    return out.select("doc_id", "lang", "n_scored", "perplexity", "threshold", F.coalesce(F.col("perplexity") <= F.col("threshold"), F.lit(True)).alias("kept"))
