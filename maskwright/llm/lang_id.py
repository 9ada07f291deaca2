"""Language identification by hierarchical discrimination.

Level 1 predicts the language family (one-versus-rest linear support vector machines over the families); level 2 separates
the languages of that family by one-versus-one linear support vector machines, most votes first, then the larger margins. A
family of one language needs no second level. Features are byte bigrams and trigrams of the lower-cased letters of the whole
text, hashed to `DIMS` relative frequencies (square roots, unit length), so a text's length does not matter.

The machines are fitted by dual coordinate descent on a bounded sample: at most `per_lang` rows of each language (the
documented parameter), those whose ids have the smallest hash, so the sample is the same on every run; rows that the caller
holds out are never read for it. Only the sample's feature vectors reach the driver. Scoring is one map pass.

Defined cases: null text, or text without a letter, is `und` with score 0; null languages are not learned; with no labelled
row at all every text is `und`; ties go to the language first by name; repeated rows are predicted each; a null doc_id stays
null; an empty table gives no rows; extra columns pass by unread. `reject_unknown` leaves an input's own columns alone,
whatever they are called.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from maskwright.llm.common import fresh, slices, string_bytes

DIMS = 1 << 13
#: Families by language code; a code that is not listed is a family of its own.
FAMILIES = {
    "germanic": ("de", "en", "nl", "sv", "da", "no", "is", "af"),
    "romance": ("es", "fr", "it", "pt", "ro", "ca", "gl"),
    "slavic": ("ru", "uk", "pl", "cs", "sk", "bg", "sr", "hr", "sl"),
}
_FAMILY_OF = {code: family for family, codes in FAMILIES.items() for code in codes}
_LETTER = re.compile(r"[^\W\d_]")
#: Bytes that are letters of UTF-8 text (ASCII letters and all bytes beyond ASCII); the rest are one separator.
_CLASS = np.full(256, 32, np.uint8)
_CLASS[0x41:0x5B] = np.arange(0x61, 0x7B)
_CLASS[0x61:0x7B] = np.arange(0x61, 0x7B)
_CLASS[0x80:] = np.arange(0x80, 0x100)


def has_letter(text: str | None) -> bool:
    found = _LETTER.search(text) if text else None
    return found is not None and (found[0].isalpha() or any(map(str.isalpha, text)))  # some numbers are word characters too


def counts_of(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """(texts, DIMS) unit vectors of the texts that lie one after the other in `data`."""
    out = np.zeros((len(offsets) - 1, DIMS), np.float32)
    for i in range(len(offsets) - 1):
        b = _CLASS[data[offsets[i] : offsets[i + 1]]].astype(np.uint32)
        if len(b) < 3:
            b = np.concatenate((b, np.full(3 - len(b), 32, np.uint32)))
        two = b[:-1] << np.uint32(8) | b[1:]
        tri = (two[:-1] << np.uint32(8) | b[2:]) * np.uint32(0x9E3779B1) >> np.uint32(32 - 13)
        bi = (two * np.uint32(0x85EBCA6B)) >> np.uint32(32 - 13)
        x = np.sqrt((np.bincount(tri, minlength=DIMS) + np.bincount(bi, minlength=DIMS)).astype(np.float32))
        out[i] = x / np.linalg.norm(x)
    return out


def fit_svm(x: np.ndarray, y: np.ndarray, c: float = 1.0, rounds: int = 12, seed: int = 3) -> np.ndarray:
    """Weights of a linear support vector machine (squared hinge loss, y in -1, 1) by dual coordinate descent."""
    rng = np.random.default_rng(seed)
    alpha, w = np.zeros(len(x)), np.zeros(x.shape[1])
    diag = 1 / (2 * c)
    norm = np.einsum("ij,ij->i", x, x) + diag
    for _ in range(rounds):
        moved = 0.0
        for i in rng.permutation(len(x)):
            step = (y[i] * (x[i] @ w) - 1 + diag * alpha[i]) / norm[i]
            new = max(alpha[i] - step, 0.0)
            if new != alpha[i]:
                w += (new - alpha[i]) * y[i] * x[i]
                moved = max(moved, abs(new - alpha[i]))
                alpha[i] = new
        if moved < 1e-3:
            break
    return w.astype(np.float32)


class LanguageModel:
    """Family machines and, within each family, one-versus-one machines."""

    def __init__(self, x: np.ndarray, langs: list[str]):
        x = np.concatenate((x, np.ones((len(x), 1), np.float32)), axis=1)
        lang = np.array(langs)
        self.langs = sorted(set(langs))
        family = np.array([_FAMILY_OF.get(v, v) for v in langs])
        self.families = sorted(set(family.tolist()))
        self.members = {f: [v for v in self.langs if _FAMILY_OF.get(v, v) == f] for f in self.families}
        rows = [fit_svm(x, np.where(family == f, 1.0, -1.0)) for f in self.families] if len(self.families) > 1 else []
        self.pairs: list[tuple[str, str]] = []
        for f in self.families:
            for i, a in enumerate(self.members[f]):
                for b in self.members[f][i + 1 :]:
                    own = (lang == a) | (lang == b)
                    rows.append(fit_svm(x[own], np.where(lang[own] == a, 1.0, -1.0)))
                    self.pairs.append((a, b))
        self.weights = np.array(rows, np.float32).reshape(len(rows), x.shape[1])

    def predict(self, x: np.ndarray) -> tuple[list[str], np.ndarray]:
        """(language, score) of unit vectors: the product of the family's and the language's share of the margins."""
        margin = x @ self.weights[:, :-1].T + self.weights[:, -1]
        n_f = len(self.families) if len(self.families) > 1 else 0
        soft = lambda m: np.exp(m - m.max(1, keepdims=True)) / np.exp(m - m.max(1, keepdims=True)).sum(1, keepdims=True)
        sharp = 4.0  # margins of -1 and 1 are worth probabilities of about 0 and 1
        share = soft(sharp * margin[:, :n_f]) if n_f else np.ones((len(x), 1))
        best = share.argmax(1)
        out, score = np.empty(len(x), object), np.zeros(len(x))
        for k, f in enumerate(self.families):
            own = np.nonzero(best == k)[0]
            names = self.members[f]
            votes, total = np.zeros((len(own), len(names))), np.zeros((len(own), len(names)))
            for p, (a, b) in enumerate(self.pairs):
                if a in names and b in names:
                    m = margin[own, n_f + p]
                    i, j = names.index(a), names.index(b)
                    votes[:, i] += m >= 0
                    votes[:, j] += m < 0
                    total[:, i] += m
                    total[:, j] -= m
            rank = votes + 0.5 * np.tanh(total / max(1, len(names)))  # votes first, margins among equals
            pick = rank.argmax(1)
            within = soft(sharp * total / max(1, len(names) - 1))[np.arange(len(own)), pick] if len(names) > 1 else 1.0
            out[own] = np.array(names, object)[pick]
            score[own] = share[own, k] * within
        return out.tolist(), np.clip(score, 0, 1)


def fit(docs: DataFrame, held_out: Column | None = None, per_lang: int = 400) -> LanguageModel | None:
    """A model of every language in `docs`; None if no row is labelled. The sample holds at most `per_lang` rows a language; rows
    that are equal in id, text and language count once."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    rows = rows.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & (~held_out if held_out is not None else F.lit(True)))
    rows = rows.withColumn("hash", F.xxhash64("doc_id", "text", F.lit(17)))
    key = F.pmod("hash", F.lit(1 << 30))
    # the smallest hashes of each language: a threshold from how many different rows it has, then an exact cut of the few left
    sizes = rows.groupBy("lang").agg(F.approx_count_distinct("hash")).collect()  # a row a language
    if not sizes:
        return None
    near = F.create_map(*(F.lit(v) for r in sizes for v in (r[0], min(1.0, 1.5 * per_lang / r[1] + 20 / r[1]))))
    sample = rows.where(key < near[F.col("lang")] * float(1 << 30)).groupBy("hash", "lang").agg(F.min("text").alias("text"))

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, limit=1 << 20):
            lettered = pa.array([has_letter(t) for t in b.column("text").to_pylist()])
            b = b.filter(lettered)
            x = counts_of(*string_bytes(b.column("text")))
            yield pa.record_batch([b.column("key"), b.column("lang"), pa.array([v.astype(np.float16).tobytes() for v in x], pa.binary())], ["key", "lang", "x"])

    got = sample.select(key.alias("key"), "text", "lang").mapInArrow(features, "key long, lang string, x binary").toPandas()
    got = got.sort_values(["lang", "key"], kind="stable").groupby("lang", sort=True).head(per_lang)
    if not len(got):
        return None
    return LanguageModel(np.stack([np.frombuffer(v, np.float16) for v in got.x]).astype(np.float32), got.lang.tolist())


def predict(docs: DataFrame, model: LanguageModel | None, lang_as: str = "lang_pred", score_as: str = "score") -> DataFrame:
    """`docs` with lang_pred and score (or other names), whole texts, one map pass; columns of these names are replaced."""
    kept = docs.drop(lang_as, score_as)
    schema = StructType([*kept.schema.fields, StructField(lang_as, StringType()), StructField(score_as, DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, limit=1 << 20):
            known = np.array([has_letter(t) for t in b.column("text").to_pylist()], bool)
            lang, score = np.full(b.num_rows, "und", object), np.zeros(b.num_rows)
            if model is not None and known.any():
                x = counts_of(*string_bytes(b.column("text").filter(pa.array(known))))
                lang[known], score[known] = model.predict(x)
            yield pa.record_batch([*b.columns, pa.array(lang.tolist(), pa.string()), pa.array(score)], [*b.schema.names, lang_as, score_as])

    return kept.mapInArrow(run, schema)


def held_out_rows(modulus: int = 4, remainder: int = 2) -> Column:
    """Whether a row is held out: crc32 of its id as text; a null id counts as the empty text."""
    return F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")), F.lit(modulus)) == remainder


def reject_unknown(docs: DataFrame, least: float = 0.3) -> DataFrame:
    """The documents whose language is known with a score of `least` or more; columns stay as they are."""
    lang, score = fresh("lang_pred", docs.columns), fresh("score", docs.columns)
    return predict(docs, fit(docs), lang, score).where((F.col(lang) != "und") & (F.col(score) >= least)).select(docs.columns)
