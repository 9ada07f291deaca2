r"""Secret scans over an incremental blob ledger; DataFrame and SQL functions only.

Every historical version of a document is a path whose content is a blob, addressed by the SHA-256 of its bytes. The ledger
holds what is known: one row per (blob, rule version) with the spans found. A run
1. lists the versions (path row, blob), without texts;
2. keeps the blobs that the ledger lacks for some rule version (left anti join on the pair), one representative row each;
3. scans only those texts, by split and extract of the rules' patterns in the JVM;
4. appends to the ledger, and joins findings back to every path that holds the blob.

Texts meet no shuffle but the one that brings a representative's text to its scan; a third of all rows with one text is one
blob there, and the join back to paths is an equi-join on the blob that AQE splits.

Rules of the base version: `assign`, `access` and `hex`, leftmost non-overlapping per kind, as patterns of fixed meaning.
`assign` is matched without a lower bound and short values are dropped afterwards, since a dropped match still uses up its
text; in `access` and `hex` a bound inside the pattern finds the same spans, because a run that is too short from its first
character is so from any later one. The added version finds private-key blocks, web tokens, service tokens and passwords in
URLs.

Defined cases: null text is the empty text; empty texts have no span; repeated rows are paths of their own; null doc_ids
stay null; an empty table gives no rows; extra columns pass by unread. Spans count code points.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from maskwright.llm.common import fresh, materialize, text_or_empty

#: The patterns of the base rules, kinds in the order in which ties are listed. Java dialect; the letters of
#: `assign`'s keyword in either case.
ASSIGN = r"""(?:[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{14,}"
HEX = r"[0-9a-f]{16,}"
BASE_KINDS = ("assign", "access", "hex")
#: Spans added by the method, by rule version "extra-1".
EXTRA = {
    "pem": r"-----BEGIN [A-Z ]{0,24}PRIVATE KEY-----[A-Za-z0-9+/=\s]{16,}-----END [A-Z ]{0,24}PRIVATE KEY-----",
    "jwt": r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}",
    "service": r"gh[pousr]_[A-Za-z0-9]{36,}|glpat-[A-Za-z0-9_-]{20,}|xox[abprs]-[A-Za-z0-9-]{10,}|sk_live_[A-Za-z0-9]{16,}|AIza[A-Za-z0-9_-]{35}",
    "url": r"[a-z][a-z0-9+]{1,20}://[^\s:/@]{1,64}:[^\s:/@]{3,128}@[A-Za-z0-9.-]{1,253}",
}
KINDS = (*BASE_KINDS, *EXTRA)
RULES = {"base-1": BASE_KINDS, "extra-1": tuple(EXTRA)}
PATTERNS = {"assign": ASSIGN, "access": ACCESS, "hex": HEX} | EXTRA
#: A cheaper test that any text with a match passes, where the pattern itself is slow to scan with.
GUARDS = {"pem": "PRIVATE KEY-----", "jwt": "eyJ", "url": "://"}

SPAN = "array<struct<start:bigint,rank:int,end:bigint>>"


def _spans(text: Column, kind: str) -> Column:
    """Spans of one kind: the lengths of the pieces between matches and of the matches give every position."""
    re = F.lit(PATTERNS[kind])
    rank = F.lit(KINDS.index(kind))
    pieces = F.transform(F.split(text, PATTERNS[kind], -1), F.length)
    sizes = F.transform(F.regexp_extract_all(text, re, F.lit(0)), F.length)
    both = F.zip_with(pieces, sizes, lambda p, m: F.struct(p.alias("p"), m.alias("m")))
    if kind == "assign":
        values = F.transform(F.regexp_extract_all(text, re, F.lit(1)), F.length)
        both = F.zip_with(both, values, lambda b, v: F.struct(b.p.alias("p"), b.m.alias("m"), (v >= 12).alias("keep")))
    else:
        both = F.transform(both, lambda b: F.struct(b.p.alias("p"), b.m.alias("m"), F.lit(True).alias("keep")))
    zero = F.struct(F.lit(0).cast("long").alias("at"), F.expr(f"cast(array() as {SPAN})").alias("out"))

    def step(acc: Column, b: Column) -> Column:
        start = acc.at + F.coalesce(b.p, F.lit(0))
        end = start + F.coalesce(b.m, F.lit(0))
        span = F.array(F.struct(start.cast("long").alias("start"), rank.alias("rank"), end.cast("long").alias("end")))
        return F.struct(end.cast("long").alias("at"), F.when(b.m.isNotNull() & b.keep, F.concat(acc.out, span)).otherwise(acc.out).alias("out"))

    found = F.aggregate(both, zero, step, lambda acc: acc.out)
    test = text.contains(GUARDS[kind]) & text.rlike(PATTERNS[kind]) if kind in GUARDS else text.rlike(PATTERNS[kind])
    return F.when(test, found).otherwise(F.expr(f"cast(array() as {SPAN})"))


def versions(docs: DataFrame) -> DataFrame:
    """(doc_id, blob) of every row: which content each path has."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.sha2(text_or_empty().cast("binary"), 256).alias("blob"))


def scan(docs: DataFrame, paths: DataFrame, ledger: DataFrame | None = None) -> DataFrame:
    """Ledger rows (blob, rule_version, spans) of every (blob, rule version) that `ledger` lacks; texts come from `docs`."""
    spark = docs.sparkSession
    rules = spark.createDataFrame([(v,) for v in RULES], "rule_version string")
    # the representative: a null doc_id can't be joined on, so any named path goes before it
    blobs = paths.groupBy("blob").agg(F.min("doc_id").alias("doc_id"))
    wanted = blobs.crossJoin(F.broadcast(rules)) if ledger is None else blobs.crossJoin(F.broadcast(rules)).join(ledger.select("blob", "rule_version"), ["blob", "rule_version"], "left_anti")
    work = wanted.groupBy("blob", "doc_id").agg(F.collect_set("rule_version").alias("todo"))
    text = docs.select(F.col("doc_id").cast("long").alias("_id"), text_or_empty().cast("string").alias("text"))
    found = text.join(work.hint("shuffle_hash"), F.col("_id").eqNullSafe(F.col("doc_id")))
    # a doc_id may repeat with another text: only the row that has the blob's content is its representative
    found = found.where(F.sha2(F.col("text").cast("binary"), 256) == F.col("blob"))
    per_kind = {k: _spans(F.col("text"), k) for k in KINDS}
    none = F.expr(f"cast(array() as {SPAN})")
    found = found.select("blob", "todo", *(F.when(F.array_contains("todo", v), per_kind[k]).otherwise(none).alias(k) for v, kinds in RULES.items() for k in kinds))
    each = F.explode(F.array(*(F.struct(F.lit(v).alias("rule_version"), F.array_sort(F.concat(*kinds)).alias("spans")) for v, kinds in RULES.items())))
    rows = found.select("blob", "todo", each.alias("r")).where(F.array_contains("todo", F.col("r.rule_version")))
    return rows.select("blob", "r.rule_version", "r.spans").dropDuplicates(["blob", "rule_version"])


def update(docs: DataFrame, ledger: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(paths, ledger) after a run over `docs`: all versions, and the old ledger with what this run has scanned."""
    paths = materialize(versions(docs), "ledger-paths")
    fresh = materialize(scan(docs, paths, ledger), "ledger-scanned")
    return paths, fresh if ledger is None else ledger.unionByName(fresh)


def _listed(spans: Column) -> Column:
    kinds = F.array(*(F.lit(k) for k in KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat(F.element_at(kinds, s.rank + 1), F.lit(":"), s.start, F.lit(":"), s.end)), ",")


def findings(paths: DataFrame, ledger: DataFrame) -> DataFrame:
    """(doc_id, blob, spans: array of (start, rank, end)) of every path; an empty array where nothing was found."""
    hits = ledger.where(F.size("spans") > 0).groupBy("blob").agg(F.array_sort(F.flatten(F.collect_list("spans"))).alias("spans"))
    hits = materialize(hits, "ledger-hits")  # then both sides of the join are plain exchanges, of which AQE splits a hot blob
    return paths.join(hits, "blob", "left").select("doc_id", "blob", F.coalesce("spans", F.expr(f"cast(array() as {SPAN})")).alias("spans"))


def _of_rank(rank: int):
    return lambda s: s.rank == rank  # one parameter only: a second one would be the index


def digest(found: DataFrame) -> DataFrame:
    """Counts of base kinds, the digest of base spans, and all spans as text."""
    base = F.filter("spans", lambda s: s.rank < len(BASE_KINDS))
    count = [F.size(F.filter("spans", _of_rank(r))).cast("long").alias(f"n_{k}") for r, k in enumerate(BASE_KINDS)]
    return found.select("doc_id", *count, F.sha2(_listed(base), 256).alias("base_sha256"), _listed(F.col("spans")).alias("spans"))


def redact(docs: DataFrame, ledger: DataFrame | None = None) -> DataFrame:
    """The documents with every span replaced by [SECRET]; texts without one are untouched, n_chars follows the text.

    Only the blobs with findings are joined, so clean rows keep their text as it is. Overlapping spans are replaced once.
    """
    paths, known = update(docs, ledger)
    spans, hit, blob = (fresh(c, docs.columns) for c in ("_spans", "_hit", "_blob"))
    hits = known.where(F.size("spans") > 0).groupBy(F.col("blob").alias(hit)).agg(F.array_sort(F.flatten(F.collect_list("spans"))).alias(spans))
    text = text_or_empty().cast("string")
    marked = docs.withColumn(blob, F.sha2(text.cast("binary"), 256)).join(hits, F.col(blob) == F.col(hit), "left")
    zero = F.struct(F.lit(0).cast("long").alias("at"), F.lit("").alias("out"))

    def step(acc: Column, s: Column) -> Column:
        gap = F.substr(F.col("text"), (acc.at + 1).cast("int"), (s.start - acc.at).cast("int"))
        fresh = F.struct(s.end.alias("at"), F.concat(acc.out, gap, F.lit("[SECRET]")).alias("out"))
        return F.when(s.start >= acc.at, fresh).otherwise(F.struct(F.greatest(acc.at, s.end).alias("at"), acc.out.alias("out")))

    cleaned = F.aggregate(spans, zero, step, lambda acc: F.concat(acc.out, F.substr(F.col("text"), (acc.at + 1).cast("int"))))
    out = marked.withColumn("text", F.when(F.col(spans).isNull(), F.col("text")).otherwise(cleaned))
    if "n_chars" in docs.columns:
        changed = F.length("text").cast(docs.schema["n_chars"].dataType)
        out = out.withColumn("n_chars", F.when(F.col(spans).isNull(), F.col("n_chars")).otherwise(changed))
    return out.select(docs.columns)


def _oracle_kind(kind: str, pattern: str) -> str:
    quoted = pattern.replace("'", "''")
    keep = f"list_transform(regexp_extract_all(t, '{quoted}', 1), lambda v: length(v) >= 12)" if kind == "assign" else f"list_transform(regexp_extract_all(t, '{quoted}'), lambda v: true)"
    return f"""
  SELECT rid, {KINDS.index(kind)} AS rank, '{kind}' AS kind, s AS start, e AS "end" FROM (
    SELECT rid, unnest(k) AS keep, unnest(list_transform(range(1, len(m) + 1), lambda i: CAST(coalesce(list_sum(p[:i]), 0) + coalesce(list_sum(m[:i - 1]), 0) AS BIGINT))) AS s,
           unnest(list_transform(range(1, len(m) + 1), lambda i: CAST(coalesce(list_sum(p[:i]), 0) + coalesce(list_sum(m[:i]), 0) AS BIGINT))) AS e
    FROM (SELECT rid, {keep} AS k, list_transform(regexp_split_to_array(t, '{quoted}'), lambda x: length(x)) AS p,
                 list_transform(regexp_extract_all(t, '{quoted}'), lambda x: length(x)) AS m FROM d)) WHERE keep"""


#: The same result in DuckDB's dialect.
ORACLE_SQL = (
    "WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents), spans AS ("
    + " UNION ALL ".join(_oracle_kind(k, PATTERNS[k]) for k in KINDS)
    + """), listed AS (
  SELECT rid, count(*) FILTER (WHERE rank = 0) AS n_assign, count(*) FILTER (WHERE rank = 1) AS n_access, count(*) FILTER (WHERE rank = 2) AS n_hex,
         coalesce(string_agg(kind || ':' || start || ':' || "end", ',' ORDER BY start, rank) FILTER (WHERE rank < 3), '') AS base,
         string_agg(kind || ':' || start || ':' || "end", ',' ORDER BY start, rank) AS spans FROM spans GROUP BY rid)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
       sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN listed USING (rid)"""
)
