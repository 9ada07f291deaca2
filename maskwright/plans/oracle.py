"""DuckDB SQL of the pattern chain, from the catalogue's RE2 expressions (not from their Java forms)."""

from __future__ import annotations

from maskwright.functions.patterns import Pattern, load_packs
from maskwright.functions.validators import duck
from maskwright.plans.fixtures import sql_text, texts_sql

INPUT = "SELECT doc_id, text FROM documents UNION ALL BY NAME " + texts_sql()


def token_sql(pii_type: str, value: str) -> str:
    return f"('[PII_{pii_type}_' || substr(md5({value}), 1, 16) || ']')"


def detect_sql(p: Pattern, source: str = INPUT) -> str:
    re2 = sql_text(p.re2)
    return f"""WITH m AS (SELECT doc_id, regexp_extract_all(text, {re2}) AS r FROM ({source}))
SELECT doc_id, len(r) AS n_matches, len(f) AS n_hits, f[1] AS first_hit
FROM (SELECT doc_id, r, list_filter(r, lambda v: {duck(p.validator, 'v')}) AS f FROM m WHERE len(r) > 0)"""


def chain_sql(packs: list[str], decay: float = 0.05, source: str = INPUT, patterns: tuple[Pattern, ...] | None = None) -> str:
    """CTEs up to `chain` (doc_id, text, t, f): the anonymised text and what was replaced."""
    stages, _ = load_packs(packs, decay, patterns)
    kind = "STRUCT(ordinal INTEGER, pii_type VARCHAR, original VARCHAR, token VARCHAR, confidence DOUBLE)[]"
    ctes = [f"c0 AS (SELECT doc_id, text, text AS t, CAST([] AS {kind}) AS f FROM ({source}))"]
    for i, s in enumerate(stages):
        p, re2 = s.pattern, sql_text(s.pattern.re2)
        ctes.append(f"""c{i + 1} AS MATERIALIZED (SELECT doc_id, text,
  CASE WHEN len(m) > 0 THEN array_to_string(list_transform(range(1, len(p) + 1), lambda i: p[i] || CASE WHEN i <= len(m) THEN coalesce(k[i], m[i]) ELSE '' END), '') ELSE t END AS t,
  list_concat(f, list_filter(list_transform(range(1, len(m) + 1), lambda i: {{'ordinal': {s.ordinal}, 'pii_type': '{p.pii_type}', 'original': m[i], 'token': k[i], 'confidence': CAST({s.confidence!r} AS DOUBLE)}}), lambda x: x.token IS NOT NULL)) AS f
  FROM (SELECT *, list_transform(m, lambda v: CASE WHEN {duck(p.validator, 'v')} THEN {token_sql(p.pii_type, 'v')} END) AS k
    FROM (SELECT *, coalesce(regexp_extract_all(t, {re2}), []) AS m, regexp_split_to_array(t, {re2}) AS p FROM c{i})))""")
    return "WITH " + ",\n".join(ctes) + f",\nchain AS (SELECT * FROM c{len(stages)}),\nspans AS (SELECT doc_id, unnest(range(0, len(f))) AS place, unnest(f) AS s FROM chain)\n"
