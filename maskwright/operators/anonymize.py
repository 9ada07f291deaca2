"""Detection and anonymisation of a text column: an ordered chain of pattern stages, all in native expressions.

A stage splits the evolving text at a pattern's matches, replaces each match whose check holds by its token, and joins the
pieces again; cheap tests and an `rlike` skip texts without a match. Nothing is shuffled. What a stage replaced is kept as an
array column, from which spans, the token map and counts follow.

Stages are written as SQL text: planning them costs what parsing costs, not a call to the JVM for every node.
"""

from __future__ import annotations

import warnings
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from maskwright.functions.patterns import CATALOGUE, Pattern, Stage, load_packs
from maskwright.functions.tokens import sql_literal, sql_name, token_sql
from maskwright.functions.validators import CHECKS

FOUND = "array<struct<ordinal:int,pii_type:string,original:string,token:string,confidence:double>>"
#: A street address is found in two steps, since one pattern of nested repeats would recurse as deep as the text has words:
#: a possessive run of words after a number, and within it the last street word. A run that an underscore follows takes it
#: in, so that the word before it is not taken for whole.
_RUN = "(?iu)\\d++[\\t\\n\\f\\r ]++[0-9]*+[A-Za-z][A-Za-z0-9]*+(?:[\\t\\n\\f\\r ]++[0-9]*+[A-Za-z][A-Za-z0-9]*+)*+_?"
_LAST_STREET = "(?ius)^(\\d+[\\t\\n\\f\\r ]+[A-Za-z0-9].*[\\t\\n\\f\\r ](?:Street|St|Avenue|Ave|Road|Rd|Boulevard|Blvd|Lane|Ln|Drive|Dr|Court|Ct))(?=[\\t\\n\\f\\r ]|$)"


#: What a text must hold for a pattern to match at all, where that is cheaper to test than the pattern.
_NEEDS_TEXT = {"email": "@", "ipv6": ":"}
#: A run is tried where it begins only.
_NEEDS_RUN = {"api_key": "(?<![a-zA-Z0-9_.\\-\u017f\u212a])[a-zA-Z0-9_.\\-\u017f\u212a]{20}"}
_NEEDS_DIGIT = frozenset(
    "credit_card ssn phone_us address_us ipv4 zip_us steuer_id svnr kfz nir siret siren bsn kvk iban vat_eu mrn icd10 insurance_id".split()
)

Token = Callable[[Stage, str], str]


def _may_match(text: str, p: Pattern, digit: str = "") -> str:
    """digit: a column that already says whether the text holds a digit."""
    hit = f"{text} RLIKE {sql_literal(_regex(p))}"
    if p not in CATALOGUE:
        return hit
    if p.name in _NEEDS_TEXT:
        return f"contains({text}, '{_NEEDS_TEXT[p.name]}') AND {hit}"
    if p.name in _NEEDS_RUN:
        return f"{text} RLIKE {sql_literal(_NEEDS_RUN[p.name])} AND {hit}"
    has_digit = digit or f"{text} RLIKE '[0-9]'"
    return f"{has_digit} AND {hit}" if p.name in _NEEDS_DIGIT else hit


def _two_steps(p: Pattern) -> bool:
    return p.name == "address_us" and p in CATALOGUE


def _regex(p: Pattern) -> str:
    return _RUN if _two_steps(p) else p.java


def _value(p: Pattern, match: str) -> str:
    """The part of a raw match that is the value; empty if none is."""
    return f"regexp_extract({match}, {sql_literal(_LAST_STREET)}, 1)" if _two_steps(p) else match


def _raw_sql(text: str, p: Pattern) -> str:
    found = f"regexp_extract_all({text}, {sql_literal(_regex(p))}, 0)"
    if _two_steps(p):
        found = f"filter(transform({found}, m -> {_value(p, 'm')}), v -> v <> '')"
    return f"if({_may_match(text, p)}, {found}, CAST(array() AS array<string>))"


def raw_matches(text: str, p: Pattern) -> Column:
    """All matches of a pattern in a text (a column's name or other SQL), before its check; an empty array without one, or for null."""
    return F.expr(_raw_sql(text, p))


def matches(text: str, p: Pattern) -> Column:
    """The matches that pass the pattern's check."""
    raw = _raw_sql(text, p)
    return F.expr(raw if p.validator is None else f"filter({raw}, v -> {CHECKS[p.validator]('v')})")


def _stage_sql(stage: Stage, make: Token, digit: str) -> str:
    """The chain's state _s (t: text, f: what was replaced) after one stage."""
    p, two = stage.pattern, _two_steps(stage.pattern)
    regex = sql_literal(_regex(p))
    valid = " AND ".join([*(["v <> ''"] if two else []), *([CHECKS[p.validator]("v")] if p.validator else [])])
    made = f"if({valid}, {make(stage, 'v')}, CAST(NULL AS STRING))" if valid else make(stage, "v")
    hits = f"transform(regexp_extract_all(_s.t, {regex}, 0), m -> element_at(transform(array({_value(p, 'm')}), v -> named_struct('m', m, 'v', v, 'token', {made})), 1))"
    shown = "concat(h.token, substring(h.m, length(h.v) + 1))" if two else "h.token"
    text = f"array_join(zip_with(split(_s.t, {regex}, -1), hits, (x, h) -> concat(x, coalesce({shown}, h.m, ''))), '')"
    kept = f"transform(filter(hits, h -> h.token IS NOT NULL), h -> named_struct('ordinal', {stage.ordinal}, 'pii_type', {sql_literal(p.pii_type)}, 'original', h.v, 'token', h.token, 'confidence', {stage.confidence!r}D))"
    changed = f"if(exists(hits, h -> h.token IS NOT NULL), named_struct('t', {text}, 'f', concat(_s.f, CAST({kept} AS {FOUND}))), _s)"
    return f"if({_may_match('_s.t', p, digit)}, element_at(transform(array({hits}), hits -> {changed}), 1), _s) AS _s"


def anonymize(df: DataFrame, column: str, packs: list[str], decay: float = 0.05, patterns: tuple[Pattern, ...] | None = None, out: str = "anonymized", found: str = "found", replacement: Token | None = None) -> DataFrame:
    """`df` with the anonymised text in `out` and what was replaced in `found` (both replace columns of these names). Null and
    empty texts pass through. The chain runs over one row's text at a time, so the plan is a projection whatever the number
    of patterns. The columns _s and _d are the chain's own and must not be in `df`. Unknown packs are warned of.

    replacement: (stage, SQL of the value) -> SQL of what it is replaced by; the plain token by default.
    """
    stages, unknown = load_packs(packs, decay, patterns)
    if unknown:
        warnings.warn(f"unknown packs are skipped: {', '.join(unknown)}", stacklevel=2)
    make = replacement or (lambda s, v: token_sql(s.pattern.pii_type, v))
    # A digit that a plain token brings stands between word characters or before its bracket, where no pattern can use it: a
    # text without a digit has no match of a pattern that needs one, whatever was replaced before.
    kept, text = [sql_name(c) for c in df.columns], sql_name(column)
    done = df.selectExpr(*kept, f"named_struct('t', CAST({text} AS STRING), 'f', CAST(array() AS {FOUND})) AS _s", f"{text} RLIKE '[0-9]' AS _d")
    for stage in stages:
        done = done.selectExpr(*kept, "_d", _stage_sql(stage, make, "" if replacement else "_d"))
    # A filter on a result must not be pushed below the chain: that would write the chain into the filter, once more for each
    # use of a stage's text in the next. An expression that the optimizer takes for non-deterministic stops it.
    kept = [k for c, k in zip(df.columns, kept) if c.lower() not in (out.lower(), found.lower())]
    here = "spark_partition_id() >= 0"
    return done.selectExpr(*kept, f"if({here}, _s.t, NULL) AS {sql_name(out)}", f"if({here}, _s.f, NULL) AS {sql_name(found)}")


def spans(df: DataFrame, key: str, found: str = "found") -> DataFrame:
    """One row per replaced value: key, place (its number within the row), ordinal, pii_type, original, token, confidence."""
    return df.select(key, F.posexplode(found).alias("place", "f")).select(key, "place", "f.*")


def token_map(df: DataFrame, key: str, found: str = "found") -> DataFrame:
    """(key, token, original, ordinal): the distinct mappings of each session."""
    rows = spans(df, key, found).where(F.col(key).isNotNull())
    return rows.groupBy(key, "token").agg(F.min("original").alias("original"), F.max("ordinal").alias("ordinal"))


def token_counts(df: DataFrame, key: str, found: str = "found") -> DataFrame:
    """(key, n_occurrences, n_tokens) of every row, counted within its array: no shuffle."""
    distinct = F.size(F.array_distinct(F.transform(found, lambda f: f.token)))
    return df.select(key, F.size(found).cast("long").alias("n_occurrences"), distinct.cast("long").alias("n_tokens"))


def delete_session(tokens: DataFrame, key: str, session: Column) -> DataFrame:
    return tokens.where(~F.col(key).eqNullSafe(session))
