"""Reversal of tokens: a fold in reverse order of stages, and a single pass for streams."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from maskwright.functions.tokens import TOKEN


def fold(text: Column, pairs: Column) -> Column:
    """Replace every token of `pairs` (array of structs with ordinal, token, original), last stage first, so that a token
    inside a later stage's original is reversed too."""
    ordered = F.sort_array(F.transform(pairs, lambda p: F.struct(p.ordinal.alias("ordinal"), p.token.alias("token"), p.original.alias("original"))), asc=False)
    return F.when(F.coalesce(F.size(pairs), F.lit(0)) > 0, F.aggregate(F.array_distinct(ordered), text, lambda acc, p: F.replace(acc, p.token, p.original))).otherwise(text)


def deanonymize(df: DataFrame, column: str, tokens: DataFrame, key: str, out: str = "restored") -> DataFrame:
    """Join each session's map (key, token, original, ordinal) to its texts and reverse it. Sessions without a map, and null
    keys, keep their text. A session's map is the tokens of one request, so its list stays small."""
    lists = tokens.groupBy(key).agg(F.collect_list(F.struct("ordinal", "token", "original")).alias("_pairs"))
    return df.join(lists, key, "left").withColumn(out, fold(F.col(column), F.col("_pairs"))).drop("_pairs")


def single_pass(text: Column, mapping: Column) -> Column:
    """Replace all tokens at once by a map column; unknown tokens stay, and nothing is replaced twice."""
    found = F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0))
    pieces = F.zip_with(F.split(text, TOKEN, -1), found, lambda x, t: F.concat(x, F.coalesce(F.element_at(mapping, t), t, F.lit(""))))
    return F.when(text.rlike(TOKEN) & (F.size(mapping) > 0), F.array_join(pieces, "")).otherwise(text)
