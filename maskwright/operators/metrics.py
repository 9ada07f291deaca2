"""Run metrics as aggregates: request classes, token volume, verdict hits, latencies, and one nested snapshot."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from maskwright.functions.patterns import MODEL_TYPES, pii_types


def known_types(spark) -> DataFrame:
    """The types that are counted: those of patterns and those that only a model names."""
    return spark.createDataFrame([(t,) for t in sorted({*pii_types(), *MODEL_TYPES})], "pii_type string")


def request_counts(requests: DataFrame) -> DataFrame:
    """(class, n) of requests by their class, with a total."""
    each = requests.groupBy("class").agg(F.count("*").alias("n"))
    return each.unionByName(requests.agg(F.count("*").alias("n")).select(F.lit("total").alias("class"), "n"))


def error_counts(requests: DataFrame, upstream: str = "upstream_error", anonymize: str = "anonymize_error") -> DataFrame:
    """(n_upstream_errors, n_anonymize_errors): requests whose column names an error of either kind; null and empty name none."""
    failed = lambda c: F.count_if(F.coalesce(F.col(c) != "", F.lit(False)))
    return requests.agg(failed(upstream).alias("n_upstream_errors"), failed(anonymize).alias("n_anonymize_errors"))


def token_volume(spans: DataFrame, session: str) -> DataFrame:
    """(n_replaced, n_deanonymized): every occurrence counts as replaced, each distinct token of a session as reversed."""
    per = spans.groupBy(session).agg(F.count("*").alias("a"), F.count_distinct("token").alias("b"))
    return per.agg(F.coalesce(F.sum("a"), F.lit(0)).alias("n_replaced"), F.coalesce(F.sum("b"), F.lit(0)).alias("n_deanonymized"))


def verdict_counts(resolved: DataFrame) -> DataFrame:
    """(pii_type, n_hits, n_misses) of the values that the verdict table was asked for; unknown types are left out."""
    kinds = known_types(resolved.sparkSession)
    out = resolved.where("cache is not null").groupBy("pii_type").agg(F.count_if(F.col("cache") == "hit").alias("n_hits"), F.count_if(F.col("cache") == "miss").alias("n_misses"))
    return out.join(F.broadcast(kinds), "pii_type", "left_semi")  # some 30 rows


def model_counts(resolved: DataFrame, responses: DataFrame) -> DataFrame:
    """(n_dispatches, n_errors, n_fallbacks): values sent to the model, answers that hold no array, tokens given meanwhile."""
    from maskwright.operators.confidence import parse_response

    asked = resolved.where("cache = 'miss'").agg(F.count_distinct("original").alias("n_dispatches"), F.count("*").alias("n_fallbacks"))
    bad = responses.agg(F.count_if(parse_response(F.col("response")).isNull()).alias("n_errors"))
    return asked.crossJoin(bad)  # one row each


def latency(samples: DataFrame, by: str = "dimension", value: str = "ms") -> DataFrame:
    """(by, n, min_ms, mean_ms, max_ms), to two decimals."""
    two = lambda c: F.round(c, 2)
    return samples.where(F.col(value).isNotNull()).groupBy(by).agg(F.count("*").alias("n"), two(F.min(value)).alias("min_ms"), two(F.avg(value)).alias("mean_ms"), two(F.max(value)).alias("max_ms"))


def rollup(spans: DataFrame, *by: str) -> DataFrame:
    """Counts of replaced values over every level of `by`, the grand total included."""
    return spans.rollup(*by).agg(F.count("*").alias("n"), F.count_distinct("token").alias("n_tokens"))


def snapshot(spans: DataFrame, samples: DataFrame, session: str) -> DataFrame:
    """One row, one JSON document: token volume, non-zero counts by type, latencies by dimension."""
    kinds = spans.groupBy("pii_type").agg(F.count("*").alias("n"))  # some 30 rows
    types = kinds.agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("pii_type", "n")))).alias("types"))
    times = latency(samples).agg(F.array_sort(F.collect_list(F.struct("dimension", "n", "min_ms", "mean_ms", "max_ms"))).alias("latency"))
    return token_volume(spans, session).crossJoin(types).crossJoin(times).select(F.to_json(F.struct("n_replaced", "n_deanonymized", "types", "latency")).alias("snapshot"))
