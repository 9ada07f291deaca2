"""Routing of low-confidence values through a verdict table, and the work list of a model that fills it."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

THRESHOLD = 0.7
DETECTION = "array<struct<original:string,type:string,confidence:double>>"


def effective_confidence(base: Column, position: Column, decay: float = 0.05) -> Column:
    return F.greatest(F.lit(0.0), base * (1 - position * F.lit(decay)))


def route(spans: DataFrame, threshold: float = THRESHOLD, use_model: bool = True) -> DataFrame:
    """`spans` (original, token, confidence, ...) with needs_verdict: whether a value's token depends on the verdict table."""
    low = (F.col("confidence") < threshold) if use_model else F.lit(False)
    return spans.withColumn("needs_verdict", low)


def resolve(spans: DataFrame, verdicts: DataFrame, threshold: float = THRESHOLD, use_model: bool = True) -> DataFrame:
    """`spans` with the final token, and whether the verdict table had it (hit, miss or null if it was not asked).

    A verdict may carry another type than the pattern's; an empty token reads as a miss. The join is an equi-join on the
    value, which AQE broadcasts or splits by measured sizes.
    """
    known = verdicts.where("token <> ''").select(F.col("original").alias("_original"), F.col("token").alias("_token")).dropDuplicates(["_original"])
    asked = route(spans, threshold, use_model)
    out = asked.join(known, (F.col("original") == F.col("_original")) & F.col("needs_verdict"), "left")
    outcome = F.when(~F.col("needs_verdict"), F.lit(None)).when(F.col("_token").isNull(), "miss").otherwise("hit")
    return out.withColumn("cache", outcome).withColumn("token", F.coalesce("_token", "token")).drop("_original", "_token", "needs_verdict")


def work_list(spans: DataFrame, verdicts: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(original, n): distinct low-confidence values without a verdict, each asked once."""
    asked = route(spans, threshold).where("needs_verdict").groupBy("original").agg(F.count("*").alias("n"))
    return asked.join(verdicts.where("token <> ''").select("original"), "original", "left_anti")


def parse_response(response: Column) -> Column:
    """Detections in a model's answer: the JSON array between its first and its last square bracket; null if there is none."""
    return F.from_json(F.regexp_extract(response, r"(?s)\[.*\]", 0), DETECTION)


def verdicts_of(responses: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(original, token) rows of answers (column response): detections that name a value and reach the threshold; the last by
    answer order is not defined, so the smallest token of a value is taken."""
    from maskwright.functions.tokens import token

    rows = responses.select(F.explode(parse_response(F.col("response"))).alias("d")).select("d.*")
    rows = rows.where((F.col("original") != "") & (F.col("confidence") >= threshold))
    return rows.select("original", token(F.col("type"), F.col("original")).alias("token")).groupBy("original").agg(F.min("token").alias("token"))


def verify(work: DataFrame, ask: Callable[[str], str], parallel: int = 1) -> DataFrame:
    """(original, response): `ask` called once for each value, in at most `parallel` tasks at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.record_batch([b.column("original"), pa.array([ask(v) for v in b.column("original").to_pylist()], pa.string())], ["original", "response"])

    return work.select("original").repartition(parallel, "original").mapInArrow(run, "original string, response string")


def instruction_for(models: DataFrame, instructions: DataFrame, fallback: str) -> DataFrame:
    """`models` (model) with instruction: that of the longest key that the model's name begins with, else the key `default`,
    else `fallback`. The instructions are a configuration table of a few rows."""
    rule = F.when(F.col("key") != "default", F.struct(F.length("key").alias("n"), "key", "instruction"))
    rules = instructions.agg(F.collect_list(rule).alias("_all"), F.max(F.when(F.col("key") == "default", F.col("instruction"))).alias("_default"))
    found = F.array_max(F.filter("_all", lambda k: F.col("model").startswith(k["key"])))
    return models.crossJoin(F.broadcast(rules)).withColumn("instruction", F.coalesce(found["instruction"], "_default", F.lit(fallback))).drop("_all", "_default")  # one row
