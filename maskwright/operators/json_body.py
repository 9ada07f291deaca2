"""Anonymisation of JSON request bodies: every string value but structural ones, at any depth; and the system instruction.

Python only takes bodies apart and puts them together (Arrow batches); the pattern chain itself stays native. A body becomes one
row for each string leaf, and the rows of a body stay one after the other in their partition: the plan between has narrow steps
only, so bodies are put together again as the rows come, and nothing is shuffled.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from maskwright.functions import gojson
from maskwright.operators.anonymize import anonymize

#: Keys whose values are never changed.
STRUCTURAL = frozenset(("model", "temperature", "max_tokens", "top_p", "stream", "n"))
_LEAF_ROWS = 4096  # rows of an Arrow batch of leaves


def walk(v: Any, change: Callable[[str], str], skip: frozenset[str] = STRUCTURAL) -> Any:
    """The value with `change` applied to every string leaf; keys, and the values of `skip` keys, stay."""
    if isinstance(v, str):
        return change(v)
    if isinstance(v, list):
        return [walk(x, change, skip) for x in v]
    if isinstance(v, dict):
        return {k: x if k in skip else walk(x, change, skip) for k, x in v.items()}
    return v


def leaves(v: Any) -> list[str]:
    out: list[str] = []
    walk(v, lambda s: out.append(s) or s)
    return out


def inject(doc: Any, instruction: str) -> Any:
    """The document with the instruction in its system prompt: the `system` field (text or blocks), else the first system
    message, else a new first message. Bodies of neither shape stay."""
    if not instruction or not isinstance(doc, dict):
        return doc
    joined = lambda old: f"{old}\n\n{instruction}" if old else instruction
    if isinstance(doc.get("system"), str):
        return doc | {"system": joined(doc["system"])}
    if isinstance(doc.get("system"), list):
        return doc | {"system": [*doc["system"], {"type": "text", "text": instruction}]}
    messages = doc.get("messages")
    if isinstance(messages, list):
        for i, m in enumerate(messages):
            if isinstance(m, dict) and m.get("role") == "system":
                if isinstance(m.get("content"), str):
                    return doc | {"messages": [*messages[:i], m | {"content": joined(m["content"])}, *messages[i + 1 :]]}
                return doc
        return doc | {"messages": [{"role": "system", "content": instruction}, *messages]}
    return doc


def body_leaves(df: DataFrame, key: str, body: str) -> DataFrame:
    """(key, body, n, leaf): a row for each string leaf of each body, in order. The first row has the body and the number of its
    rows; a body without a leaf has one row with a null leaf, a body that is no JSON one row with itself as leaf and n = -1."""
    kind = df.schema[key].dataType.simpleString()

    def take_apart(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = None
        held: list[tuple] = []

        def batch() -> pa.RecordBatch:
            return pa.record_batch([pa.array(c, k) for c, k in zip(zip(*held), kinds)], ["key", "body", "n", "leaf"])

        for b in batches:
            kinds = (b.column("key").type, pa.string(), pa.int32(), pa.string())
            for k, text in zip(b.column("key").to_pylist(), b.column("body").to_pylist()):
                try:
                    found = [None] if text is None else leaves(gojson.parse(text)) or [None]
                    held.append((k, text, len(found), found[0]))
                    held += [(k, None, 0, leaf) for leaf in found[1:]]
                except (ValueError, RecursionError):
                    held.append((k, text, -1, text))
                if len(held) >= _LEAF_ROWS:
                    yield batch()
                    held.clear()
        if held:
            yield batch()

    return df.select(F.col(key).alias("key"), F.col(body).cast("string").alias("body")).mapInArrow(take_apart, f"key {kind}, body string, n int, leaf string")


def anonymize_bodies(df: DataFrame, key: str, body: str, packs: list[str], decay: float = 0.05, instructions: dict[str, str] | None = None) -> DataFrame:
    """(key, anonymized) of JSON bodies; a body that is no JSON is anonymised as plain text, null stays null.

    instructions: by model prefix (the longest that fits), with `default`; injected where the body got a token.
    """
    kind = df.schema[key].dataType.simpleString()
    rows = anonymize(body_leaves(df, key, body), "leaf", packs, decay)
    asked = dict(instructions or {})

    def whole(text: str | None, n: int, parts: list[str | None], replaced: int) -> str | None:
        if text is None or n < 0:
            return parts[0]
        doc, new = gojson.parse(text), iter(parts)
        out = walk(doc, lambda s: next(new))
        if replaced and asked:
            model = doc.get("model") if isinstance(doc, dict) else None
            fit = max((k for k in asked if k != "default" and isinstance(model, str) and model.startswith(k)), key=len, default="default")
            out = inject(out, asked.get(fit, ""))
        return gojson.write(out)

    def put_together(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, replaced, first = [], 0, None  # of the body that is being put together
        for b in batches:
            keys, out = [], []
            for k, text, n, leaf, hits in zip(*(b.column(c).to_pylist() for c in ("key", "body", "n", "anonymized", "hits"))):
                if n:
                    first, parts, replaced = (k, text, n), [], 0
                parts.append(leaf)
                replaced += hits
                if len(parts) == abs(first[2]):
                    keys.append(first[0])
                    out.append(whole(first[1], first[2], parts, replaced))
            yield pa.record_batch([pa.array(keys, b.column("key").type), pa.array(out, pa.string())], ["key", "anonymized"])

    slim = rows.select("key", "body", "n", "anonymized", F.size("found").alias("hits"))
    return slim.mapInArrow(put_together, f"key {kind}, anonymized string").withColumnRenamed("key", key)


def found_in_bodies(df: DataFrame, key: str, body: str, packs: list[str], decay: float = 0.05) -> DataFrame:
    """(key, found) of the same bodies, a row for each leaf with a replaced value: what was replaced, for the token map."""
    found = anonymize(body_leaves(df, key, body), "leaf", packs, decay).where(F.size("found") > 0)
    return found.select(F.col("key").alias(key), "found")
