"""Shared helpers: batch slicing, string buffers, worker memory; table access and materialisation are the library's own."""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

from maskwright.sources.tables import discard, materialize, shared_dir, table

__all__ = ["discard", "fresh", "materialize", "release_memory", "shared_dir", "slices", "string_bytes", "table", "text_or_empty", "worker_cache"]


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def fresh(name: str, columns: list[str]) -> str:
    """`name`, with underscores before it until no column is called so (in any case)."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name = "_" + name
    return name


_CACHES: dict[str, dict] = {}


def worker_cache(name: str) -> dict:
    """What an operator keeps in a Python worker from task to task; another operator's tasks there drop it."""
    return _CACHES.setdefault(name, {})


def slices(batches: Iterator[pa.RecordBatch], column: str = "text", limit: int = 4 << 20, keep: str = "") -> Iterator[pa.RecordBatch]:
    """Cut record batches so that the strings of each slice hold about `limit` bytes (one row at least).

    keep: the operator's own worker_cache, if it has one.
    """
    for name, cache in _CACHES.items():
        if name != keep:
            cache.clear()
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        sizes = pc.binary_length(batch.column(column)).fill_null(0).to_numpy(zero_copy_only=False)
        at, ends = 0, np.cumsum(sizes)
        while at < n:
            base = ends[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(ends, base + limit, side="right")))
            yield batch.slice(at, to - at)
            at = to
    batch = None
    release_memory()


def release_memory() -> None:
    """Give freed memory back to the system: Python workers are kept between tasks, and so is what their allocators hold."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # not glibc
        pass


def string_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column, one after the other, and the n + 1 offsets of its rows; null counts as empty."""
    if column.null_count:
        column = column.fill_null("")
    large = column.type in (pa.large_string(), pa.large_binary())
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, np.int64 if large else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[off[0] : off[-1]], off - off[0]
