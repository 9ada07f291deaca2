"""Bounded-space online packing of token ids into windows.

Each partition keeps a fixed number of open windows. A document first fills whole windows of its own; the rest goes, whole,
to the open window that it leaves least room in (best fit). If it fits none, it opens another window while fewer than
`open_windows` are open; else the fullest window is topped up with the document's next ids and emitted, so no window leaves
with padding. At the end of the partition the windows still open are merged: their pieces are laid end to end, cut into full
windows, and what is left (less than a window) into sequences whose lengths are powers of two, which need no padding.

One map pass, no shuffle: memory is `open_windows` windows a task whatever the input, a lost task is simply run again (its
input split, and so its sequence ids, are the same), and padding is zero at any number of partitions.

Defined cases: null text is the empty text, whose only id is the end id; repeated rows and doc_ids are packed as documents of
their own; a null doc_id stays null; an empty table gives no rows; extra columns pass by unread.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from maskwright.llm.common import slices
from maskwright.llm.tokens import coder

Piece = tuple[int | None, int, np.ndarray, int]  # doc_id, start, ids, the document's number of ids
SCHEMA = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"


class Packer:
    """Packs a stream of documents; every method returns the sequences that are complete."""

    def __init__(self, window: int = 4096, open_windows: int = 64):
        self.window, self.most = window, open_windows
        self.held: dict[int, list[Piece]] = {}
        self.room: list[tuple[int, int]] = []  # (free ids, key) of the open windows, sorted
        self.next = 0

    def add(self, doc_id: int | None, ids: np.ndarray) -> Iterator[list[Piece]]:
        n, at = len(ids), 0
        while n - at >= self.window:
            yield [(doc_id, at, ids[at : at + self.window], n)]
            at += self.window
        while at < n:
            need = n - at
            fit = bisect_left(self.room, (need, -1))
            if fit < len(self.room):
                free, key = self.room.pop(fit)
            elif len(self.room) < self.most:
                free, key = self.window, self.next
                self.held[key] = []
                self.next += 1
            else:
                free, key = self.room.pop(0)
                need = free
            self.held[key].append((doc_id, at, ids[at : at + need], n))
            at += need
            if free > need:
                insort(self.room, (free - need, key))
            else:
                yield self.held.pop(key)

    def close(self) -> Iterator[list[Piece]]:
        pieces = [p for _, key in self.room for p in self.held[key]]
        left = sum(len(p[2]) for p in pieces)
        self.held, self.room = {}, []
        sequence: list[Piece] = []
        size = used = 0
        for doc_id, start, ids, n in pieces:
            at = 0
            while at < len(ids):
                if not sequence:
                    size, used = self.window if left >= self.window else 1 << (left.bit_length() - 1), 0
                take = min(size - used, len(ids) - at)
                sequence.append((doc_id, start + at, ids[at : at + take], n))
                at, used, left = at + take, used + take, left - take
                if used == size:
                    yield sequence
                    sequence = []


def _rows(sequences: list[list[Piece]], first: int) -> pa.RecordBatch:
    doc, start, ids, total, seq, offset = [], [], [], [], [], []
    for k, pieces in enumerate(sequences):
        at = 0
        for d, s, x, n in pieces:
            doc.append(d), start.append(s), ids.append(x.astype("<u4", copy=False).tobytes()), total.append(n), seq.append(first + k), offset.append(at)
            at += len(x)
    length = [len(x) // 4 for x in ids]
    cols = [pa.array(doc, pa.int64()), *(pa.array(x, pa.int64()) for x in (start, length)), pa.array(ids, pa.binary()), *(pa.array(x, pa.int64()) for x in (total, seq, offset))]
    return pa.record_batch(cols, ["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"])


def pack(docs: DataFrame, tokenizer_path: str, end_id: int = 2, window: int = 4096, open_windows: int = 64) -> DataFrame:
    """Pieces of all documents: doc_id, start, length, ids (little-endian 32-bit), doc_tokens, sequence_id, offset."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        seq = (context.partitionId() if context else 0) << 40
        words, packer, out = coder(tokenizer_path), Packer(window, open_windows), []
        for b in slices(batches, limit=1 << 20, keep="tokens"):
            flat, lengths = words.encode(b.column("text").to_pylist())
            at = 0
            for doc_id, n in zip(b.column("doc_id").to_pylist(), lengths.tolist()):
                out += packer.add(doc_id, np.append(flat[at : at + n], np.uint32(end_id)))
                at += n
            if out:
                yield _rows(out, seq)
                seq, out = seq + len(out), []
        if out := list(packer.close()):
            yield _rows(out, seq)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, SCHEMA)


def piece_digests(pieces: DataFrame) -> DataFrame:
    """The pieces with the checksum of their ids in place of the ids."""
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
