"""Structured Streaming over response lines: a keyed stateful operator, and the same as a batch."""

from __future__ import annotations

import json
import os
from collections.abc import Iterator
from urllib.parse import quote

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from maskwright.operators.routing import provider
from maskwright.streaming.sse import LineAssembler, StreamRestorer

OUT = "stream_id string, seq long, part long, line string"


def with_tokens(lines: DataFrame, tokens: DataFrame, session: str = "session_id") -> DataFrame:
    """`lines` (stream_id, seq, host, line, last, session) with provider and the session's token map: a stream-static join.
    A session's map is the tokens of one request."""
    once = tokens.groupBy(session, "token").agg(F.min("original").alias("original"))
    maps = once.groupBy(session).agg(F.map_from_entries(F.collect_list(F.struct("token", "original"))).alias("tokens"))
    return lines.join(maps, session, "left").withColumn("provider", provider(F.col("host")))


#: What a stream keeps between micro-batches: text held back, the seq that comes next, lines that came before their turn, the
#: provider, the token map (once, not with every line), bytes of an unfinished line, and the place of the last line written.
STATE = "held string, next long, early string, provider string, tokens string, rest binary, seq long, part long"


class _Stream:
    """One stream, as its lines come."""

    def __init__(self, stream_id: str, kept: tuple | None):
        self.id = stream_id
        held, self.next, early, self.provider, tokens, rest, self.seq, self.part = kept or (None, 0, "{}", None, "{}", b"", 0, -1)
        self.held, self.tokens = held, json.loads(tokens)
        # seq -> (line or chunk of bytes, last)
        self.early = {int(k): (line if chunk is None else bytes.fromhex(chunk), last) for k, (line, chunk, last) in json.loads(early).items()}
        self.lines = LineAssembler(bytes(rest))
        self.out: list[tuple] = []

    def take(self, rows: pd.DataFrame) -> None:
        """Rows in any order; a seq that was seen before is left out."""
        for r in rows.itertuples():
            self.add(int(r.seq), r.line, getattr(r, "chunk", None), bool(r.last), r.provider, r.tokens)

    def add(self, seq: int, line: str | None, chunk: bytes | None, last: bool, provider: str | None, tokens: dict | list | None) -> None:
        if self.provider is None:
            self.provider = provider
        if not self.tokens and tokens is not None:
            self.tokens = dict(tokens)
        if seq >= self.next:
            self.early.setdefault(seq, (line if chunk is None else bytes(chunk), last))

    def _show(self, seq: int, lines: Iterator[str] | list[str]) -> None:
        for line in lines:
            self.part = self.part + 1 if seq == self.seq else 0
            self.seq = seq
            self.out.append((self.id, seq, self.part, line))

    def run(self, over: bool = False) -> bool:
        """Restore what is in turn; over: all there is. Whether the stream has ended."""
        restorer = StreamRestorer(self.provider or "passthrough", self.tokens, self.held)
        for seq in sorted(self.early):
            if not over and seq != self.next:
                break
            body, last = self.early.pop(seq)
            for line in self.lines.feed(body) if isinstance(body, bytes) else [body or ""]:
                self._show(seq, restorer.line(line))
            self.next = seq + 1
            over = over or last
        if over:
            for line in self.lines.end():
                self._show(max(self.seq, self.next - 1), restorer.line(line))
            self._show(max(self.seq, self.next - 1), restorer.end())
        self.held = restorer.state()
        return over

    def kept(self) -> tuple:
        early = {k: (None, b.hex(), last) if isinstance(b, bytes) else (b, None, last) for k, (b, last) in self.early.items()}
        return self.held, self.next, json.dumps(early), self.provider, json.dumps(self.tokens), self.lines.rest, self.seq, self.part


def _columns(lines: DataFrame) -> DataFrame:
    """The operator's columns; what of line and chunk the frame lacks is null."""
    have = [F.col(c) if c in lines.columns else F.lit(None).cast(kind).alias(c) for c, kind in (("line", "string"), ("chunk", "binary"))]
    return lines.select("stream_id", "seq", *have, "last", "provider", "tokens")


def restore_batch(lines: DataFrame) -> DataFrame:
    """(stream_id, seq, part, line) of complete streams, whether or not a line is marked last. Streams are dealt to partitions and
    sorted, and restored as the lines come: a task holds what one stream holds back, not its lines."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stream = None

        def shown(rows: list[tuple]) -> pa.RecordBatch:
            return pa.record_batch([pa.array(c, k) for c, k in zip(zip(*rows), (pa.string(), pa.int64(), pa.int64(), pa.string()))], ["stream_id", "seq", "part", "line"])

        for b in batches:
            out: list[tuple] = []
            ids, seqs, texts, lasts, providers = (b.column(c).to_pylist() for c in ("stream_id", "seq", "line", "last", "provider"))
            chunks, maps = b.column("chunk"), b.column("tokens")
            for i, name in enumerate(ids):
                if stream is None or stream.id != name:
                    if stream is not None:
                        stream.run(over=True)
                        out += stream.out
                    stream = _Stream(name, None)
                tokens = None if stream.tokens else maps[i].as_py()  # a map is the same on every line of its stream
                stream.add(seqs[i], texts[i], chunks[i].as_py() if texts[i] is None else None, bool(lasts[i]), providers[i], tokens)
            if stream is not None:
                if not any(last for _, last in stream.early.values()):  # the rest of it may be in the next batch
                    stream.run()
                out += stream.out
                stream.out = []
            if out:
                yield shown(out)
        if stream is not None:
            stream.run(over=True)
            if stream.out:
                yield shown(stream.out)

    return _columns(lines).repartition("stream_id").sortWithinPartitions("stream_id", "seq").mapInArrow(run, OUT)


def restore_streaming(lines: DataFrame, idle: str | int | None = None) -> DataFrame:
    """(stream_id, seq, part, line) of a streaming frame (stream_id, seq from 0 on, line, last, provider, tokens), as
    `restore_batch` gives them. Lines may come in any order and more than once: what came before its turn waits as state. A
    column `chunk` (bytes, cut anywhere) may stand for the lines.

    A stream ends with its row marked last, and its state is dropped. With `idle` (a duration, or milliseconds) it also ends when
    nothing came for so long: what is held is shown in the first micro-batch after that. Such a query runs micro-batches
    without data, to look at the clock, so it is for triggers by time; an availableNow run of it would not end.
    """
    wait = None if idle is None else idle if isinstance(idle, int) else int(pd.Timedelta(idle).total_seconds() * 1000)

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        stream = _Stream(key[0], state.get if state.exists else None)
        if not state.hasTimedOut:
            for rows in frames:
                stream.take(rows)
        if stream.run(over=state.hasTimedOut):
            state.remove()
        else:
            state.update(stream.kept())
            if wait is not None:
                state.setTimeoutDuration(wait)
        yield pd.DataFrame(stream.out, columns=["stream_id", "seq", "part", "line"])

    return _columns(lines).groupBy("stream_id").applyInPandasWithState(run, OUT, STATE, "append", GroupStateTimeout.NoTimeout if wait is None else GroupStateTimeout.ProcessingTimeTimeout)


def read_chunks(spark: SparkSession, path: str, size: int = 32 << 10, streaming: bool = False) -> DataFrame:
    """(stream_id, seq, chunk, last) of response bodies, a file each, as the reader of a connection would give them: chunks of
    `size` bytes, cut anywhere. The last chunk of a file is marked; an empty file has none, as Spark reads no empty files."""
    reader = spark.readStream if streaming else spark.read
    schema = "path string, modificationTime timestamp, length long, content binary"
    files = (reader.schema(schema) if streaming else reader).format("binaryFile").load(path)
    n = F.greatest(F.lit(1), F.ceil(F.length("content") / size)).cast("int")
    rows = files.select(F.regexp_extract("path", "[^/]*$", 0).alias("stream_id"), "content", n.alias("n"))
    rows = rows.select("stream_id", "content", "n", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("k"))
    return rows.select("stream_id", F.col("k").cast("long").alias("seq"), F.substr("content", F.col("k") * size + 1, F.lit(size)).alias("chunk"), (F.col("k") == F.col("n") - 1).alias("last"))


class FlushingSink:
    """A `foreach` sink that appends each line to its stream's file and flushes it at once, so that a reader sees an event when
    it is restored. A partition's rows of one stream come in order; rows that a retried batch writes again are left out."""

    def __init__(self, folder: str):
        self.folder = folder

    def open(self, partition: int, epoch: int) -> bool:
        os.makedirs(self.folder, exist_ok=True)
        self.seen: dict[str, tuple[int, int]] = {}
        return True

    def _last(self, path: str) -> tuple[int, int]:
        if not os.path.exists(path):
            return -1, -1
        with open(path, encoding="utf-8", newline="") as f:
            rows = [json.loads(x) for x in f if x.endswith("\n")]
        return (rows[-1]["seq"], rows[-1]["part"]) if rows else (-1, -1)

    def process(self, row: Row) -> None:
        path = os.path.join(self.folder, quote(row.stream_id, safe="") + ".jsonl")
        if path not in self.seen:
            self.seen[path] = self._last(path)
        if (row.seq, row.part) > self.seen[path]:
            with open(path, "a", encoding="utf-8") as f:
                f.write(json.dumps({"seq": row.seq, "part": row.part, "line": row.line}) + "\n")
                f.flush()
            self.seen[path] = (row.seq, row.part)

    def close(self, error: Exception | None) -> None:
        self.seen = {}


def choose_path(responses: DataFrame) -> DataFrame:
    """`responses` (content_type, ...) with path: `stream` for event streams, else `buffered`."""
    from maskwright.operators.routing import is_streaming

    return responses.withColumn("path", F.when(is_streaming(F.col("content_type")), "stream").otherwise("buffered"))
