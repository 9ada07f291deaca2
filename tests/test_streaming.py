"""Streams: every cut of every format restores the text; the stateful operator agrees with the batch."""

import json
import shutil
import time

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from maskwright.plans.queries import _event
from maskwright.streaming.restore import FlushingSink, read_chunks, restore_batch, restore_streaming
from maskwright.streaming.sse import StreamRestorer, restore_stream, safe_cut

TOK, TOK2 = "[PII_EMAIL_c160f8cc4b2e1a3d]", "[PII_INSURANCEID_0123456789abcdef]"
MAP = {TOK: 'earl "e" <é>@example.com', TOK2: "ID-1"}
PATHS = {
    "anthropic": lambda d: d["delta"]["text"], "openai": lambda d: d["choices"][0]["delta"]["content"],
    "gemini": lambda d: d["candidates"][0]["content"]["parts"][0]["text"], "cohere": lambda d: d["delta"]["message"]["content"]["text"], "replicate": None,
}


def shown(provider, out):
    lines = [x[6:] for x in out.split("\n") if x.startswith("data: ")]
    return "".join(lines if PATHS[provider] is None else [PATHS[provider](json.loads(x)) for x in lines])


@pytest.mark.parametrize("provider", PATHS)
def test_every_cut(provider):
    text = f"é {TOK}{TOK2} a[b] [PII_X {TOK}"
    want = text.replace(TOK, MAP[TOK]).replace(TOK2, MAP[TOK2])
    for cut in range(1, len(text)):
        body = "\n".join(_event(provider, t) for t in (text[:cut], text[cut:])) + "\n"
        assert shown(provider, restore_stream([body.encode()], provider, MAP)) == want, cut
    body = "".join(_event(provider, c) + "\r\n\r\n" for c in text).encode()
    for size in (1, 7, 64):
        assert shown(provider, restore_stream([body[i : i + size] for i in range(0, len(body), size)], provider, MAP)) == want


def test_safe_cut():
    assert safe_cut("abc") == 3 and safe_cut("abc[") == 3 and safe_cut("x" + TOK[:-1]) == 1 and safe_cut(TOK) == len(TOK) and safe_cut("[x") == 2


def test_other_events():
    r = StreamRestorer("anthropic", MAP)
    held = list(r.line(_event("anthropic", "hi " + TOK[:9])))
    assert json.loads(held[0][6:])["delta"]["text"] == "hi "
    out = list(r.line('data: {"type":"content_block_stop","index":0}'))
    assert json.loads(out[0][6:])["delta"]["text"] == TOK[:9] and "stop" in out[1]
    assert list(r.line(": ping")) == [": ping"] and list(r.line("")) == [""] and list(r.line("event: x " + TOK2)) == ["event: x ID-1"]
    agent = list(r.line("data: " + json.dumps({"type": "agent.tool_use", "input": {"a": [TOK]}, "keep": 1})))
    assert json.loads(agent[0][6:]) == {"type": "agent.tool_use", "input": {"a": [MAP[TOK]]}, "keep": 1}
    assert list(StreamRestorer("openai", {}).line("data: x")) == ["data: x"] and list(StreamRestorer("openai", MAP).line("data: [DONE]")) == ["data: [DONE]"]


SCHEMA = "stream_id string, seq long, line string, last boolean, provider string, tokens map<string,string>"


def run_stream(spark, tmp_path, batches, schema=SCHEMA, idle=None):
    """The sink's rows after each micro-batch, in which the operator got the rows of `batches`."""
    seen = []
    source = tmp_path / "in"
    source.mkdir()
    lines = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"file://{source}")
    query = restore_streaming(lines, idle).writeStream.foreachBatch(lambda df, n: seen.append(df.collect())).option("checkpointLocation", f"file://{tmp_path}/cp")
    for k, rows in enumerate(batches):
        made = tmp_path / f"made{k}"
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"file://{made}")
        shutil.copy(next(made.glob("part*")), source / f"{k}.parquet")
        if idle is None:
            run = query.trigger(availableNow=True).start()
            assert run.awaitTermination(60) and run.exception() is None
    if idle is not None:
        run = query.trigger(processingTime="0 seconds").start()
        until = time.time() + 60
        while time.time() < until and not any(r.line and TOK[:9] in r.line for b in seen for r in b):
            time.sleep(0.5)
        run.stop()
    return seen


def test_stateful_operator_equals_batch(spark, tmp_path):
    """All providers at once; lines out of order across batches, one of them twice."""
    text, rows = f"é {TOK} b{TOK2}[x", []
    for name in [*PATHS, "passthrough"]:
        size = 5 if name != "passthrough" else 1000
        pieces = [text[i : i + size] for i in range(0, len(text), size)]
        rows += [(f"s-{name}", i, _event(name, p), i == len(pieces) - 1, name, MAP) for i, p in enumerate(pieces)]
    batches = [[r for r in rows if r[1] % 3 == 1], [r for r in rows if r[1] % 3 == 2] + rows[1:2], [r for r in rows if r[1] % 3 == 0]]
    got = sorted(tuple(r) for b in run_stream(spark, tmp_path, batches) for r in b)
    want = sorted(tuple(r) for r in restore_batch(spark.createDataFrame(rows, SCHEMA)).collect())
    assert got == want
    for name in PATHS:
        assert shown(name, "\n".join(x[3] for x in want if x[0] == f"s-{name}")) == text.replace(TOK, MAP[TOK]).replace(TOK2, MAP[TOK2])


def test_stream_without_a_last_line_ends_by_time(spark, tmp_path):
    rows = [("s", 0, _event("openai", "hi " + TOK[:9]), False, "openai", MAP)]
    out = [r for b in run_stream(spark, tmp_path, [rows], idle=1) for r in b]
    assert [PATHS["openai"](json.loads(r.line[6:])) for r in out] == ["hi ", TOK[:9]]


def test_chunks_of_bytes(spark, tmp_path):
    text = f"é {TOK} end"
    body = "".join(_event("cohere", c) + "\r\n\r\n" for c in text).encode()
    (tmp_path / "bodies").mkdir()
    (tmp_path / "bodies" / "one").write_bytes(body)
    (tmp_path / "bodies" / "none").write_bytes(b"")
    chunks = read_chunks(spark, f"file://{tmp_path}/bodies", size=7)
    assert chunks.where("stream_id = 'one'").count() == -(-len(body) // 7) and chunks.where("stream_id = 'none'").count() == 0
    rows = chunks.withColumn("provider", F.lit("cohere")).withColumn("tokens", F.lit(None).cast("map<string,string>"))
    rows = rows.withColumn("tokens", F.create_map(*(F.lit(x) for kv in MAP.items() for x in kv)))
    out = [r.line for r in sorted(restore_batch(rows).where("stream_id = 'one'").collect(), key=lambda r: (r.seq, r.part))]
    assert shown("cohere", "\n".join(out)) == text.replace(TOK, MAP[TOK])
    stream = read_chunks(spark, f"file://{tmp_path}/bodies", size=7, streaming=True)
    assert stream.isStreaming and stream.columns == chunks.columns


def test_flushing_sink(tmp_path):
    sink = FlushingSink(str(tmp_path / "out"))
    rows = [Row(stream_id="a/b", seq=s, part=p, line=f"{s}.{p}") for s, p in ((0, 0), (0, 1), (1, 0))]
    assert sink.open(0, 0)
    for r in rows:
        sink.process(r)
        file = tmp_path / "out" / "a%2Fb.jsonl"
        assert json.loads(file.read_text().splitlines()[-1])["line"] == r.line  # there before the next one
    sink.close(None)
    sink.open(0, 0)
    for r in rows:  # a retried batch
        sink.process(r)
    assert len(file.read_text().splitlines()) == 3


def test_long_texts_in_linear_time(spark, tmp_path):
    """A text of 1 MB is cut, and its stream restored, in time by its length, not by its square."""
    from maskwright.plans.queries import QUERIES

    texts = [("é\n🙂 a[PII_ \r\n\"x\" " * 62_500)[:1_000_000], "", None, "short"]
    spark.createDataFrame([(7, k, "user", t) for k, t in enumerate(texts)], "conv_id long, turn long, role string, text string").write.parquet(f"file://{tmp_path}/conversations.parquet")
    for name, plain in (("replicate", True), ("openai", False)):
        began = time.time()
        got = {r.stream_id: r.shown for r in QUERIES[f"stream_deanonymize_{name}"](spark, f"file://{tmp_path}").collect()}
        assert time.time() - began < 45, name
        mail = "user7@example.com"
        said = [(t or "").replace("\n", " ").replace("\r", " ") if plain else t or "" for t in texts]
        assert got == {f"7-{k}": f"{t} hello {mail} and {mail}!" for k, t in enumerate(said)}
