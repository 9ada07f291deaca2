"""Routing, verdicts, JSON bodies, cache replay, metrics, configuration and sources."""

import gzip
import io
import json
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from maskwright.functions import gojson
from maskwright.functions.tokens import session_id
from maskwright.operators import confidence as C
from maskwright.operators import metrics as M
from maskwright.operators import routing as R
from maskwright.operators.json_body import anonymize_bodies, inject
from maskwright.operators.s3fifo import S3Fifo
from maskwright.plans import fixtures as X
from maskwright.sources import config, tables
from maskwright.sources.log import Log


def test_globs_and_providers(spark):
    df = spark.createDataFrame(list(X.GLOBS), "g string, h string, ok boolean")
    assert df.where(R.glob_match(F.col("g"), F.col("h")) != F.col("ok")).count() == 0
    hosts = spark.createDataFrame([("API.OpenAI.com.",), ("x.openai.azure.com",), ("eu-aiplatform.googleapis.com",), ("bedrock-runtime.a.amazonaws.com",), ("x",), (None,)], "h string")
    assert [r[0] for r in hosts.select(R.provider(F.col("h"))).collect()] == ["openai", "openai", "gemini", "passthrough", "passthrough", "passthrough"]


def test_auth_private_and_domains(spark):
    auth = R.with_clean_path(spark.createDataFrame(list(X.AUTH_CASES), "host string, path string, ok boolean"))
    assert auth.where(R.is_auth_request(F.col("host"), F.col("clean_path")) != F.col("ok")).count() == 0
    private = R.with_private(spark.createDataFrame(list(X.ADDRESSES), "host string, ok boolean"))
    assert private.where("is_private <> ok").count() == 0 and private.count() == len(X.ADDRESSES)
    good = {r[0] for r in spark.createDataFrame([(d,) for d in X.DOMAINS], "d string").where(R.valid_domain(F.col("d"))).collect()}
    assert "*.openai.azure.com" in good and not good & {"*", "*.com", "foo.*", "*.*.com", "", "a..b", "x_y.com", "a*b*c.d.e"}


def test_verdicts(spark):
    spans = spark.createDataFrame([(1, "a", "[t1]", 0.5), (1, "b", "[t2]", 0.5), (1, "c", "[t3]", 0.9), (2, "b", "[t2]", 0.5)], "doc_id long, original string, token string, confidence double")
    verdicts = spark.createDataFrame([("a", "[v]"), ("b", ""), ("c", "[w]")], "original string, token string")
    got = {(r.doc_id, r.original): (r.token, r.cache) for r in C.resolve(spans, verdicts).collect()}
    assert got == {(1, "a"): ("[v]", "hit"), (1, "b"): ("[t2]", "miss"), (1, "c"): ("[t3]", None), (2, "b"): ("[t2]", "miss")}
    assert [tuple(r) for r in C.work_list(spans, verdicts).collect()] == [("b", 2)]
    asked = C.verify(C.work_list(spans, verdicts), lambda v: json.dumps([{"original": v, "type": "name", "confidence": 0.8}]))
    assert C.verdicts_of(asked).first().token.startswith("[PII_NAME_")


def test_numbers_and_escapes():
    cases = {"1.0": "1", "0.5": "0.5", "1e21": "1e+21", "1e20": "100000000000000000000", "1e-7": "1e-07", "0.000001": "0.000001", "123456789012345678": "123456789012345680", "-0.0": "-0", "1.5e300": "1.5e+300", "12.25": "12.25"}
    assert {k: gojson.write(gojson.parse(k)) for k in cases} == cases
    assert gojson.write({"b": "<é&>", "a": [True, None]}) == '{"a":[true,null],"b":"\\u003cé\\u0026\\u003e"}'
    with pytest.raises(ValueError):
        gojson.parse("NaN")


def test_injection_shapes():
    assert inject({"system": "s"}, "I")["system"] == "s\n\nI" and inject({"system": ""}, "I")["system"] == "I"
    assert inject({"system": [{"type": "text", "text": "s"}]}, "I")["system"][1] == {"type": "text", "text": "I"}
    assert inject({"messages": [{"role": "user", "content": "x"}]}, "I")["messages"][0] == {"role": "system", "content": "I"}
    odd = {"messages": [{"role": "system", "content": 5}, {"role": "system", "content": "x"}]}
    assert inject(odd, "I") == odd and inject({"input": "x"}, "I") == {"input": "x"} and inject([1], "I") == [1]


def test_bodies(spark):
    rows = [(1, '{"model":"gpt-x@a.com","messages":[{"role":"user","content":"hi bob@x.com"}],"n":1}'), (2, "plain bob@x.com"), (3, None), (4, '{"model":"claude","system":"s","a":"bob@x.com"}'), (5, '{"a":"clean"}'), (6, "[]")]
    got = {r.id: r.anonymized for r in anonymize_bodies(spark.createDataFrame(rows, "id long, body string"), "id", "body", ["GLOBAL"], instructions={"gpt": "G", "default": "D"}).collect()}
    one = json.loads(got[1])
    assert one["model"] == "gpt-x@a.com" and one["messages"][0] == {"role": "system", "content": "G"} and "[PII_EMAIL_" in one["messages"][1]["content"]
    assert got[2].startswith("plain [PII_EMAIL_") and got[3] is None and json.loads(got[4])["system"] == "s\n\nD" and got[5] == '{"a":"clean"}' and got[6] == "[]"


def test_s3fifo():
    c = S3Fifo(10)
    for i in range(10):
        c.set(f"k{i}", "v")
    c.get("k0")
    c.set("new", "v")
    assert c.place("k0") == "main" and c.place("k1") == "ghost" and c.get("k1") is None
    c.set("k1", "v")
    assert c.place("k1") == "main"
    for i in range(100):
        c.set(f"n{i}", "v")
        assert len(c.small) + len(c.main) <= 10 and len(c.ghosts) <= 4
    c.delete("k1")
    assert c.place("k1") == "none" and S3Fifo(0).capacity == 2


def test_metrics(spark):
    samples = spark.createDataFrame([("a", 1.005), ("a", 3.0), ("b", None)], "dimension string, ms double")
    assert [tuple(r)[:2] for r in M.latency(samples).collect()] == [("a", 2)]
    spans = spark.createDataFrame([(1, "EMAIL", "t"), (1, "EMAIL", "t"), (2, "SSN", "u")], "doc_id long, pii_type string, token string")
    assert tuple(M.token_volume(spans, "doc_id").first()) == (3, 2)
    assert json.loads(M.snapshot(spans, samples, "doc_id").first()[0])["types"] == {"EMAIL": 2, "SSN": 1}


def test_config(tmp_path):
    file = tmp_path / "c.json"
    file.write_text('{"packDecayRate": 7, "enabledPacks": ["US"], "useAIDetection": true}')
    c = config.load(str(file), {"USE_AI_DETECTION": "false", "AI_CONFIDENCE_THRESHOLD": "x", "ENABLED_PACKS": "DE, FR"}, {"ai_model": "m"})
    assert (c.pack_decay, c.enabled_packs, c.use_ai, c.ai_confidence, c.ai_model) == (1.0, ("DE", "FR"), False, 0.7, "m")
    assert config.parse_env_file("# c\n\nA = 'x y'\nB=\"\nC=a=b") == {"A": "x y", "B": '"', "C": "a=b"}
    for bad in ("A", "=x"):
        with pytest.raises(ValueError):
            config.parse_env_file(bad)


def test_sources(spark, tmp_path):
    raw = b"hello"
    deflate = zlib.compressobj(wbits=-15)
    rows = [(bytearray(gzip.compress(raw)), "gzip"), (bytearray(deflate.compress(raw) + deflate.flush()), "deflate"), (bytearray(b"x"), "br"), (bytearray(b"bad"), "gzip"), (None, None)]
    got = {(bytes(r.body) if r.body is not None else None, r.encoding) for r in tables.decompress(spark.createDataFrame(rows, "body binary, encoding string")).collect()}
    assert got == {(raw, None), (b"x", "br"), (b"bad", "gzip"), (None, None)}
    store = tables.VerdictTable(spark, f"file://{tmp_path}/verdicts")
    frame = lambda *r: spark.createDataFrame(list(r), "original string, token string")
    assert store.read().count() == 0
    store.put(frame(("a", "1"), ("b", "2")))
    store.put(frame(("a", "3"), ("c", "")))
    store.delete(frame(("b", None)))
    store.compact()
    assert [tuple(r) for r in store.read().collect()] == [("a", "3")]
    path = f"file://{tmp_path}/domains.json"
    assert tables.load_domains(spark, path, ["x.com"]).all() == ["x.com"]
    tables.save_domains(spark, path, R.Registry(["b.com", "a.com"]).add("c.com").remove("b.com"))
    assert tables.load_domains(spark, path, ["x.com"]).all() == ["a.com", "c.com"]
    ok, over = tables.bodies(spark.createDataFrame([("x" * 11,), (None,), ("x",)], "body string"), most=10)
    assert (ok.count(), over.count()) == (2, 1)


def test_json_keeps_control_characters(spark):
    rows = [(1, '{"a":"x\\u0001y","b":["\\u0001","bob@x.com\\u0001bob@x.com"]}'), (2, "raw \x01 bob@x.com"), (3, "{}")]
    got = {r.id: r.anonymized for r in anonymize_bodies(spark.createDataFrame(rows, "id long, body string"), "id", "body", ["GLOBAL"]).collect()}
    one = json.loads(got[1])
    assert one["a"] == "x\x01y" and one["b"][0] == "\x01" and one["b"][1].count("[PII_EMAIL_") == 2 and "\x01" in one["b"][1]
    assert got[2].startswith("raw \x01 [PII_EMAIL_") and got[3] == "{}"


def test_many_leaves_stay_in_order(spark):
    """Bodies of more leaves than a batch has rows, several in a partition."""
    rows = [(k, json.dumps({"l": [f"v{k}.{i}" for i in range(9000 * (k % 2))], "n": k})) for k in range(5)]
    got = {r.id: json.loads(r.anonymized) for r in anonymize_bodies(spark.createDataFrame(rows, "id long, body string").coalesce(1), "id", "body", ["GLOBAL"]).collect()}
    assert all(got[k] == json.loads(body) for k, body in rows)


def brute_s3fifo(trace, capacity):
    """The fixed rules with plain lists, scanned for every question: what leaves a queue for good leaves the store too, the main
    queue drops its oldest whatever its uses, and a remembered key stays remembered until it is the oldest of too many."""
    small, main, ghosts, store, seen = [], [], [], {}, []
    few, ghost_most = max(1, capacity // 10), max(4, 2 * max(1, capacity // 10))
    where = lambda k: next((q for q in (small, main) for e in q if e[0] == k), None)

    def drop_main():
        store.pop(main.pop(0)[0], None)

    def evict():
        while len(small) + len(main) > capacity:
            if not small:
                drop_main()
                continue
            e = small.pop(0)
            if e[2] > 0:
                main.append([e[0], e[1], 0])
                if len(main) > capacity - few:
                    drop_main()
            else:
                store.pop(e[0], None)
                if e[0] not in ghosts:
                    ghosts.append(e[0])
                    del ghosts[:-ghost_most]

    def admit(k, v):
        q = where(k)
        if q is not None:
            next(e for e in q if e[0] == k)[1] = v
            return
        (main if k in ghosts else small).append([k, v, 0])
        evict()

    for op, k, v in trace:
        got = None
        if op == "set":
            admit(k, v)
            store[k] = v
        elif op == "delete":
            q = where(k)
            if q is not None:
                q[:] = [e for e in q if e[0] != k]
            store.pop(k, None)
        else:
            q = where(k)
            if q is not None:
                e = next(e for e in q if e[0] == k)
                e[2] = min(3, e[2] + 1)
                got = e[1]
            elif store.get(k):
                got = store[k]
                admit(k, got)
        seen.append((got, next(("small" if q is small else "main" for q in (small, main) for e in q if e[0] == k), "ghost" if k in ghosts else "none")))
    return seen


@pytest.mark.parametrize("capacity", [2, 5, 20, 50])
def test_s3fifo_against_lists(capacity):
    rng = random.Random(capacity)
    trace = [(rng.choices(("get", "set", "delete"), (6, 3, 0.5))[0], f"k{int(rng.paretovariate(0.6)) % 80}", f"v{i}") for i in range(3000)]
    cache, got = S3Fifo(capacity), []
    for op, k, v in trace:
        found = cache.get(k) if op == "get" else cache.set(k, v) if op == "set" else cache.delete(k)
        got.append((found, cache.place(k)))
    assert got == brute_s3fifo(trace, capacity)


def test_errors_sessions_status_and_log(spark):
    rows = spark.createDataFrame([("timeout", None), ("", "bad body"), (None, None), ("reset", "bad body")], "upstream_error string, anonymize_error string")
    assert tuple(M.error_counts(rows).first()) == (2, 2)
    names = [r[0] for r in spark.range(50).select(session_id()).collect()]
    assert len(set(names)) == 50 and all(re.fullmatch("[0-9a-f]{16}", n) for n in names)
    told = json.loads(tables.status(R.Registry(["b.com", "a.com"]), ["US"]))
    assert told == {"status": "ok", "domains": ["a.com", "b.com"], "packs": ["US"]}
    out = io.StringIO()
    log = Log("proxy", "WARN", out)
    assert not log.write("info", "x") and log.write("error", "gone") and not Log("p", "odd", out).write("debug", "x")
    assert re.fullmatch(r"\S{20} ERROR proxy        gone\n", out.getvalue())


def test_tables_under_two_writers(spark, tmp_path):
    store, other = (tables.VerdictTable(spark, f"file://{tmp_path}/v") for _ in range(2))
    assert [store._claim(), other._claim(), store._claim()] == [1, 2, 3]
    frame = lambda *r: spark.createDataFrame(list(r), "original string, token string")
    store.put(frame(("a", "1"), ("b", "2")))
    store.delete(frame(("b", None)))
    names = store._names()
    store.compact()
    other.put(frame(("c", "3")))
    assert sorted(tuple(r) for r in store.read().collect()) == [("a", "1"), ("c", "3")] and not set(names) & set(store._names())
    (tmp_path / "v" / "v00000099").mkdir()  # a write that did not end
    assert store.read().count() == 2
