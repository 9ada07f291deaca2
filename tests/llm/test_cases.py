"""Clashing names, sizes beyond one block or image, and parts of the models against enumeration."""

import hashlib
import itertools
import random
import zlib

import numpy as np
import pytest


def words(rng, n, alphabet="abcdefghij"):
    return " ".join("".join(rng.choice(alphabet) for _ in range(rng.randint(2, 7))) for _ in range(n))


def test_stages_leave_clashing_columns_alone(spark):
    """Columns that are called like the operators' own."""
    import corpus_pipeline as P

    names = ["lang_pred", "score", "_spans", "_hit", "_blob", "_row", "_print", "fingerprint", "component_id", "spans", "blob", "key"]
    rows = [(i, f"the quick brown fox number {i} and the lazy dog of {(i or 0) * 7} password=abcdefghijkl{i or 0:02d}", "en", *(f"{n}{i}" for n in names)) for i in (1, 2, 2, 3, None)]
    rows.append((4, "12 !", "en", *names))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, " + ", ".join(f"`{n}` string" for n in names))
    for stage in (P.language_id, P.near_duplicates, P.secrets):
        out = stage(spark, docs, "")
        assert out.columns == docs.columns
        got = [tuple(r)[3:] for r in out.collect()]
        assert got and set(got) <= {r[3:] for r in rows}
    from maskwright.llm.simhash import keep_one_per_group

    assert {tuple(r)[3:] for r in keep_one_per_group(docs).collect()} <= {r[3:] for r in rows}


def test_every_language_is_learned(spark):
    """More languages than any cap of old; rows without an id, and rows that repeat, don't unbalance the sample."""
    from maskwright.llm.lang_id import fit, predict

    rng, rows = random.Random(3), []
    for k in range(70):
        letters = "".join(rng.sample("abcdefghijklmnopqrstuvwxyz", 5))
        rows += [(None if j % 3 == 0 else len(rows) + j, words(rng, 40, letters), f"x{k:02d}") for j in range(6)]
    rows += [(7, "aa bb cc dd", "same")] * 300
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = fit(docs, per_lang=5)
    assert len(model.langs) == 71
    right = predict(docs, model).where("lang = lang_pred").count()
    assert right > 0.9 * len(rows)


def test_svm_against_a_grid():
    from maskwright.llm.lang_id import fit_svm

    rng = np.random.default_rng(1)
    x = rng.normal(size=(30, 2)).astype(np.float32)
    y = np.where(x[:, 0] + 0.5 * x[:, 1] + 0.2 * rng.normal(size=30) > 0, 1.0, -1.0)
    loss = lambda w: 0.5 * (w @ w) + (np.maximum(0, 1 - y * (x @ w)) ** 2).sum()
    best = min(loss(np.array(w)) for w in itertools.product(np.linspace(-4, 4, 161), repeat=2))
    assert loss(fit_svm(x, y, rounds=200)) <= best + 1e-2


def test_many_item_blocks(spark):
    """Blocks of items, one after the other, find what one index finds."""
    from maskwright.llm.decontam import contaminated, drop_contaminated

    rng = random.Random(8)
    items = [(i, words(rng, rng.choice((6, 30, 90)))) for i in range(12)]
    texts = [(i, f"{words(rng, 50)} {items[i][1] if i < 12 else ''} {words(rng, 50)}") for i in range(20)]
    docs, bench = spark.createDataFrame(texts, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    one = sorted(tuple(r) for r in contaminated(docs, bench).collect())
    many = sorted(tuple(r) for r in contaminated(docs, bench, block_shingles=60).collect())
    assert one == many and {r[:2] for r in one} >= {(i, i) for i in range(12)}
    assert sorted(r.doc_id for r in drop_contaminated(docs, bench, block_shingles=60).collect()) == list(range(12, 20))


def test_texts_over_one_image(spark, monkeypatch):
    from maskwright.llm import jpeg

    rng = np.random.default_rng(2)
    payloads = [jpeg.padded(x) for x in (b"", b"x", rng.integers(0, 256, 5000, dtype=np.uint8).tobytes(), b"\xff\xd9\xff\xd8" * 700)]
    for most in (64, 256, 4096, 1 << 22):
        stored = jpeg.store(payloads, most)
        got = list(jpeg.retrieve(stored, [len(p) for p in payloads], most))
        assert [g[0] for g in got] == payloads and [len(g[1]) for g in got] == [-(-len(p) // most) for p in payloads]
    text = "".join(rng.choice(list("abc é"), 5_000_000))  # over one image of production size, with characters of two bytes
    row = jpeg.features(jpeg.media(spark.createDataFrame([(1, text), (2, "short")], "doc_id long, text string"))).orderBy("doc_id").first()
    raw = text.encode()
    full = raw + bytes(-len(raw) % 64)
    assert (row.n_bytes, row.payload_bytes, row.payload_sha256, row.tail_crc32) == (len(raw), len(full), hashlib.sha256(full).hexdigest(), zlib.crc32(full[-64:]))
    assert row.feature.count("|") == 1


def test_tiles_are_of_one_size(spark):
    """Many tiles and bands of bit counts, against all pairs."""
    from maskwright.llm.simhash import merge_links, near_duplicate_groups, tile_bands

    rng = np.random.default_rng(4)
    a = rng.integers(0, 1 << 63, 300, dtype=np.int64)
    a[100:200] = a[:100] ^ (1 << rng.integers(0, 60, 100))
    label = merge_links(a, None, 4, block=7, wide=11)
    for i in range(300):
        near = np.bitwise_count((a[i] ^ a).view(np.uint64)) <= 4
        assert (label[near] == label[i]).all()
    assert (label[100:200] == np.arange(100)).all()
    assert sum(k for _, _, k in tile_bands({32: 100_000, 33: 50_000, 1: 3}, 1000)) >= 150
    r = random.Random(4)
    texts = [(i, words(r, 30)) for i in range(200)]
    texts += [(1000 + i, t) for i, t in texts[:50]]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    assert sorted(map(tuple, near_duplicate_groups(docs, tile=5).collect())) == sorted(map(tuple, near_duplicate_groups(docs, tile=10_000).collect()))


def test_viterbi_and_likelihood_against_enumeration():
    from maskwright.llm.html_crf import Crf

    rng = random.Random(9)
    pages = [([[rng.choice("abcd"), rng.choice("xyz")] for _ in range(n)], [rng.randint(0, 1) for _ in range(n)]) for n in (1, 2, 5, 6, 4, 3) * 4]
    model = Crf(pages)

    def total(fs, y):
        e = sum(model.weight[model.place[x], label] for f, label in zip(fs, y) for x in f if x in model.place)
        return e + sum(model.pair[p, q] for p, q in zip(y, y[1:]))

    def mean_loss():
        out = 0.0
        for fs, y in pages:
            z = np.logaddexp.reduce([total(fs, ys) for ys in itertools.product((0, 1), repeat=len(fs))])
            out += z - total(fs, y)
        return out / len(pages) + 0.5 * 0.01 * ((model.weight**2).sum() + (model.pair**2).sum()) / len(model.place)

    for fs, _ in pages + [([["new"], ["a", "x"], ["d"]], [])]:
        best = max(itertools.product((0, 1), repeat=len(fs)), key=lambda y: total(fs, y))
        assert total(fs, model.decode(fs)) == pytest.approx(total(fs, best))
    low = mean_loss()  # the fitted weights are the least point of the enumerated loss
    for _ in range(12):
        at = rng.randrange(len(model.place))
        for step in (0.05, -0.05):
            model.weight[at, 1] += step
            assert mean_loss() >= low - 1e-6
            model.weight[at, 1] -= step
    model.pair[0, 1] += 0.1
    assert mean_loss() >= low - 1e-6


def test_log_count_ratios_by_hand():
    """Two one-word classes: the score's sign follows ratios counted by hand."""
    from maskwright.llm.toxicity import Places, ToxicityModel

    places, texts = Places(), ["bad day", "bad night", "good day", "good night", "fine day"]
    labels = np.array([1, 1, 0, 0, 0])
    found = [places(t) for t in texts]
    model = ToxicityModel(found, labels)
    grams = [set(p.tolist()) for p in found]
    ratio = {}
    for g in set().union(*grams):
        pos, neg = 1 + sum(g in s for s, y in zip(grams, labels) if y), 1 + sum(g in s for s, y in zip(grams, labels) if not y)
        ratio[g] = np.log((pos / (labels.sum() + 1)) / (neg / ((1 - labels).sum() + 1)))
    used = [g for g in ratio if sum(g in s for s in grams) > 1]
    assert [float(model.square[g]) for g in used] == pytest.approx([ratio[g] ** 2 for g in used], rel=1e-5)
    assert all(np.sign(model.weight[g]) in (0, np.sign(ratio[g])) or abs(ratio[g]) < 0.3 for g in used)
    assert model.score(places("bad bad")) > 0.5 > model.score(places("good good"))


def test_thresholds_are_quantiles_of_trusted_texts(spark):
    from maskwright.llm.kneser_ney import classify

    rng = random.Random(2)
    rows = [(i, words(rng, 30, "abcde" if i % 2 else "vwxyz"), ("en", "de", None)[i % 3]) for i in range(90)] + [(500, words(rng, 30, "0123456789"), "fr")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, int(i % 5 > 0)) for i in range(90)], "doc_id long, quality int")
    got = classify(docs, labels, quantile=0.9, slack=1.5).collect()
    trusted = {i for i in range(90) if i % 5}
    for r in got:
        same = sorted(x.perplexity for x in got if x.doc_id in trusted and x.lang == r.lang) or sorted(x.perplexity for x in got if x.doc_id in trusted)
        want = same[int(np.ceil(0.9 * len(same))) - 1] * 1.5
        assert r.threshold == pytest.approx(want) and r.kept == (r.perplexity <= r.threshold)


def test_packing_stage_keeps_every_id(spark):
    """The last stage against the tokenizer: rows without an id, repeated ids, ties in length."""
    tokenizers, public = pytest.importorskip("tokenizers"), pytest.importorskip("public_tokenizers")
    import corpus_pipeline as P

    rng = random.Random(1)
    texts = [(i, words(rng, rng.choice((0, 40, 40, 900, 6000)))) for i in range(60)] + [(3, "again"), (None, "no id"), (None, None), (70, "")]
    whole = tokenizers.Tokenizer.from_file(public.path("word_bpe_49k.json"))
    rows = P.packing(spark, spark.createDataFrame(texts, "doc_id long, text string"), "").collect()
    want = sorted((-1 if i is None else i, len(whole.encode(t or "", add_special_tokens=False).ids) + 1) for i, t in texts)
    by: dict = {}
    for r in rows:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert all(sum(n for _, n in p) <= 4096 and sorted(p) == [(sum(n for _, n in sorted(p)[:k]), sorted(p)[k][1]) for k in range(len(p))] for p in by.values())
    assert sorted((-1 if r.doc_id is None else r.doc_id, r.doc_tokens) for r in rows if r.start == 0) == want
    assert sum(r.length for r in rows) == sum(n for _, n in want)
