"""Cases in which the corpus operators did less than the whole job."""

import random


def words(rng, n):
    return " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randint(3, 7))) for _ in range(n))


def test_short_items_in_long_documents():
    from maskwright.llm.decontam import ItemIndex, ShingleHasher, shingles_of

    rng = random.Random(5)
    items = [(i, words(rng, 5 + i % 4)) for i in range(800)] + [(800, "one two"), (801, words(rng, 12)), (802, words(rng, 300))]
    texts = [f"{words(rng, rng.randint(0, 150))} {t} {words(rng, rng.randint(0, 150))}" for _, t in items[:800]] + [items[0][1], "One, two!", "one two three", None, items[801][1], f"x {items[802][1]} y"]
    exact = [(i, shingles_of(t)) for i, t in items]
    want = {(d, i, len(s & own), len(s)) for d, t in enumerate(texts) for own in [shingles_of(t)] for i, s in exact if len(s & own) >= 0.8 * len(s) - 1e-9}
    assert len(want) >= 803 and set(ItemIndex(items).search(ShingleHasher(), texts, 0.8)) == want


def test_stage_drops_near_copies(spark):
    import corpus_pipeline
    from maskwright.llm.decontam import shingles_of

    rng = random.Random(6)
    texts = []
    for _ in range(12):
        base = words(rng, 200).split()
        texts.append(base)
        for edits in (1, 2, 3, 4, 5, 6, 9, 30):
            copy = list(base)
            for at in rng.sample(range(200), edits):
                copy[at] = "edited"
            texts.append(copy)
    chain = words(rng, 200).split()
    for k in range(40):  # each links to the next ones only
        texts.append(chain)
        chain = chain[5:] + words(rng, 5).split()
    rows = [(i, " ".join(t)) for i, t in enumerate(texts)] + [(990, None), (991, ""), (992, "same few"), (993, "Same few."), (None, "same few"), (None, "alone here"), (None, "alone here"), (994, texts[0][0]), (994, "one id again")]
    sets = [(i, shingles_of(t)) for i, t in rows if i is not None]
    group = {i: i for i, _ in sets}
    for _ in range(60):
        for i, a in sets:
            for j, b in sets:
                if len(a & b) >= 0.8 * len(a | b) - 1e-9 and group[i] != group[j]:
                    group[i] = group[j] = min(group[i], group[j])
    want = sorted(i for i in group if group[i] == i)
    docs = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, extra string")
    got = corpus_pipeline.near_duplicates(spark, docs, "")
    assert got.columns == docs.columns
    kept = [(r.doc_id, r.text) for r in got.collect()]
    assert sorted(i for i, _ in kept if i is not None) == want and [t for i, t in kept if i is None] == ["alone here"]


def test_unclosed_elements_keep_the_rest():
    from maskwright.llm.html_blocks import leaf_blocks

    def shown(page):
        return [b.text for b in leaf_blocks(page)]

    for tag in ("svg", "object", "audio", "video", "canvas", "noscript", "template"):
        assert shown(f"<div><{tag} id=x>fallback</div><article><p>one</p><p>two</article>") == ["one", "two"]
        assert shown(f"<p>one <{tag}>left <p>out</p></{tag}> two</p><p>three</p>")[-1] == "three"
        assert shown(f"<article><p>a</p><div>b <{tag}>c</div><p>d</p></article>") == ["a", "b", "d"]
    assert shown("<p>one <svg><text>x</text></svg> two</p>") == ["one two"]
    assert shown("<p>when <math><mi>x</mi><mo>=</mo><mn>2</mn></math> holds</p><p>end") == ["when x=2 holds", "end"]
    assert shown("<p>a<script>x <p>b") == ["a"]


def test_stems_within_words_are_seen():
    """Toxic stems after a prefix or in a compound, also if learned only there; every position of a word counts."""
    import numpy as np
    from maskwright.llm.toxicity import BITS, Places, ToxicityModel

    rng, places = random.Random(9), Places()
    plain = [words(rng, 20).split() for _ in range(200)]
    texts = [" ".join([*w[:9], f"{rng.choice(('un', 'over', 'mis'))}vexbad{rng.choice(('', 'ness', 'ly'))}", *w[9:]]) if k % 4 == 0 else " ".join(w) for k, w in enumerate(plain)]
    model = ToxicityModel([places(t) for t in texts], np.array([int(k % 4 == 0) for k in range(200)]))
    for _ in range(20):
        some = words(rng, 20)
        assert all(model.score(places(f"{some} {w} {some}")) >= 0.5 for w in ("quvexbad", "zzvexbadzz", "VEXBAD")) and model.score(places(some)) < 0.5
    inner = places("x abcdefg")[places("x abcdefg") >= 1 << BITS]
    grams = {w[i : i + n] for w in ("x ", "abcdefg ") for i in range(len(w)) for n in range(3, 7) if i + n <= len(w)}
    assert len(inner) == len(grams) and len(places("")) == 0


def test_stage_joins_simhash_groups(spark):
    """The second stage keeps op7's groups whole, also where texts have no shared band: SimHash links under a Jaccard of 0.8."""
    import corpus_pipeline
    from maskwright.llm.near_copies import near_copy_groups
    from maskwright.llm.simhash import fingerprint, near_duplicate_groups

    rng = random.Random(4)
    base = words(rng, 7)
    loud = [(k, f"{(base + ' ') * 40}{words(rng, 14)}".strip()) for k in range(3)]  # one passage over and over: few bits differ, few shingles are shared
    rows = [*loud, *((k, words(rng, 50)) for k in range(10, 14)), (20, loud[2][1]), (None, loud[0][1])]
    assert all((fingerprint(a) ^ fingerprint(b)).bit_count() <= 4 for _, a in loud for _, b in loud)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    alone = {r.doc_id: r.component_id for r in near_copy_groups(docs).collect() if r.doc_id is not None}
    assert alone[1] == 1 and alone[20] == 2
    op7 = {r.doc_id: r.component_id for r in near_duplicate_groups(docs).collect()}
    assert op7[1] == op7[2] == op7[20] == 0
    assert sorted(r.doc_id for r in corpus_pipeline.near_duplicates(spark, docs, "").collect()) == [0, 10, 11, 12, 13]
