"""op9: disk in use, narrowed shards and capped prefixes, against enumeration."""

import os
import random
from collections import Counter

import numpy as np


def words(rng, n):
    return " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randint(3, 7))) for _ in range(n))


def test_steps_leave_no_files_behind(spark):
    """Once the result is planned, only the three frames that it reads are left, and no shuffle files."""
    from maskwright.llm.common import shared_dir
    from maskwright.llm.suffix_dedup import remove_repeats

    def shuffled():
        files = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
        return {f for f in files.mkString("\n").split("\n") if os.path.basename(f).startswith("shuffle_")}

    rng = random.Random(3)
    shared = words(rng, 90)
    docs = spark.createDataFrame([(i, words(rng, 40) + " " + shared[i % 9 :] + " " + words(rng, 40)) for i in range(60)], "doc_id long, text string")
    folder = shared_dir(spark).removeprefix("file://")
    before, files = set(os.listdir(folder)), shuffled()
    out = remove_repeats(docs)
    left = sorted(f.rsplit("-", 1)[0] for f in set(os.listdir(folder)) - before)
    assert left == ["repeat-changed", "repeat-passages", "repeat-rows"] and not shuffled() - files
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled") == "false"
    got = out.collect()
    assert len(got) == 60 and all(r.n_removed >= len(shared) - 9 and r.passage_words >= 80 for r in got)


def repeats(segments, length):
    seen = Counter(s[i : i + length] for s in segments for i in range(len(s) - length + 1))
    return [[i for i in range(len(s) - length + 1) if seen[s[i : i + length]] > 1] for s in segments]


def test_narrowed_shards():
    """Stretches that share less than a window are not sorted; every repeat is found, in one segment too."""
    from maskwright.llm.suffix_dedup import narrowed, sort_shard

    rng = random.Random(4)
    for k in range(40):
        shared = [words(rng, 40)[:n].encode() for n in (30, 55, 60, 61, 75, 130)]
        segments = []
        for _ in range(30):
            at = rng.randint(0, 60)
            segments.append((words(rng, 20)[:at].encode() + rng.choice(shared) + words(rng, 20).encode())[: rng.randint(60, 200)])
        segments += [segments[0], b"ab" * 70, b"\0" * 80 + segments[1], segments[2] + segments[2]]
        segments = [s for s in segments if len(s) >= 60]
        want = repeats(segments, 60)
        assert [x.tolist() for x in sort_shard(segments, 60)] == want
        parts = narrowed(segments, 60)
        assert sum(map(len, want)) <= sum(b - a + 1 for _, a, b in parts) < sum(len(s) - 59 for s in segments)
    assert [x.tolist() for x in sort_shard([words(rng, 30).encode(), words(rng, 30).encode()], 60)] == [[], []]


def test_prefixes_near_the_cap():
    """Prefixes that can't grow to the cap are given as 0; the repeats stay the same, with runs and falls of any length."""
    from maskwright.llm.induced_sort import Inducer, common_prefixes, repeated_starts
    from maskwright.llm.anchors import RangeHasher

    rng = random.Random(6)
    for k in range(60):
        unit = words(rng, 60).encode()
        odd = [b"z" * rng.randint(0, 90), bytes(range(122, 97, -1)) * rng.randint(0, 2), b"", b"\0"]
        t = b"".join(unit[rng.randint(0, 90) : rng.randint(90, 240)] + rng.choice(odd) for _ in range(8))
        length = rng.choice((40, 64, 100))
        seen = Counter(t[i : i + length] for i in range(len(t) - length + 1))
        want = [i + length <= len(t) and seen[t[i : i + length]] > 1 and 0 not in t[i : i + length] for i in range(len(t))]
        assert repeated_starts(np.frombuffer(t, np.uint8), length).tolist() == want
    data = np.frombuffer(b"abcabcabdabcabd", np.uint8)
    pos = np.array([0, 3, 9, 6, 12])
    full = common_prefixes(pos, len(data), RangeHasher().load(data), 9)
    assert full.tolist() == [0, 5, 6, 2, 3] and common_prefixes(pos, len(data), RangeHasher().load(data), 9, 5).tolist() == [0, 5, 6, 0, 0]
    assert Inducer(data, "", 9, 9).common(3, 9) == 6


def test_passages_end_at_words(spark):
    """Equal bytes at the edge of a neighbouring word's code are no words of a passage, whatever their number in a document."""
    from maskwright.llm.anchors import RangeHasher, word_codes
    from maskwright.llm.suffix_dedup import remove_repeats

    def code(word):
        return word_codes(np.frombuffer(word.encode(), np.uint8), np.array([0, len(word)]), RangeHasher())[0]

    rng = random.Random(5)
    ends = {}  # pairs of words whose codes end in the same two bytes and differ before
    pairs = []
    while len(pairs) < 4:
        word = words(rng, 1) + str(rng.randint(0, 999))
        other = ends.setdefault(bytes(code(word)[2:]), word)
        if (code(word)[:2] != code(other)[:2]).all():
            pairs.append((word, other))
    shared = [" ".join(f"s{k}x{rng.randint(0, 10**9)}" for _ in range(60)) for k in range(4)]
    texts = [" ".join(f"{words(rng, 70)} {pair[side]} {passage}" for pair, passage in zip(pairs, shared)) for side in (0, 1)]
    for a, b in pairs:
        assert (code(a)[2:] == code(b)[2:]).all() and a != b
    out = remove_repeats(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert [r.passage_words for r in out] == [240, 240]
