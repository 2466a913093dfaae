import os
import random
import re
from collections import Counter
from urllib.parse import urlparse

import numpy as np
import pyarrow as pa
import pytest

from quern.llm.near_dedup import SHINGLE, SIMILARITY, Tokens, _word_lists, components, drop_near_duplicates, near_duplicate_classes, shingles, similarity
from quern.storage import durable, shared_dir

SCHEMA = "doc_id long, text string, class_id string, n int"
WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def corpus():
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdeü") for _ in range(rng.randint(2, 7)))
    passage = [word() for _ in range(60)]
    rows, n = [], 0
    for base in range(20):
        text = [word() for _ in range(rng.randint(40, 300))] + (passage if base % 2 else [])
        for copy in range(rng.choice([1, 1, 2, 5])):
            w = list(text)
            for _ in range(rng.choice([0, 1, 1, 3])):
                w[rng.randrange(len(w))] = word()
            rows.append((n, " ".join(w), "c", 0))
            n += 1
    hot = [word() for _ in range(150)]
    for i in range(50):
        w = list(hot)
        w[i % 150] = word()
        rows.append((n, " ".join(w), "c", 0))
        n += 1
    extra = [None, "", "!!! ...", "one two", "One, TWO", "one two three", "same " * 400, "same " * 500, "x " * 30_000]
    return rows + [(n + i, t, "c", 0) for i, t in enumerate(extra)]


def brute(rows):
    """Classes over all pairs by the plain longest common subsequence of their words."""
    seqs = [np.array([hash(w) for w in words_of(t)], np.int64) for _, t, *_ in rows]
    bags = [Counter(s.tolist()) for s in seqs]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            n, m = len(seqs[i]), len(seqs[j])
            if n and m and min(n, m) >= SIMILARITY * max(n, m):
                most = sum((bags[i] & bags[j]).values())
                if most >= SIMILARITY * (n + m - most) and aligned(seqs[i], seqs[j]) >= SIMILARITY:
                    a, b = find(i), find(j)
                    root[max(a, b)] = min(a, b)
    return {rows[i][0]: rows[find(i)][0] for i in range(len(rows))}


def words_of(t):
    return WORD.findall("".join(c.lower() if c.isascii() else c for c in t or ""))


def aligned(a, b):
    """Plain longest common subsequence."""
    row = np.zeros(len(b) + 1, int)
    for x in a:
        row[1:] = np.maximum.accumulate(np.maximum(row[1:], row[:-1] + (b == x)))
    n = int(row[-1])
    return n / (len(a) + len(b) - n)


def test_against_brute_force(spark):
    rows = [r for r in corpus() if r[1] is None or len(r[1]) < 20_000]
    found = near_duplicate_classes(spark.createDataFrame(rows, SCHEMA).repartition(5)).collect()
    want = brute(rows)
    assert {r.doc_id: r.class_id for r in found} == want
    assert {r.doc_id for r in found if r.kept} == set(want.values())


def test_drop_keeps_one_of_each_group(spark):
    rows = corpus()
    df = spark.createDataFrame([*rows, rows[0], rows[0]], SCHEMA)
    kept = drop_near_duplicates(df)
    assert kept.columns == df.columns
    classes = {r.doc_id: r.class_id for r in near_duplicate_classes(df).collect()}
    assert sorted(r.doc_id for r in kept.collect()) == sorted(set(classes.values()))


def test_null_ids_and_empty(spark):
    df = spark.createDataFrame([(None, "a b c d e f", "", 0), (4, "a b c d e f", "", 0), (None, "only here it is", "", 0), (None, None, "", 0)], SCHEMA)
    assert sorted(str(r.class_id) for r in near_duplicate_classes(df).collect()) == ["4", "4", "None", "None"]
    assert near_duplicate_classes(spark.createDataFrame([], SCHEMA)).collect() == []


def test_words_are_those_of_the_rule():
    texts = ["Abc def", "ghi", "", None, "é-É x", "9a\n\nB", "..", "end"]
    lists = _word_lists(pa.array(texts), Tokens())
    assert [len(x) for x in lists] == [len(words_of(t)) for t in texts]
    flat = {}
    for t, hashes in zip(texts, lists, strict=True):
        for w, h in zip(words_of(t), hashes, strict=True):
            assert flat.setdefault(w, h) == h
    assert len(set(flat.values())) == len(flat)


@pytest.mark.parametrize("seed", range(6))
def test_alignment_is_that_of_the_words(seed):
    rng = np.random.default_rng(seed)
    for _ in range(40):
        a = rng.integers(0, 600 if seed % 2 else 30, rng.integers(5, 120)).astype(np.uint64)
        b = np.array([x for x in a if rng.random() > 0.06] + [1], np.uint64)
        b[rng.random(len(b)) < 0.04] = 7
        exact, got = aligned(a, b), similarity(a, b)
        if got >= SIMILARITY:  # fixed points may cost a match or two of the best alignment
            assert exact - 2 / len(a) <= got <= exact + 1e-9
        else:
            assert exact < SIMILARITY + 2 / len(a)
    assert len(shingles(np.arange(3, dtype=np.uint64))) == 1 and len(shingles(np.arange(9, dtype=np.uint64))) == 5


def test_alignment_of_moved_and_very_long_texts():
    a = np.arange(60_000, dtype=np.uint64)
    assert similarity(a, np.concatenate([a[30_000:], a[:30_000]])) < SIMILARITY
    same = np.zeros(40_000, np.uint64)
    assert similarity(same, same[:36_000]) == 0.9
    b = np.delete(a, np.arange(0, 60_000, 20))
    assert similarity(a, b) == 0.95


def test_components_of_a_long_chain(spark):
    edges = [(i, i + 1) for i in range(12)] + [(100, 101), (102, 101)]
    roots = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert roots == {**{i: 0 for i in range(1, 13)}, 101: 100, 102: 100}


def test_pairs_in_a_family_of_unrelated_texts_with_a_shared_part(spark):
    rng = random.Random(9)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(6))
    shared = [word() for _ in range(300)]
    texts = [" ".join(shared + [word() for _ in range(rng.randint(42, 50))]) for _ in range(150)]
    for i in range(0, 100, 2):  # the second of a pair keeps most of the first one's own part
        w = texts[i].split()
        own = w[300:]
        n = rng.randint(24, 34)
        texts[i + 1] = " ".join(w[:300] + own[:-n] + [word() for _ in range(n)])
    order = list(range(150))
    rng.shuffle(order)
    rows = [(i, texts[k], "c", 0) for i, k in enumerate(order)]
    want = brute(rows)
    assert sum(want[i] != i for i in range(150)) == 50
    found = near_duplicate_classes(spark.createDataFrame(rows, SCHEMA).repartition(3)).collect()
    assert {r.doc_id: r.class_id for r in found} == want


@pytest.mark.parametrize("share", [0.6, 0.85])
def test_scattered_edits_in_a_family(spark, share):
    """Pairs of 240 words, one of twelve exchanged all over, in a family with a shared part: five-word shingles keep less than half."""
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(6))
    shared = [word() for _ in range(int(240 * share))]
    texts = []
    for _ in range(100):
        a = shared + [word() for _ in range(240 - len(shared))]
        b = list(a)
        for at in range(0, 240, 12):
            b[at + rng.randrange(12)] = word()
        texts += [" ".join(a), " ".join(b)]
    rows = [(i, t, "c", 0) for i, t in enumerate(texts)]
    found = {r.doc_id: r.class_id for r in near_duplicate_classes(spark.createDataFrame(rows, SCHEMA).repartition(3)).collect()}
    assert sum(found[i] == found[i + 1] for i in range(0, 200, 2)) >= 97
    assert all(found[i] // 2 == i // 2 for i in found)


@pytest.mark.parametrize("edits", [3, 5])
def test_a_star_is_one_class(spark, edits):
    """Copies that each exchange other words of one text: only the centre links them surely."""
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(6))
    centre = [word() for _ in range(70)]
    texts = []
    for _ in range(59):
        w = list(centre)
        for at in rng.sample(range(70), edits):
            w[at] = word()
        texts.append(" ".join(w))
    texts.insert(30, " ".join(centre))
    found = near_duplicate_classes(spark.createDataFrame([(i, t, "c", 0) for i, t in enumerate(texts)], SCHEMA)).collect()
    assert {r.class_id for r in found} == {0}


def test_recall_on_a_whole_table(spark):
    """All pairs of sf0.01 by brute force: of those that it links at least nine tenths share a class, and nothing else does."""
    df = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    rows = [(r.doc_id, r.text) for r in df.orderBy("doc_id").collect()]
    want = brute(rows)
    found = {r.doc_id: r.class_id for r in near_duplicate_classes(df).collect()}
    linked = [i for i in want if want[i] != i]
    assert sum(found[i] == found[want[i]] for i in linked) >= 0.9 * len(linked)
    assert all(want[i] == want[found[i]] for i in found)


def test_what_is_kept_between_the_steps_is_few_files_and_goes_with_the_result(spark):
    texts = [" ".join(f"w{j}x{i // 3 if j != i % 40 else 100 + i}" for j in range(60)) for i in range(30)]
    df = spark.createDataFrame([(i, t, "c", 0) for i, t in enumerate(texts)], SCHEMA)
    durable(spark.range(1))  # names the folder where a session has none
    folders = {urlparse(x).path for x in (shared_dir(spark), spark.sparkContext._jsc.sc().getCheckpointDir().get())}
    files = lambda: sum(len(names) for folder in folders for _, _, names in os.walk(folder))
    held = {"spark.sql.shuffle.partitions": "32", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in held}
    try:
        for k, v in held.items():
            spark.conf.set(k, v)
        at = files()
        found = near_duplicate_classes(df)
        assert files() - at < 4 * 32  # the result alone; all steps' checkpoints would be over 1,000
        assert found.count() == 30 and len({r.class_id for r in found.collect()}) == len({i // 3 for i in range(30)})
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert not [name for folder in folders for name in os.listdir(folder) if "scratch" in name]
