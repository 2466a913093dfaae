import math
import random

import numpy as np
import pytest

from quern.operators import retrieval
from quern.operators.embedding import HashEmbedder, ModelEmbedder
from quern.operators.memory import Memory
from quern.operators.near_duplicates import deduplicate_table, similar_pairs
from quern.operators.retrieval import best_texts, deduplicate, explain_retrieval, merge_queries, raw_against_threshold, retrieve, search, search_one

VEC = "idx long, embedding array<float>, text string"


def vectors(n=60, dim=16, seed=42):
    return np.random.default_rng(seed).normal(size=(n, dim)).astype(np.float32)


def table(spark, m):
    return spark.createDataFrame([(i, [float(x) for x in v], f"chunk_{i}") for i, v in enumerate(m)], VEC).repartition(3)


def model(m, q, k, metric):
    m, q = m.astype(float), q.astype(float)
    if metric == "cosine":
        unit = lambda x: x / np.where(np.linalg.norm(x, axis=-1, keepdims=True) == 0, 1, np.linalg.norm(x, axis=-1, keepdims=True))
        s = unit(m) @ unit(q)
        return [(i, s[i]) for i in sorted(range(len(m)), key=lambda i: (-round(s[i], 12), i))[:k]]
    s = ((m - q) ** 2).sum(1)
    return [(i, s[i]) for i in sorted(range(len(m)), key=lambda i: (round(s[i], 12), i))[:k]]


@pytest.mark.parametrize("metric", ["L2", "cosine"])
@pytest.mark.parametrize("k", [1, 5, 1_000])
def test_search(spark, metric, k):
    m = np.concatenate([vectors(), vectors()[:5], np.zeros((1, 16), np.float32)])
    queries = spark.createDataFrame([(q, [float(x) for x in m[q]]) for q in (0, 7, 65)], "query_id long, qvec array<float>")
    found = search(table(spark, m), queries, k, metric).collect()
    for q in (0, 7, 65):
        got = sorted((r["rank"], r.idx, r.score) for r in found if r.query_id == q)
        want = model(m, m[q], k, metric)
        assert [x[1] for x in got] == [x[0] for x in want]
        assert np.allclose([x[2] for x in got], [x[1] for x in want], atol=1e-6)
        one = search_one(table(spark, m), [float(x) for x in m[q]], k, metric).collect()
        assert sorted(r.idx for r in one) == sorted(x[0] for x in want)


def test_nearest_is_itself_and_plans(spark):
    t = table(spark, vectors(10, 384))
    q = spark.createDataFrame([(0, [float(x) for x in vectors(10, 384)[0]])], "query_id long, qvec array<float>")
    found = search(t, q, 3, "L2").orderBy("rank").collect()
    assert len(found) == 3 and found[0].idx == 0 and found[0].score < 1e-5
    assert search(t, q.limit(0), 3).collect() == [] and search(t.limit(0), q, 3).collect() == []
    plan = search(t, q, 3)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan and "CartesianProduct" not in plan
    plan = search_one(t, [0.0] * 384, 3)._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in plan and "InArrow" not in plan


def test_threshold_only_for_cosine(spark):
    m = vectors()
    q = spark.createDataFrame([(0, [float(x) for x in m[0]])], "query_id long, qvec array<float>")
    found = retrieve(table(spark, m), q, 10, 0.3, payload=["text"]).collect()
    assert all(r.score >= 0.3 and r.text == f"chunk_{r.idx}" for r in found) and 0 < len(found) < 10
    assert {r["rank"] for r in found} == set(range(len(found)))
    assert len(retrieve(table(spark, m), q, 10, 0.3, "L2").collect()) == 10
    counts = raw_against_threshold(table(spark, m), q, 10, 0.3).first()
    assert (counts.raw_count, counts.kept_count) == (10, len(found))
    told = explain_retrieval(table(spark, m), q, 10, 0.3).first()
    assert abs(told.embedding_norm - np.linalg.norm(m[0])) < 1e-5 and [x.idx for x in told.retrieved] == [r.idx for r in sorted(found, key=lambda r: r["rank"])]


def test_merge_is_the_stable_loop(spark):
    rng = random.Random(1)
    rows = [(g, q, r, rng.choice([0.5, 0.7, 0.9]), rng.choice("abcdef")) for g in range(20) for q in range(3) for r in range(4)]
    found = merge_queries(spark.createDataFrame(rows, "group_id long, qpos int, rank int, score double, text string"), 4).collect()
    for g in range(20):
        want, seen = [], set()
        for x in sorted([x for x in rows if x[0] == g], key=lambda x: -x[3]):
            if x[4] not in seen and len(want) < 4:
                seen.add(x[4])
                want.append(x)
        got = sorted((r for r in found if r.group_id == g), key=lambda r: r.merged_rank)
        assert [(r.group_id, r.qpos, r["rank"], r.score, r.text) for r in got] == want


def loop(texts, t=0.8):
    import re

    kept = []
    for i, text in enumerate(texts):
        w = set(re.sub(r"[^\w\s]", "", text.lower()).split())
        if not any(len(w | x) and len(w & x) / len(w | x) > t for _, x in kept):
            kept.append((i, w))
    return [i for i, _ in kept]


def some_texts(seed, n=60):
    rng = random.Random(seed)
    base = [[rng.choice("abcdefghijklmnop") + rng.choice("xyz") for _ in range(rng.randint(3, 14))] for _ in range(8)]
    out = []
    for _ in range(n):
        w = list(rng.choice(base))
        for _ in range(rng.randint(0, 2)):
            w[rng.randrange(len(w))] = rng.choice("qrst")
        out.append(" ".join(w) + rng.choice([".", "!", ""]))
    return [*out, "", "!!", "..."]


@pytest.mark.parametrize("seed", [1, 2])
def test_greedy_duplicates_of_lists_and_tables(spark, seed):
    texts = some_texts(seed)
    df = spark.createDataFrame([(0, i, t) for i, t in enumerate(texts)], "query_id int, rank int, text string")
    assert sorted(r["rank"] for r in deduplicate(df).collect()) == loop(texts)
    assert sorted(r.pos for r in deduplicate_table(df, pos="rank").where("kept").collect()) == loop(texts)


def test_order_decides(spark):
    a, b, c = "a b c d e f g h i j", "a b c d e f g h i k", "a b c d e f g h l k"
    df = spark.createDataFrame([(0, 0, a), (0, 1, b), (0, 2, c)], "query_id int, rank int, text string")
    assert sorted(r["rank"] for r in deduplicate(df).collect()) == loop([a, b, c]) == [0, 2]
    assert {(r.a, r.b) for r in similar_pairs(df, 0.8, "rank").collect()} == {(0, 1), (1, 2)}


def test_memory_round_trip(spark, tmp_path):
    chunks = spark.createDataFrame([(i, 0, f"c{i}", [float(x) for x in v]) for i, v in enumerate(vectors(5))], "doc_id long, position int, text string, embedding array<float>")
    memory = Memory(spark, 16, "cosine").add(chunks)
    path = f"file://{tmp_path}/m"
    memory.save(path)
    loaded = Memory.load(spark, path)
    assert [r.text for r in loaded.indexed.orderBy("idx").collect()] == [f"c{i}" for i in range(5)]
    assert loaded.append(path, chunks).statistics().first().total_chunks == 10
    assert loaded.clear().statistics().first().asDict() == {"total_chunks": 0, "dimension": 16, "index_type": "cosine"}
    assert abs(np.linalg.norm(loaded.table.first().embedding) - 1) < 1e-6
    with pytest.raises(ValueError):
        Memory(spark, 16, "dot")
    with pytest.raises(Exception, match="vectors need"):
        Memory(spark, 3).add(chunks).table.collect()


def test_embedders(spark):
    df = spark.createDataFrame([(1, "hello world"), (2, ""), (3, " \n"), (4, "hello world"), (5, "other")], "i int, text string")
    rows = {r.i: np.array(r.embedding) for r in HashEmbedder(384).embed(df).collect()}
    assert all(len(v) == 384 for v in rows.values()) and not rows[2].any() and not rows[3].any()
    assert abs(np.linalg.norm(rows[1]) - 1) < 1e-6 and (rows[1] == rows[4]).all() and (rows[1] != rows[5]).any()
    own = ModelEmbedder("length", 2, lambda: lambda texts: [[len(t), 1] for t in texts], batch_size=1)
    assert {r.i: list(r.embedding) for r in own.embed(df).collect()} == {1: [11, 1], 2: [0, 0], 3: [0, 0], 4: [11, 1], 5: [5, 1]}


@pytest.mark.parametrize("metric,held", [("cosine", 100_000), ("L2", 1_000), ("cosine", 7)])
def test_groups_of_many_queries_are_merged_in_the_tasks(spark, monkeypatch, metric, held):
    """Two groups, one of 10,000 queries, texts in many results, ties and unknown scores: equal to sorting all, and few rows leave a task."""
    monkeypatch.setattr(retrieval, "MERGE_ROWS", held)
    rng = random.Random(6)
    rows = [(g, q, r, rng.choice([None, float("nan")]) if rng.random() < 0.001 else rng.randint(0, 400) / 400, rng.choice([None, *(f"t{i}" for i in range(300))])) for g, n in ((1, 10_000), (None, 50)) for q in range(n) for r in range(3)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "group_id int, qpos int, rank int, score double, text string").repartition(4)
    sign = -1 if metric == "cosine" else 1
    nan = lambda s: (1, sign) if math.isnan(s) else (0, 0)
    # as Spark orders: null is the smallest, NaN the largest
    key = lambda x: ((sign * -1, 0, 0) if x[3] is None else (0, sign * nan(x[3])[0], 0 if math.isnan(x[3]) else sign * x[3]), x[1], x[2])
    want = set()
    for g in (1, None):
        seen = {}
        for x in sorted((x for x in rows if x[0] == g), key=key):
            seen.setdefault(x[4], x)
        want |= {(g, i, x[1], x[2], x[4]) for i, x in enumerate(list(seen.values())[:20])}
    found = merge_queries(df, 20, metric)
    assert found._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1
    assert {(r.group_id, r.merged_rank, r.qpos, r.rank, r.text) for r in found.collect()} == want
    if held == 100_000:
        odd = sum(x[3] is None or math.isnan(x[3]) for x in rows)
        assert best_texts(df, 20, metric).count() <= 4 * 2 * 20 + odd
