import random

import numpy as np
import pytest

from quern.llm.toxicity import Model, evidence, learn, scan, score, segments

DOCS, LABELS = "doc_id long, text string, toxic string", "doc_id long, toxic int"
BAD = ["scumbag", "vilehead", "nastyface"]


def corpus(n=400):
    rng = random.Random(9)
    words = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 6))) for _ in range(200)]
    rows = []
    for i in range(n):
        w = [rng.choice(words) for _ in range(rng.randint(20, 120))]
        toxic = i % 4 == 0
        for _ in range(rng.randint(2, 5) if toxic else 0):
            w.insert(rng.randrange(len(w)), rng.choice(BAD))
        rows.append((i, " ".join(w), toxic))
    return rows


def test_held_out(spark):
    rows = corpus()
    docs = spark.createDataFrame([(i, t, "x") for i, t, _ in rows], DOCS)
    labels = spark.createDataFrame([(i, int(y)) for i, _, y in rows if i % 3], LABELS)
    model = learn(docs, labels)
    assert set(BAD) <= set(model.scores)
    found = {r.id: r.score for r in scan(docs, model).collect()}
    held = [(found[i], y) for i, _, y in rows if i % 3 == 0]
    assert np.mean([(s >= 0.7) == y for s, y in held]) > 0.95


def test_defined_cases(spark):
    model = Model({"bad": 5.0}, -0.1, 0.01, 0.1)
    df = spark.createDataFrame([(1, None, "x"), (2, "", "x"), (3, "bad " * 50_000, "x"), (None, "fine", "x"), (3, "bad", "x")], DOCS)
    found = scan(df, model).collect()
    assert len(found) == 5 and all(0 <= r.score <= 1 for r in found)
    assert {r.id: r.n_tokens for r in found if r.id in (1, 2)} == {1: 0, 2: 0}
    assert [r.score > 0.7 for r in found if r.n_tokens == 50_000] == [True]
    one_kind = learn(df, spark.createDataFrame([(3, 1), (3, 1), (9, 1)], LABELS))
    assert one_kind.scores == {}
    assert scan(spark.createDataFrame([], DOCS), model).collect() == []


def brute(values):
    """All maximal segments by their definition: the best one, then those left and right of it."""
    best = None
    for i in range(len(values)):
        for j in range(i, len(values)):
            s = sum(values[i : j + 1])
            if s > 1e-9 and (best is None or s > best[2] + 1e-9):
                best = (i, j, s)
    if not best:
        return []
    i, j, s = best
    return brute(values[:i]) + [best] + [(a + j + 1, b + j + 1, x) for a, b, x in brute(values[j + 1 :])]


def test_segments_are_all_maximal_ones():
    rng = random.Random(4)
    for _ in range(150):
        gains = [rng.choice([0, 0, 0, rng.uniform(0.2, 4)]) for _ in range(rng.randint(0, 22))]
        background = -rng.uniform(0.1, 1.5)
        at = [i for i, g in enumerate(gains) if g]
        got = segments(np.array(at, int), [gains[i] for i in at], background, len(gains))
        want = brute([g or background for g in gains])
        assert [(a, b) for a, b, _ in got] == [(a, b) for a, b, _ in want]
        assert np.allclose([x[2] for x in got], [x[2] for x in want])


def test_more_evidence_scores_higher():
    model = Model({}, -0.1, 0.01, 0.1)
    assert evidence(100, [(0, 0, 1.0)], 0.01) == 0
    values = [score(100, f, model) for f in ([], [(0, 0, 1.0)], [(0, 0, 5.0)], [(0, 0, 9.0)], [(0, 0, 9.0), (50, 51, 6.0)])]
    assert values == sorted(values) and values[0] < 0.1 < 0.9 < values[-1]


def test_segments_of_many_sparse_hits_are_found_in_linear_time():
    import time

    at = np.arange(200_000) * 60
    began = time.perf_counter()
    got = segments(at, [2.0] * len(at), -0.05, int(at[-1]) + 1)
    spent = time.perf_counter() - began
    assert [x[:2] for x in got] == [(i, i) for i in at.tolist()] and max(abs(x[2] - 2) for x in got) < 1e-6 and spent < 5
    rising = segments(np.arange(100_000), [1.0] * 100_000, -0.05, 100_000)
    assert len(rising) == 1 and rising[0][:2] == (0, 99_999)
