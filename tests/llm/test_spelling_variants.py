import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from quern.llm.spelling_variants import WaveletTree, near_pairs, near_words, spelling_variants


def edits(a, b):
    """Whether two words differ by exactly one code point inserted, deleted or replaced."""
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute(counts):
    out = {}
    for w, n in counts.items():
        near = sorted((-m, v) for v, m in counts.items() if edits(w, v))
        out[w] = (n, len(near), near[0][1] if near else None, -near[0][0] if near else None)
    return out


def family(seed, size, letters="abé"):
    r = random.Random(seed)
    words = {"".join(r.choice(letters) for _ in range(r.choice((7, 7, 8, 8, 9, 12)))) for _ in range(size)}
    words |= {"aaaaaaa", "aaaaaaaa", "aaaaaaaaa", "aaaabaaaa", "ÿ" * 40, "ÿ" * 41, "ÿ" * 20 + "a" + "ÿ" * 20}
    return {w: r.choice((2, 2, 3, 40, 700)) for w in words}


def test_wavelet_tree():
    r = np.random.default_rng(3)
    values = r.permutation(100)
    tree = WaveletTree(values)
    x0, y0 = r.integers(0, 100, 200), r.integers(0, 100, 200)
    x1, y1 = x0 + r.integers(0, 40, 200).clip(max=100 - x0), y0 + r.integers(0, 40, 200).clip(max=100 - y0)
    got = sorted(zip(*(v.tolist() for v in tree.report(x0, x1, y0, y1)), strict=True))
    assert got == sorted((q, int(v)) for q in range(200) for v in values[x0[q] : x1[q]] if y0[q] <= v < y1[q])


def test_near_pairs_by_segments():
    words = [w for w in family(5, 400) if len(w) in (8, 9)]
    coded = [w.encode("latin-1") for w in words]
    found = Counter()
    for a, b in ((0, 3), (3, 4), (4, 6), (6, 8)):
        one, other, _ = near_pairs(coded, 8, a, b)
        found.update(zip(one.tolist(), other.tolist(), strict=True))
    want = {(i, j) for i, v in enumerate(words) for j, w in enumerate(words) if edits(v, w) and min(len(v), len(w)) == 8}
    assert set(found) == want and max(found.values()) == 1


@pytest.mark.parametrize("group_words", [20_000, 12, 2])
def test_near_words_against_brute_force(spark, group_words):
    counts = family(7, 500)
    got = {r.word: (r.n, r.n_near, r.near, r.near_n) for r in near_words(spark.createDataFrame(list(counts.items()), "word string, n long"), group_words).collect()}
    assert got == brute(counts)


def test_documents_against_brute_force(spark):
    r = random.Random(11)
    vocabulary = ["programme", "programmes", "programm", "Colour-ful", "colourful", "Ünïversité", "straße×x", "x" * 3000, "short", "ABCDEFG1abcdefg"]
    rows = [(r.choice((i, i, None)), " ".join(r.choices(vocabulary, weights=[600, 20, 2, 30, 300, 9, 9, 3, 40, 10], k=120)), i) for i in range(60)]
    rows += [(1, None, 0), (2, "", 0), (3, rows[0][1], 0), (3, rows[0][1], 0)]
    counts = Counter()
    import re

    for id_, text, _ in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if c < "\x7f" else c for c in run)
            h = zlib.crc32(f"{'' if id_ is None else id_}:{run}".encode())
            if h % 31 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] += 1
    counts = {w: n for w, n in counts.items() if n >= 2 and len(w) >= 7}
    want = {}
    forms = {w: near if near and m >= 10 * n else None for w, (n, _, near, m) in brute(counts).items()}
    for w, (n, size, _, m) in brute(counts).items():
        root = w
        while forms[root]:
            root = forms[root]
        want[w] = (forms[w], root, n, size, m if forms[w] else None)
    df = spark.createDataFrame(rows, "doc_id long, text string, word long").withColumns({"n": F.lit(1), "key": F.lit("x")})
    got = {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in spelling_variants(df).collect()}
    assert got == want and any(f for f, *_ in want.values())


def test_chains_lead_to_the_root(spark):
    counts = {"aaaaaaaa": 20_000, "aaaaaaab": 2_000, "aaaaaabb": 200, "aaaaabbb": 20, "aaaabbbb": 2}
    text = " ".join(f"{w} " * n for w, n in counts.items())
    got = {r.word: (r.form, r.root) for r in spelling_variants(spark.createDataFrame([(1, text)], "doc_id long, text string"), typo=2**40).collect()}
    words = list(counts)
    assert got == {w: (words[i - 1] if i else None, words[0]) for i, w in enumerate(words)}


def test_empty(spark):
    assert spelling_variants(spark.createDataFrame([], "doc_id long, text string")).collect() == []
