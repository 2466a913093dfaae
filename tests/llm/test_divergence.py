import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from quern.llm.divergence import Automaton, divergence

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")


def brute(rows, min_docs=3, top=200):
    docs = [((r[1] or ""), (r[2] or ""), TERM.findall("".join(c.lower() if c < "\x7f" else c for c in r[0] or ""))) for r in rows]
    out = set()
    for lang in {d[0] for d in docs}:
        own = [d for d in docs if d[0] == lang]
        df = Counter(t for d in own for t in set(d[2]))
        kept = [t for t, n in df.items() if n >= min_docs]
        counts = {s: Counter(t for d in own if d[1] == s for t in d[2]) for s in {d[1] for d in own}}

        def weights(c, kept=kept):
            of = sum(c[t] for t in kept) + len(kept)
            return {t: 1 + 10**9 * (c[t] + 1) // of for t in kept}

        p, q = {s: weights(c) for s, c in counts.items()}, weights(sum(counts.values(), Counter()))
        f = lambda a, b: (a - b) ** 2 // b
        for s in counts:
            pair = [(-sum(f(p[s][t], p[h][t]) for t in kept), h) for h in counts if h != s]
            term = [(-f(p[s][t], q[t]), t) for t in kept if counts[s][t] and p[s][t] > q[t]]
            for part, found in (("pair", sorted(pair)), ("term", sorted(term)[:top])):
                out |= {(lang, s, part, item, -v, i + 1) for i, (v, item) in enumerate(found)}
    return out


def corpus(seed, size, sources=9):
    r = random.Random(seed)
    words = [f"{a}{b}" for a in "the of a Über naïve x ß colour".split(" ") for b in ("", "s", "LY", "a", " ")] + ["x" * 500, "no1body", "it's"]
    rows = [(r.choice((" ", "\n", "--")).join(r.choices(words, weights=range(len(words), 0, -1), k=r.choice((0, 1, 20, 90)))), r.choice(("en", "de", None, "en")), f"s{int(sources * r.random() ** 2)}") for _ in range(size)]
    return rows + [(None, "en", "s1"), ("", "fr", None), ("alone", "fr", "é"), (rows[0][0], "en", "s0"), ("the", None, None)]


def found(spark, rows, **kw):
    df = spark.createDataFrame(rows, "text string, lang string, source string").withColumns({"term": F.lit(1), "n": F.lit(2), "p0": F.lit("x")})
    got = [tuple(r) for r in divergence(df, **kw).collect()]
    assert len(got) == len(set(got))
    return set(got)


def test_automaton_leaves_the_rest():
    a = Automaton(["a", "bb"])
    met, rest = a.scan(" a c bb a ddd ddd a bb e ")
    assert met.tolist() == [0, 1, 0, 0, 1] and rest == [" c", " ddd ddd", " e"]
    assert a.scan(" c ")[1] == [" c"] and a.scan(" a ")[1] == []


@pytest.mark.parametrize(("head_terms", "shard_chars"), [(150_000, 1_500_000), (12, 1_500_000), (5, 40), (0, 60)])
def test_against_brute_force(spark, head_terms, shard_chars):
    rows = corpus(4, 150)
    assert found(spark, rows, head_terms=head_terms, shard_chars=shard_chars, top=15) == brute(rows, top=15)


def test_more_sources_than_a_block(spark):
    r = random.Random(8)
    rows = [(" ".join(r.choices("abcdefghij", k=r.choice((1, 6)))), "en", f"s{i % 270}") for i in range(400)]
    assert found(spark, rows) == brute(rows)


def test_empty(spark):
    assert found(spark, []) == set()
    assert found(spark, [("one word", "en", "a"), ("two", "en", "b")]) == {("en", "a", "pair", "b", 0, 1), ("en", "b", "pair", "a", 0, 1)}
