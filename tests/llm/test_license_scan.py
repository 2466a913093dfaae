import random
import re

from pyspark.sql import functions as F

from quern.llm.license_scan import NOTICES, PHRASES, license_scan

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def split(text):
    return WORD.findall("".join(c.lower() if c < "\x7f" else c for c in text or ""))


def brute_base(text, phrases=PHRASES):
    w = split(text)
    places = sorted((i, label) for label, phrase in phrases for p in [split(phrase)] for i in range(len(w) - len(p) + 1) if w[i : i + len(p)] == p)
    return len(w), len(places), places[0][0] if places else None, places[-1][0] if places else None, ",".join(sorted({label for _, label in places}))


def brute_share(text, phrases, notices, k=4, shift=8):
    """The largest share of each template that the grams on a diagonal and those beside it cover."""
    w, out = split(text), {}
    for number, (_, template) in enumerate([*phrases, *notices]):
        t = split(template)
        n = min(k, len(t))
        votes = [(i - j, j) for j in range(len(t) - n + 1) for i in range(len(w) - n + 1) if w[i : i + n] == t[j : j + n]]
        out[number] = max((len({x for e, j in votes if abs(d - e) <= shift for x in range(j, j + n)}) / len(t) for d, _ in votes), default=0.0)
    return out


def scan(spark, rows, **kw):
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"id": F.lit("x"), "words": F.lit(0), "template": F.lit(1)})
    return license_scan(df, **kw).collect()


def test_places_of_phrases(spark):
    r = random.Random(2)
    bits = "MIT License|the|Apache-License|cc  BY|GNU general\npublic license|license|public|gnu|mit|mit mit license license|é|CC by cc BY".split("|")
    rows = [(i, " ".join(r.choices(bits, k=r.choice((0, 3, 40, 600))))) for i in range(80)] + [(1, None), (2, ""), (3, "MIT License"), (3, "MIT License"), (None, "cc by")]
    rows.append((9, "word " * 30_000 + "mit license " * 2_000))
    got = [(x.doc_id, x.n_words, x.n_base, x.first_word, x.last_word, x.base_labels) for x in scan(spark, rows)]
    key = lambda x: tuple(str(v) for v in x)
    assert sorted(got, key=key) == sorted(((i, *brute_base(t)) for i, t in rows), key=key)


def test_labels_and_scores_against_brute_force(spark):
    r = random.Random(5)
    rows = []
    for i in range(60):
        w = split(r.choice(NOTICES)[1])
        for _ in range(r.choice((0, 1, 2, 6))):  # words go, come and change
            at = r.randrange(len(w))
            w[at : at + r.choice((0, 1))] = r.choice(([], ["new"], ["some", "more"]))
        rows.append((i, " ".join([*["plain"] * r.choice((0, 5)), *w, "plain", "text"])))
    got = {x.doc_id: x for x in scan(spark, rows)}
    for i, text in rows:
        shares = brute_share(text, PHRASES, NOTICES)
        labels = set(filter(None, brute_base(text)[4].split(","))) | {label for n, (label, _) in enumerate(NOTICES, len(PHRASES)) if shares[n] >= 0.75}
        assert got[i].labels == ",".join(sorted(labels)) and got[i].score == max(shares.values())


def test_a_changed_notice_is_found_and_its_pieces_far_apart_are_not(spark):
    mit = split(NOTICES[-4][1])
    changed = [*mit[:9], "and", "sundry", *mit[9:20], *mit[21:]]
    apart = [*mit[:14], *["gap"] * 40, *mit[14:]]
    got = {x.doc_id: (x.labels, round(x.score, 2)) for x in scan(spark, [(1, " ".join(changed)), (2, " ".join(apart)), (3, "nothing at all")])}
    assert got[1][0] == "mit" and got[1][1] > 0.9 and got[2][0] == "" and got[2][1] < 0.75 and got[3] == ("", 0.0)


def test_own_templates(spark):
    own = [("a", "one two three four five six"), ("b", "solo"), ("none", "...")]
    rows = [(1, "one two three four five six solo"), (2, "one two three four x five six"), (3, "")]
    got = {x.doc_id: (x.n_base, x.first_word, x.last_word, x.labels) for x in scan(spark, rows, phrases=own, notices=[])}
    assert got == {1: (2, 0, 6, "a,b"), 2: (0, None, None, ""), 3: (0, None, None, "")}


def test_empty(spark):
    assert scan(spark, []) == []
    assert [(x.n_words, x.labels, x.score) for x in scan(spark, [(1, "mit license")], phrases=[], notices=[])] == [(2, "", 0.0)]
