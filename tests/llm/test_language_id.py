import pytest

from quern.llm import language_id
from quern.llm.language_id import PIECES, Coders, clean, identify, keep_identified, learn, pieces, scores

WORDS = {"xx": "the and reading river stone window between nothing brother under light", "yy": "der und nicht schlange zwischen bruder fenster licht unter stein wasser", "zz": "que para mente corazon ventana hermano entre nada piedra abajo luz"}
SCHEMA = "doc_id long, text string, lang string, score string"


def text(lang, seed, n=60):
    w = WORDS[lang].split()
    return " ".join(w[(seed * 7 + i * i * 3 + i) % len(w)] for i in range(n))


def rows():
    return [(i, text(lang, i), lang, "s") for i, lang in enumerate(list(WORDS) * 40)]


def test_held_out_accuracy_and_defined_cases(spark):
    known = learn(spark.createDataFrame(rows(), SCHEMA))
    assert sorted(known) == sorted(WORDS)
    held = [(1_000 + i, text(lang, 500 + i, n), lang, "s") for i, (lang, n) in enumerate([(x, n) for x in WORDS for n in (4, 8, 30, 3_000)])]
    odd = [(1, None, "xx", "s"), (2, "", "xx", "s"), (3, "12 34 !!", "xx", "s"), (4, "²", None, "s")]
    df = spark.createDataFrame(held + odd, SCHEMA).repartition(3)
    found = {r.row.doc_id: r for r in identify(df, known).collect()}
    assert all(found[i].lang_pred == lang for i, _, lang, _ in held)
    assert all(0 < r.score <= 1 and not r.rejected for i, r in found.items() if i >= 1_000)
    assert all((found[i].lang_pred, found[i].score, found[i].rejected) == ("und", 0.0, True) for i in (1, 2, 3, 4))
    kept = keep_identified(df, known)
    assert kept.columns == df.columns and {r.doc_id for r in kept.collect()} == {i for i, *_ in held}


def test_learning_is_bounded_and_without_labels_all_is_undetermined(spark):
    none = spark.createDataFrame([(1, "a b", None, "s"), (2, None, "xx", "s")], SCHEMA)
    assert learn(none) == {}
    assert [r.lang_pred for r in identify(none, {}).collect()] == ["und", "und"]
    assert identify(spark.createDataFrame([], SCHEMA), {"xx": b"abc"}).collect() == []


def test_narrow_margins():
    assert scores({"b": 10, "a": 10, "c": 12}, 20)[::2] == ("a", 0.0)
    best, score, margin = scores({"a": 10, "b": 20}, 40)
    assert best == "a" and margin == 0.5 and score > 0.99
    assert clean("Ab-1 _É\n") == "ab é"


@pytest.mark.parametrize("n", [1, 5, 40, 5_000])
def test_sizes_of_whole_texts(n):
    coders = Coders({k: v.encode() * 20 for k, v in WORDS.items()})
    sizes = dict(zip(WORDS, coders.sizes((WORDS["yy"] + " ").encode() * n), strict=True))
    assert min(sizes, key=sizes.get) == "yy"


def test_accuracy_grows_with_the_length_of_a_text(spark):
    """Beginnings of held-out documents: no length at which the encoding tells languages worse than a shorter one."""
    from zlib import crc32

    from quern.llm.language_id import training_rows

    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").select("doc_id", "text", "lang")
    known = learn(training_rows(docs))
    coders, names = Coders(known), list(known)
    held = [r for r in docs.collect() if crc32(str(r.doc_id).encode()) % 4 == 2 and r.lang and len(clean(r.text)) >= 400][:600]
    shares = []
    for n in (20, 40, 80, 120, 150, 180, 199, 200, 220, 260, 400):
        told = [min(zip(coders.sizes(clean(r.text)[:n].encode()), names, strict=True))[1] == r.lang for r in held]
        shares.append(sum(told) / len(told))
    assert all(later >= earlier - 0.01 for earlier, later in zip(shares, shares[1:], strict=False)) and shares[4] >= 0.97


def test_any_number_of_languages_and_null_or_repeated_rows(spark, monkeypatch):
    monkeypatch.setattr(language_id, "AT_ONCE", 2)
    name = lambda i: "".join(chr(97 + (i * k) % 26) + chr(97 + i // 26 * k % 26) for k in (1, 7, 11, 5, 3, 17))
    schema = "lang string, row string, doc_id long, text string, h long"
    data = [(lang, "r", None, t, 1) for _, t, lang, _ in rows()] + [(f"l{i}", "r", 7, f"{name(i)} other{name(i)} " * 30, 1) for i in range(150)] + [("xx", "r", 5, text("xx", 1), 1)] * 300
    df = spark.createDataFrame(data, schema).repartition(4)
    known = learn(df)
    assert len(known) == 153 and set(WORDS) < set(known)
    some = spark.createDataFrame([("a", "r", i, text(lang, 900 + i), 1) for i, lang in enumerate(WORDS)] + [("a", "r", 9, f"{name(7)} other{name(7)} " * 9, 1)], schema)
    found = {r.row.doc_id: r.lang_pred for r in identify(some, known).collect()}
    assert found == {**dict(enumerate(WORDS)), 9: "l7"}
    assert keep_identified(some, known).columns == some.columns
    assert identify(df.where("doc_id = 5"), known).count() == 300


def test_pieces_come_from_the_whole_text():
    t = " ".join(f"w{chr(97 + i % 26)}{chr(97 + i // 26 % 26)}{chr(97 + i // 676)}" for i in range(5_000))
    found = pieces(t)
    data = clean(t).encode()
    assert len(found) == PIECES and data.startswith(found[min(range(PIECES), key=lambda i: data.index(found[i]))]) and any(data.endswith(p) for p in found)
    assert pieces("ab cd") == [b"ab cd"] and pieces("") == []
    assert b"".join(sorted(pieces("x" * 700))) == b"x" * 3 * 256
