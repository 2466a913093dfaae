import re
import time

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quern.functions.text import NOT_WORD, WS, fmt3, jaccard, normalize_ws, strip_ws, word_set
from quern.operators.chunking import chunk_by_sentences, chunk_by_words, ingest_stats, sentence_chunks, word_chunks


def model_words(text, size, overlap):
    w, out, start = text.split(), [], 0
    if len(w) <= size:
        return [" ".join(w)] if w else []
    while start < len(w):
        out.append(" ".join(w[start : start + size]))
        if start + size >= len(w):
            break
        start += size - overlap
    return out


def model_sentences(text, most):
    if not text.strip():
        return []
    out, now, n = [], [], 0
    for s in re.split(r"(?<=[.!?])\s+", text.strip()):
        k = len(s.split())
        if n + k > most and now:
            out.append(" ".join(now))
            now, n = [], 0
        now.append(s)
        n += k
    return out + ([" ".join(now)] if now else [])


TEXTS = ["", "   ", "short text", " ".join(f"word{i}" for i in range(30)), "a b c  d\te", "Sentence one. Sentence two! Sentence three? Sentence four.", "x." * 5, "one.  two two two two two two.\nthree!", "é " * 25 + "."]


def column(spark, texts, c):
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, text string").select("i", c.alias("c")).orderBy("i").collect()
    return [r.c for r in rows]


@pytest.mark.parametrize(("size", "overlap"), [(10, 2), (10, 0), (3, 2), (100, 10), (10, -10), (1, 0)])
def test_word_chunks(spark, size, overlap):
    assert column(spark, TEXTS, word_chunks(F.col("text"), size, overlap)) == [model_words(t, size, overlap) for t in TEXTS]


@settings(max_examples=5, deadline=None)
@given(st.lists(st.text("ab .!?\n　", max_size=60), min_size=30, max_size=60))
def test_chunks_of_any_text(spark, texts):
    assert column(spark, texts, word_chunks(F.col("text"), 4, 1)) == [model_words(t, 4, 1) for t in texts]
    assert column(spark, texts, sentence_chunks(F.col("text"), 5)) == [model_sentences(t, 5) for t in texts]


def test_thirty_words(spark):
    chunks = column(spark, [TEXTS[3]], word_chunks(F.col("text"), 10, 2))[0]
    assert [len(c.split()) for c in chunks] == [10, 10, 10, 6]
    assert chunks[0].split()[-2:] == chunks[1].split()[:2]


def test_overlap_has_to_be_smaller():
    with pytest.raises(ValueError):
        word_chunks(F.lit("x"), 10, 15)


@pytest.mark.parametrize("most", [5, 1, 300])
def test_sentence_chunks(spark, most):
    assert column(spark, TEXTS, sentence_chunks(F.col("text"), most)) == [model_sentences(t, most) for t in TEXTS]


def test_metadata_and_statistics(spark):
    docs = spark.createDataFrame([(1, " ".join("w" * 20), "s"), (2, "", "s"), (3, None, "s")], "doc_id long, text string, source string")
    rows = chunk_by_words(docs, 10, 0).orderBy("position").collect()
    assert [(r.doc_id, r.position, r.word_count, r.char_count, r.source) for r in rows] == [(1, 0, 10, 19, "s"), (1, 1, 10, 19, "s")]
    assert len({r.chunk_id for r in rows}) == 2 and rows == chunk_by_words(docs, 10, 0).orderBy("position").collect()
    stats = {r.doc_id: r for r in ingest_stats(docs, 10, 0).collect()}
    assert (stats[1].chunks_created, stats[1].message) == (2, None)
    assert stats[2].chunks_created == stats[3].chunks_created == 0 and stats[3].message == "No text content found to ingest"
    assert [r.position for r in chunk_by_sentences(docs, 5).collect()] == [0]


def test_white_space_and_words_by_code_point(spark):
    points = [c for c in range(1, 0x3100)]
    rows = spark.createDataFrame([(c, chr(c)) for c in points], "i int, c string").select("i", F.col("c").rlike(WS).alias("ws"), (F.regexp_replace("c", NOT_WORD, "") == "").alias("gone")).collect()
    assert all(r.ws == chr(r.i).isspace() for r in rows)
    differs = [r.i for r in rows if r.gone != bool(re.fullmatch(r"[^\w\s]", chr(r.i)))]
    assert len(differs) < 60 and not [c for c in differs if c < 0x600]


def test_text_functions(spark):
    assert column(spark, [" a  b ", "\n"], normalize_ws(F.col("text"))) == ["a b", ""]
    assert column(spark, [" a b\n"], strip_ws(F.col("text"))) == ["a b"]
    assert column(spark, ["B a, b! A_c"], word_set(F.col("text"))) == [["a", "a_c", "b"]]
    values = spark.createDataFrame([(0.0625,), (0.95,), (1.0,), (-0.0005,)], "x double").select(fmt3(F.col("x")).alias("x")).collect()
    assert [v.x for v in values][:3] == ["0.062", "0.950", "1.000"]
    pair = spark.createDataFrame([(["a", "b"], ["b"]), ([], [])], "a array<string>, b array<string>").select(jaccard(F.col("a"), F.col("b")).alias("j")).collect()
    assert [p.j for p in pair] == [0.5, 0.0]


def test_halves_print_as_the_cast_to_decimal_has_them(spark):
    values = spark.createDataFrame([(0.5255,), (-0.5235,), (0.6135,), (0.0625,), (123456.7895,)], "x double").select(fmt3(F.col("x")).alias("x")).collect()
    assert [v.x for v in values] == ["0.525", "-0.523", "0.614", "0.062", "123456.790"]


def test_long_white_space_is_read_once(spark):
    texts = ["a." + " " * 300_000 + "b", " \t" * 100_000]
    began = time.perf_counter()
    assert column(spark, texts, sentence_chunks(F.col("text"), 5)) == [["a. b"], []]
    assert column(spark, texts, strip_ws(F.col("text"))) == [texts[0], ""]
    assert time.perf_counter() - began < 20  # by a pattern: minutes


def test_counts_of_words_cost_little_beside_the_chunks(spark):
    docs = spark.range(1_600, numPartitions=4).select(F.col("id").alias("doc_id"), F.repeat(F.concat(F.lit("wörd "), F.col("id").cast("string"), F.lit(" sentence. ")), 500).alias("text")).cache()
    docs.count()

    def seconds(df):
        df.write.format("noop").mode("overwrite").save()
        took = []
        for _ in range(3):
            began = time.perf_counter()
            df.write.format("noop").mode("overwrite").save()
            took.append(time.perf_counter() - began)
        return min(took)

    rows = chunk_by_words(docs)
    assert rows.agg(F.sum("word_count")).first()[0] >= 1_600 * 1_500
    assert seconds(rows.select("doc_id", "word_count")) < 12 * seconds(docs.select(F.size(F.split("text", " "))))  # 5 times; by ranges 22
