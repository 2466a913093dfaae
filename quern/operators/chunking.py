"""Chunking documents by words or sentences: narrow, built-in functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import WS, is_blank, strip_ws, word_count, words
from ..functions.vectors import let

CHUNK_SIZE, OVERLAP, SENTENCE_WORDS = 300, 50, 300


def check_sizes(chunk_size: int, overlap: int) -> None:
    if overlap >= chunk_size:
        raise ValueError(f"overlap {overlap} has to be less than chunk_size {chunk_size}")


def word_chunks(text: Column, chunk_size: int = CHUNK_SIZE, overlap: int = OVERLAP) -> Column:
    """Windows of ``chunk_size`` words, each ``chunk_size - overlap`` after the last, up to the first that reaches the end; none of blank text."""
    check_sizes(chunk_size, overlap)
    stride = chunk_size - overlap

    def windows(w: Column) -> Column:
        n = F.size(w)
        last = F.greatest(F.lit(0), F.ceil((n - chunk_size) / stride)).cast("int")
        starts = F.filter(F.sequence(F.lit(0), last), lambda i: i * stride < n)
        return F.transform(starts, lambda i: F.array_join(F.slice(w, i * stride + 1, F.lit(chunk_size)), " "))

    return let(F.coalesce(words(text), F.array().cast("array<string>")), windows)


def sentences(text: Column) -> Column:
    """Text cut after . ! or ? where white space follows; the white space goes."""
    return F.split(strip_ws(text), f"(?<=[.!?]){WS}+")


def sentence_chunks(text: Column, max_words: int = SENTENCE_WORDS) -> Column:
    """Sentences packed while their words fit; a longer sentence is a chunk of its own, whole.

    One pass over the sentences' word counts finds where chunks begin; each is then a slice.
    """
    start = F.struct(F.array(F.lit(1)).alias("starts"), F.lit(0).alias("n"), F.lit(1).alias("i"))

    def add(state: Column, n: Column) -> Column:
        full = (state["n"] + n > max_words) & (state["i"] > F.element_at(state["starts"], -1))
        return F.struct(F.when(full, F.concat(state["starts"], F.array(state["i"]))).otherwise(state["starts"]).alias("starts"), F.when(full, n).otherwise(state["n"] + n).alias("n"), (state["i"] + 1).alias("i"))

    def packed(s: Column) -> Column:
        starts = F.aggregate(F.transform(s, word_count), start, add, lambda state: state["starts"])
        return let(F.struct(s.alias("s"), starts.alias("a")), lambda x: F.transform(F.arrays_zip(x["a"].alias("at"), F.slice(x["a"], F.lit(2), F.size(x["a"])).alias("to")), lambda c: F.array_join(F.slice(x["s"], c["at"], F.coalesce(c["to"], F.size(x["s"]) + 1) - c["at"]), " ")))

    return F.when(is_blank(text), F.array().cast("array<string>")).otherwise(let(sentences(text), packed))


def chunk_id(*parts: Column) -> Column:
    """A chunk's id: the same on every run."""
    return F.sha2(F.concat_ws("|", *[p.cast("string") for p in parts]), 256)


def explode_chunks(docs: DataFrame, chunks: Column, id_col: str = "doc_id") -> DataFrame:
    """A row per chunk with its metadata: chunk_id, position, word_count, char_count; ``docs``' other columns stay, text is the chunk's."""
    keep = [c for c in docs.columns if c != "text"]
    # outer: else Spark infers a filter on the number of chunks that makes them once more
    rows = docs.select(*keep, F.posexplode_outer(chunks).alias("position", "text")).where("position is not null")
    return rows.withColumns({"chunk_id": chunk_id(F.col(id_col), F.col("position")), "word_count": word_count(F.col("text")), "char_count": F.length("text")})


def chunk_by_words(docs: DataFrame, chunk_size: int = CHUNK_SIZE, overlap: int = OVERLAP) -> DataFrame:
    return explode_chunks(docs, word_chunks(F.col("text"), chunk_size, overlap))


def chunk_by_sentences(docs: DataFrame, max_words: int = SENTENCE_WORDS) -> DataFrame:
    return explode_chunks(docs, sentence_chunks(F.col("text"), max_words))


def ingest_stats(docs: DataFrame, chunk_size: int = CHUNK_SIZE, overlap: int = OVERLAP) -> DataFrame:
    """Per document: chunks and embeddings it makes, and a message where it makes none. No shuffle."""
    n = F.size(word_chunks(F.col("text"), chunk_size, overlap)).cast("long")
    return docs.select("doc_id", F.coalesce(n, F.lit(0).cast("long")).alias("chunks_created")).select(
        "doc_id", "chunks_created", F.col("chunks_created").alias("embeddings_stored"), F.when(F.col("chunks_created") == 0, F.lit("No text content found to ingest")).alias("message")
    )
