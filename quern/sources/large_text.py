"""Word chunks of text files of any length: no task holds a document, and a file is read by as many tasks as it has splits.

Files are read in splits, word by word. A first pass counts the words of each split; the sums before a split tell its
words' numbers in the file, and so which chunks they belong to. A second pass cuts the chunks: those that lie in a split are
complete, those across a border are put together from a piece of each split.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import WS, words
from ..operators.chunking import CHUNK_SIZE, OVERLAP, check_sizes
from ..storage import durable

#: Splits (about 100 bytes each) whose sums are broadcast; beyond it, a shuffled join.
BROADCAST_SPLITS = 500_000


def _words(spark: SparkSession, path: str) -> DataFrame:
    """(source, split, value) in the order of the files, a row for what stands between two spaces: a word, or words with other white space between them."""
    rows = spark.read.option("lineSep", " ").text(path)
    return rows.select(F.col("_metadata.file_path").alias("source"), F.col("_metadata.file_block_start").alias("split"), "value")


def _cut(size: int, stride: int):
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, file, held, first, position, last, out = None, 0, [], 0, 0, 0, []

        def give(n: int, piece: list[str]) -> None:
            out.append((file, n, first, len(piece), " ".join(piece)))

        def flush() -> Iterator[pa.RecordBatch]:
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.string()), strict=True)], names="file position first word_count text".split())
                out.clear()

        def ended() -> None:
            """What the split holds of chunks that go on in the next."""
            nonlocal position
            while position <= last and held:
                give(position, held[:size] if first == position * stride else held[: position * stride + size - first])
                position += 1
                drop()

        def drop() -> None:
            nonlocal first, held
            gone = min(len(held), max(0, position * stride - first))
            if gone:
                held, first = held[gone:], first + gone

        for batch in batches:
            parts = batch.column("part").to_numpy()
            borders = [0, *(np.flatnonzero(np.diff(parts)) + 1).tolist(), len(parts)]
            for i, j in zip(borders, borders[1:]):
                if i < j and parts[i] != at:
                    ended()
                    at, held = parts[i], []
                    file, first, total = (batch.column(c)[i].as_py() for c in ("file", "before", "total"))
                    last = max(0, -(-(total - size) // stride))
                    position = max(0, -(-(first - size + 1) // stride))  # the first chunk that reaches into the split
                held += " ".join(batch.column("value").slice(i, j - i).to_pylist()).split()  # the white space of functions.text
                while position <= last and first + len(held) >= position * stride + size:
                    end = position * stride + size - first
                    if end > 0:
                        give(position, held[:end])
                    position += 1
                    drop()
            yield from flush()
        ended()
        yield from flush()

    return cut


def chunk_files(spark: SparkSession, path: str, chunk_size: int = CHUNK_SIZE, overlap: int = OVERLAP) -> DataFrame:
    """(source, position, text, word_count): the chunks that ``chunking.chunk_by_words`` makes of each file's whole text. Files without words have none."""
    check_sizes(chunk_size, overlap)
    found = _words(spark, path)
    value = F.col("value")
    n = F.when(value.rlike(WS), F.size(words(value))).when(value == "", 0).otherwise(1)  # a split makes its pattern anew for every row
    counts = durable(found.groupBy("source", "split").agg(F.sum(n).alias("n")).withColumn("part", F.monotonically_increasing_id()))
    whole = W.partitionBy("source")  # as many rows as a file has splits
    before = F.sum("n").over(whole.orderBy("split").rowsBetween(W.unboundedPreceding, 0)) - F.col("n")
    known = durable(counts.select("source", "split", "part", F.min("part").over(whole).alias("file"), before.alias("before"), F.sum("n").over(whole).alias("total")))
    if known.limit(BROADCAST_SPLITS + 1).count() > BROADCAST_SPLITS:
        raise ValueError(f"more than {BROADCAST_SPLITS} splits: chunk the files in several calls")
    placed = found.join(F.broadcast(known), ["source", "split"]).select("part", "file", "before", "total", "value")  # map-side, so that words stay in order
    pieces = placed.mapInArrow(_cut(chunk_size, chunk_size - overlap), "file long, position long, first long, word_count int, text string")
    parts = F.sort_array(F.collect_list(F.struct("first", "text", "word_count")))  # a chunk has at most chunk_size pieces
    chunks = pieces.groupBy("file", "position").agg(parts.alias("p")).join(F.broadcast(known.where("part = file").select("file", "source")), "file")
    return chunks.select("source", F.col("position").cast("int").alias("position"), F.array_join("p.text", " ").alias("text"), F.aggregate("p", F.lit(0), lambda s, x: s + x["word_count"]).alias("word_count"))
