"""Embedders: a hashing one, models as plug-ins."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Protocol

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import is_blank, words


#: Cells of the vectors that are counted at once.
CELLS = 1 << 22


class Embedder(Protocol):
    name: str
    dimension: int

    def embed(self, df: DataFrame, text: str = "text", to: str = "embedding") -> DataFrame:
        """``df`` with the vectors of its texts."""


def zeros(dimension: int) -> Column:
    return F.array_repeat(F.lit(0.0).cast("float"), dimension)


def hash_vector(text: Column, dimension: int) -> Column:
    """Word counts in ``dimension`` buckets of the words' md5, normalised; zeros for blank text.

    Buckets are made in the JVM, by its rules for words; counting them is one numpy pass over a batch, since built-in functions
    would go through the words, or copy the vector, once for every bucket or word.
    """

    @F.arrow_udf("array<float>")
    def counted(buckets: pa.Array) -> pa.Array:
        flat, ends = buckets.flatten().to_numpy(zero_copy_only=False), np.concatenate([[0], np.cumsum(pc.fill_null(pc.list_value_length(buckets), 0).to_numpy())])
        out = np.empty((len(buckets), dimension), np.float32)
        step = max(1, CELLS // dimension)
        for i in range(0, len(buckets), step):
            j = min(len(buckets), i + step)
            row = np.repeat(np.arange(j - i), np.diff(ends[i : j + 1]))
            counts = np.bincount(row * dimension + flat[ends[i] : ends[j]], minlength=(j - i) * dimension).reshape(j - i, dimension).astype(np.float64)
            norms = np.sqrt((counts * counts).sum(axis=1, keepdims=True))
            out[i:j] = counts / np.where(norms == 0, 1.0, norms)
        return pa.ListArray.from_arrays(pa.array(np.arange(len(buckets) + 1) * dimension, pa.int32()), pa.array(out.ravel()))

    return counted(F.transform(words(F.lower(text)), lambda w: (F.conv(F.substring(F.md5(w.cast("binary")), 1, 8), 16, 10).cast("long") % dimension).cast("int")))


class HashEmbedder:
    """Deterministic vectors without a model."""

    def __init__(self, dimension: int = 384) -> None:
        self.name, self.dimension = f"hash-{dimension}", dimension

    def embed(self, df: DataFrame, text: str = "text", to: str = "embedding") -> DataFrame:
        return df.withColumn(to, hash_vector(F.col(text), self.dimension))


class ModelEmbedder:
    """A model made once per Python worker by ``load``; it maps lists of texts to lists of vectors, ``batch_size`` at a time.

    Each distinct text is embedded once and joined back; blank texts get zeros without the model.
    """

    def __init__(self, name: str, dimension: int, load: Callable[[], Callable[[list[str]], list]], batch_size: int = 32) -> None:
        self.name, self.dimension, self.load, self.batch_size = name, dimension, load, batch_size

    def embed_each(self, df: DataFrame, key: str, text: str, to: str = "embedding") -> DataFrame:
        """(key, to) for rows whose texts are known to differ and to be not blank: every row goes to the model where it is."""
        load, size = self.load, self.batch_size

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            model = load()
            for batch in batches:
                texts = list(batch[text])
                vectors = [[float(x) for x in v] for i in range(0, len(texts), size) for v in model(texts[i : i + size])]
                yield pd.DataFrame({key: batch[key], to: vectors})

        return df.select(key, *{text} - {key}).mapInPandas(run, f"`{key}` string, `{to}` array<float>")

    def embed(self, df: DataFrame, text: str = "text", to: str = "embedding") -> DataFrame:
        distinct = df.where(~is_blank(F.col(text))).select(F.col(text).alias("_text")).distinct()
        vectors = self.embed_each(distinct, "_text", "_text", to)
        return df.join(vectors, F.col(text) == F.col("_text"), "left").drop("_text").withColumn(to, F.coalesce(to, zeros(self.dimension)))


def sentence_transformer(name: str = "all-MiniLM-L6-v2", dimension: int = 384, device: str | None = None) -> ModelEmbedder:
    """A sentence-transformers model, if that package is installed where the tasks run; the best device there if none is named."""

    def load() -> Callable[[list[str]], list]:
        import torch
        from sentence_transformers import SentenceTransformer

        best = "cuda" if torch.cuda.is_available() else "mps" if torch.backends.mps.is_available() else "cpu"
        return SentenceTransformer(name, device=device or best).encode

    return ModelEmbedder(name, dimension, load)


def embedder_for(name: str, dimension: int = 384, device: str | None = None) -> Embedder:
    return HashEmbedder(dimension) if name.startswith("hash") else sentence_transformer(name, dimension, device)
