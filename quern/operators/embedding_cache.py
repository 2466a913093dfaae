"""Vectors that are kept over calls: a text is embedded once by all ingests that share a cache."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import is_blank
from ..storage import durable
from .embedding import Embedder, zeros

#: Keys (64 bytes each) that are broadcast to fetch their texts; beyond it, a shuffled join.
BROADCAST_KEYS = 200_000


class CachedEmbedder:
    """An embedder in front of a table (key, embedding) below a path, where key is the hash of model, dimension and text.

    The table is bucketed by key. Keys are dealt to its buckets, so that it is read where it lies and never shuffled; texts aren't:
    those that it lacks are fetched by their keys, once, embedded and appended. Two ingests at the same time may both embed a text, of which one row counts.
    Blank texts have zeros without model or cache.
    """

    def __init__(self, spark: SparkSession, embedder: Embedder, path: str, buckets: int = 64) -> None:
        self.spark, self.embedder, self.path, self.buckets = spark, embedder, path.rstrip("/"), buckets
        self.name, self.dimension = embedder.name, embedder.dimension
        self.table = f"quern_vectors_{hashlib.sha256(self.path.encode()).hexdigest()[:16]}"
        spark.sql(f"create table if not exists {self.table} (key string, embedding array<float>) using parquet clustered by (key) sorted by (key) into {buckets} buckets location '{self.path}'")

    def rows(self) -> DataFrame:
        self.spark.catalog.refreshTable(self.table)
        return self.spark.table(self.table)

    def key(self, text: Column) -> Column:
        return F.when(~is_blank(text), F.sha2(F.concat_ws("\x1f", F.lit(self.name), F.lit(str(self.dimension)), text).cast("binary"), 256))

    def _dealt(self, df: DataFrame) -> DataFrame:
        return df.repartition(self.buckets, "key")

    def embed(self, df: DataFrame, text: str = "text", to: str = "embedding") -> DataFrame:
        """``df`` with the vectors of its texts; what the cache lacks is embedded and added before this returns."""
        keyed = df.withColumn("_key", self.key(F.col(text)))
        keys = durable(self._dealt(keyed.where("_key is not null").select(F.col("_key").alias("key")).distinct()))
        lacking = durable(self.missing(keys))
        new = keyed.select(F.col("_key").alias("key"), F.col(text).alias("_asked_text")).join(F.broadcast(lacking) if lacking.count() <= BROADCAST_KEYS else lacking, "key", "left_semi").dropDuplicates(["key"])
        made = self.embedder.embed_each(new, "key", "_asked_text") if hasattr(self.embedder, "embed_each") else self.embedder.embed(new, "_asked_text", "embedding").select("key", "embedding")
        self._dealt(made).sortWithinPartitions("key").write.insertInto(self.table)
        vectors = self.found(keys)
        met = keyed.join(vectors.select(F.col("key").alias("_key"), F.col("embedding").alias("_vector")), "_key", "left")
        return met.select(*df.columns, F.coalesce("_vector", zeros(self.dimension)).alias(to))

    def missing(self, texts: DataFrame) -> DataFrame:
        """Of (key, ...) in the table's buckets, those without a vector."""
        return self._dealt(texts).join(self.rows().select("key").hint("merge"), "key", "left_anti")

    def found(self, keys: DataFrame) -> DataFrame:
        """The vectors of (key), one each."""
        return self._dealt(keys).join(self.rows().groupBy("key").agg(F.first("embedding").alias("embedding")).hint("merge"), "key")

    def forget(self) -> None:
        """Takes the table out of the catalog; its files stay."""
        self.spark.sql(f"drop table if exists {self.table}")
