"""Incremental ingest: documents that arrive as files are chunked, embedded and appended once."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.chunking import chunk_by_words
from ..operators.embedding import Embedder
from ..operators.memory import Memory


def chunk_stream(documents: DataFrame, chunk_size: int, overlap: int, embedder: Embedder | None = None) -> DataFrame:
    """Chunks of a stream of documents; stateless, so nothing waits for a watermark."""
    chunks = chunk_by_words(documents, chunk_size, overlap)
    return embedder.embed(chunks) if embedder else chunks


def read_documents(spark: SparkSession, folder: str, schema: str, glob: str | None = None, files_a_trigger: int = 1_000) -> DataFrame:
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_a_trigger)
    return (reader.option("pathGlobFilter", glob) if glob else reader).parquet(folder)


def ingest(chunks: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Appends the chunks to Parquet, exactly once (the file sink's log), and stops when what is there is done."""
    return chunks.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()


def ingest_into(documents: DataFrame, path: str, stream: str, embedder: Embedder, checkpoint: str, chunk_size: int = 200, overlap: int = 50, keys: tuple[str, ...] = ("doc_id", "text")) -> StreamingQuery:
    """Appends a stream of documents to the memory saved at ``path`` and stops when what is there is done.

    Documents that were sent before (equal ``keys``, remembered by hash in the stream's state) are dropped. Each epoch is one append
    that counts once, also where it is run again after a failure: its log entry is named by stream and epoch.
    """
    spark = documents.sparkSession
    key = F.sha2(F.concat_ws("\x1f", *[F.coalesce(F.col(k).cast("string"), F.lit("\x00")) for k in keys]).cast("binary"), 256)
    chunks = chunk_stream(documents.withColumn("_sent", key).dropDuplicates(["_sent"]).drop("_sent"), chunk_size, overlap, embedder)

    def append(batch: DataFrame, epoch: int) -> None:
        Memory.load(spark, path).append(path, batch, once=(stream, epoch))

    return chunks.writeStream.foreachBatch(append).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def only_new(chunks: DataFrame, seen: DataFrame, key: str = "chunk_id") -> DataFrame:
    """Chunks that aren't in a table yet, for sources that send documents again."""
    return chunks.join(seen.select(F.col(key)), key, "left_anti")
