"""The whole memory behind one object: ingest, query, save, load, statistics."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators.assembly import assemble_prompts
from .operators.chunking import check_sizes, chunk_by_words, ingest_stats
from .operators.embedding import Embedder, embedder_for
from .operators.inference import Inference
from .operators.memory import Memory
from .operators.retrieval import Retriever
from .sources.config import Config, load_config
from .sources.files import DOCUMENT, ingestable

PAYLOAD = ["text", "source", "file_type", "extension", "position", "word_count", "char_count", "chunk_id"]


class MemorySystem:
    def __init__(self, spark: SparkSession, config: Config | str | None = None, embedder: Embedder | None = None, llm: Inference | None = None, auto_save: bool = True) -> None:
        """With a saved memory at the configured path, starts from it. ``auto_save`` appends each ingest there."""
        self.spark = spark
        self.config = config if isinstance(config, Config) else load_config(config)
        check_sizes(self.config.chunk_size, self.config.overlap)
        self.embedder = embedder or embedder_for(self.config.embedder, self.config.dimension)
        self.llm = llm or Inference(self.config.provider, self.config.provider_settings.get("model"), self.config.provider_settings)
        path = self.config.index_path
        self.path = path if "://" in path or os.path.isabs(path) else os.path.abspath(path)
        self.auto_save = auto_save
        self.memory = Memory.load(spark, self.path) if Memory.exists(spark, self.path) else Memory(spark, self.embedder.dimension, "cosine")

    def ingest(self, docs: DataFrame) -> DataFrame:
        """Adds documents (doc_id, text, source, file_type, extension); per document what it made."""
        chunks = self.embedder.embed(chunk_by_words(docs, self.config.chunk_size, self.config.overlap))
        if not self.auto_save:
            self.memory = self.memory.add(chunks)
        elif Memory.exists(self.spark, self.path):
            self.memory = self.memory.append(self.path, chunks)
        else:
            self.memory.add(chunks).save(self.path)
            self.memory = Memory.load(self.spark, self.path)
        return ingest_stats(docs, self.config.chunk_size, self.config.overlap).join(docs.select("doc_id", "source", "file_type"), "doc_id")

    def ingest_document(self, text: str, source: str | None = None, file_type: str = "text", extension: str = "txt") -> dict:
        docs = self.spark.createDataFrame([(self.memory.batches, text, source or None, file_type, extension)], DOCUMENT)
        return _result(self.ingest(docs).first().asDict(), source)

    def ingest_file(self, path: str, source: str | None = None) -> dict:
        docs = ingestable(self.spark, path)
        docs = docs.withColumn("source", F.lit(source)) if source else docs
        row = self.ingest(docs).first().asDict()
        return _result(row, row["source"])

    @property
    def retriever(self) -> Retriever:
        return Retriever(self.memory, self.embedder, self.config.top_k, self.config.similarity_threshold, PAYLOAD)

    def retrieve(self, queries: DataFrame, k: int | None = None, threshold: float | None = None) -> DataFrame:
        """Results of many queries (query_id, text), with the chunks' columns."""
        return self.retriever.retrieve(queries, k, threshold)

    def retrieve_multi_query(self, queries: DataFrame, k: int | None = None) -> DataFrame:
        """Per group of queries (group_id, qpos, text) the best results of all together, each text once."""
        return self.retriever.retrieve_multi_query(queries, k)

    def deduplicate(self, results: DataFrame, threshold: float = 0.8) -> DataFrame:
        """Results without those whose words are nearly those of a better one of their query."""
        return self.retriever.deduplicate(results, threshold)

    def explain(self, queries: DataFrame, k: int = 5) -> DataFrame:
        return self.retriever.explain(queries, k)

    def ask(self, queries: DataFrame, k: int | None = None, template: str = "default") -> DataFrame:
        """(query_id, prompt, response, ...) of many queries (query_id, text)."""
        prompts = assemble_prompts(queries, self.retrieve(queries, k), template, self.config.max_context)
        return self.llm.generate(prompts, max_tokens=self.config.max_tokens, temperature=self.config.temperature)

    def query(self, question: str, k: int | None = None, return_context: bool = False, template: str = "default") -> dict:
        queries = self.spark.createDataFrame([(0, question)], "query_id long, text string")
        results = self.retrieve(queries, k)
        found = results.orderBy("rank").collect()  # k rows
        kept = self.spark.createDataFrame(found, results.schema)
        prompt = assemble_prompts(queries, kept, template, self.config.max_context).first().prompt
        answer = self.llm.generate_one(prompt, self.config.max_tokens, self.config.temperature)
        sources = [{"text": r.text, "score": r.score, "rank": r["rank"], "metadata": {c: r[c] for c in PAYLOAD[1:] if r[c] is not None}} for r in found]
        out = {"answer": answer["response"], "sources": sources, "tokens_used": answer["tokens_used"], "latency_ms": answer["latency_ms"]}
        return out | ({"full_prompt": prompt} if return_context else {})

    def save_memory(self, path: str) -> None:
        self.memory.save(os.path.abspath(path) if "://" not in path else path)

    def load_memory(self, path: str) -> None:
        self.memory = Memory.load(self.spark, os.path.abspath(path) if "://" not in path else path)

    def clear(self) -> None:
        self.memory = self.memory.clear()

    def statistics(self) -> dict:
        return self.memory.statistics().first().asDict() | {"embedding_model": self.embedder.name, "llm_provider": self.llm.provider, "llm_model": self.llm.model}


def _result(row: dict, source: str | None) -> dict:
    out = {"chunks_created": row["chunks_created"], "embeddings_stored": row["embeddings_stored"], "source": source, "file_type": row["file_type"]}
    return out | ({"message": row["message"]} if row["message"] else {})
