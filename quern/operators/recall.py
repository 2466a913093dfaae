"""The recall demonstration: facts hidden in filler, asked about with the whole document in the prompt and by retrieval."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.synthetic import fact_document, facts, questions
from .assembly import assemble_prompts, direct_prompt
from .chunking import chunk_by_words
from .embedding import Embedder
from .evaluation import accuracy
from .inference import Inference
from .memory import Memory
from .retrieval import Retriever

#: Tokens of an answer to a prompt with the whole document, and results a question retrieves.
DIRECT_TOKENS, RETRIEVED = 10, 2


def direct_recall(document: DataFrame, asked: DataFrame, llm: Inference) -> DataFrame:
    """document: one row (text); asked: (question, expected). One row (accuracy, correct, total) of answers with the whole document in the prompt."""
    prompts = asked.select("question", "expected", direct_prompt(document.select("text").scalar(), F.col("question")).alias("prompt"))
    return accuracy(llm.generate(prompts, max_tokens=DIRECT_TOKENS))


def retrieval_recall(retriever: Retriever, asked: DataFrame, llm: Inference, k: int = RETRIEVED) -> DataFrame:
    """asked: (pos, question, expected). One row (accuracy, correct, total) of answers from k retrieved chunks."""
    queries = asked.select(F.col("pos").alias("query_id"), F.col("question").alias("text"))
    prompts = assemble_prompts(queries, retriever.retrieve(queries, k)).join(asked.select(F.col("pos").alias("query_id"), "expected"), "query_id")
    return accuracy(llm.generate(prompts))


def recall_demo(spark: SparkSession, embedder: Embedder, llm: Inference, n: int = 10, chunk_size: int = 200, overlap: int = 50, threshold: float = 0.1) -> DataFrame:
    """Both flows over a generated document: a row each (flow, accuracy, correct, total, improvement over the direct one)."""
    told = facts(spark, n)
    document, asked = fact_document(told), questions(told)
    docs = document.select(F.lit(0).cast("long").alias("doc_id"), "text", F.lit("test_doc").alias("source"), F.lit("text").alias("file_type"), F.lit("txt").alias("extension"))
    memory = Memory(spark, embedder.dimension, "cosine").add(embedder.embed(chunk_by_words(docs, chunk_size, overlap)))
    retriever = Retriever(memory, embedder, RETRIEVED, threshold, ["text", "source", "extension"])
    direct = direct_recall(document, asked, llm).withColumn("flow", F.lit("direct"))
    found = retrieval_recall(retriever, asked, llm).withColumn("flow", F.lit("retrieval"))
    base = direct.select("accuracy").scalar()
    return direct.unionByName(found).select("flow", "accuracy", "correct", "total", F.round(F.col("accuracy") - base, 9).alias("improvement"))
