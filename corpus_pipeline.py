"""The training-corpus pipeline: language ID, exact and near deduplication, decontamination, source mixing.

Each stage takes (spark, docs, sf_dir); its rows are written as Parquet and read again as the next one's docs.
All but the last return the columns of ``documents``, and others that these have.

Defined results: a null text, or one without letters, has no language and goes in the first stage; so no later one
meets it there, though each stage by itself keeps to its operator's rules for nulls, ties and repeated rows. A null id
is an id like any other: its row stays unless a copy of its text has one. Documents without a source are mixed as
source ''. An empty table gives no rows, also where a stage leaves nothing.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from quern.llm.common import delete, durable, read, shared_dir
from quern.llm.decontaminate import drop_contaminated
from quern.llm.exact_dedup import drop_exact_duplicates
from quern.llm.language_id import keep_identified, learn, training_rows
from quern.llm.mix_sources import mix_sources
from quern.llm.near_dedup import drop_near_duplicates


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is told clearly; the dictionaries learn from the stage's own input."""
    return keep_identified(docs, learn(training_rows(docs)))


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the document with the largest id."""
    return drop_exact_duplicates(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of near copies the document with the smallest id."""
    return drop_near_duplicates(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a window of the benchmark."""
    return drop_contaminated(docs, read(spark, sf_dir, "benchmark"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mixture: a row per taken copy of a document."""
    return mix_sources(docs)


STAGES = [("language_id", language_id), ("exact_dedup", exact_dedup), ("near_dedup", near_dedup), ("decontaminate", decontaminate), ("mix_sources", mix)]

#: Compression and alignment have no SQL. Tests hold each stage against its operator, whose own tests are by brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what lies between them is Parquet in the shared folder, each deleted when the next is written."""
    docs = read(spark, sf_dir, "documents")
    folder = f"{shared_dir(spark)}/quern-pipeline-{uuid.uuid4().hex}"
    before = None
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        if before:
            delete(spark, f"{folder}/{before}")
        docs, before = spark.read.parquet(f"{folder}/{name}"), name
    mixed = durable(STAGES[-1][1](spark, docs, sf_dir))
    delete(spark, folder)
    return mixed
