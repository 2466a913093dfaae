"""A ledger of generated answers: what was asked once, by any run, is not asked again.

Every answer has a key, the hash of provider, model, settings and prompt. Tasks write answers to the ledger's
folder as they come, a file per batch, so that a lost executor or a job that is stopped loses a batch at most:
the task that is tried again finds the batches of its run, and a later run the ledger's keys. A prompt that fails after all
its tries is a row with its error, which later runs ask again only if told to. The last row of a key counts.
"""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from ..storage import durable, list_names, make_folder, rename
from .inference import RESULT, Inference

SCHEMA = f"key string, {RESULT}, run string, asked_at double"
#: Characters of prompts that a task asks, about; a longer prompt is asked whole.
BUCKET_CHARS = 64 << 20


class AnswerLedger:
    """A folder that the driver and all tasks reach, by a path that pyarrow can open. buckets: tasks that ask, at least; they grow with the prompts."""

    def __init__(self, spark: SparkSession, path: str, buckets: int = 64) -> None:
        self.spark, self.path, self.buckets = spark, path.rstrip("/"), buckets

    def rows(self) -> DataFrame:
        """Everything that was ever answered or failed."""
        names = list_names(self.spark, self.path)
        names = [n for n in names if f"ended-{n}" not in names]
        if not names:
            return self.spark.createDataFrame([], SCHEMA)
        return self.spark.read.schema(SCHEMA).option("recursiveFileLookup", "true").parquet(*[f"{self.path}/{n}" for n in names])

    def answers(self) -> DataFrame:
        """The last row of every key."""
        last = F.row_number().over(W.partitionBy("key").orderBy(F.desc("asked_at"), "run"))
        return self.rows().withColumn("_n", last).where("_n = 1").drop("_n")

    @staticmethod
    def key(llm: Inference, prompt: Column, max_tokens: int, temperature: float) -> Column:
        return F.sha2(F.concat_ws("\x1f", F.lit(llm.provider), F.lit(llm.model), F.lit(str(max_tokens)), F.lit(repr(float(temperature))), prompt).cast("binary"), 256)

    def generate(self, llm: Inference, prompts: DataFrame, prompt: str = "prompt", max_tokens: int = 1000, temperature: float = 0.7, max_retries: int = 1, backoff: float = 1.0, batch: int = 64, retry_failed: bool = False, sleep: Callable[[float], None] = time.sleep) -> DataFrame:
        """``prompts`` with the columns of ``RESULT`` and the run that asked; asks what the ledger doesn't know and returns when all is asked. A null prompt has a null row.

        Unknown prompts are dealt to a task per bucket by their keys, whatever the partitions of ``prompts``; two runs at the same time may both ask a prompt.
        """
        keyed = durable(prompts.withColumn("_key", F.when(F.col(prompt).isNotNull(), self.key(llm, F.col(prompt), max_tokens, temperature))))
        known = self.answers()
        known = known.where("error is null") if retry_failed else known
        new = keyed.where("_key is not null").select("_key", F.col(prompt).alias("_prompt")).dropDuplicates(["_key"]).join(known.select(F.col("key").alias("_key")), "_key", "left_anti")
        chars = keyed.agg(F.sum(F.length(prompt))).first()[0] or 0
        buckets = max(self.buckets, -(-chars // BUCKET_CHARS))
        bucket = F.pmod(F.xxhash64("_key"), F.lit(buckets)).cast("int")
        run = f"run-{uuid.uuid4().hex}"
        ask = _ask(llm, f"{self.path}/{run}", run, max_tokens, temperature, max_retries, backoff, batch, sleep)
        dealt = new.withColumn("_bucket", bucket).repartitionById(buckets, "_bucket")
        for n in range(buckets):
            make_folder(self.spark, f"{self.path}/{run}/{n}")
        try:
            dealt.select("_bucket", "_key", "_prompt").mapInArrow(ask, "asked long").write.format("noop").mode("overwrite").save()
        finally:  # tasks of a failed job may go on for a while; what they write under the old name doesn't count
            rename(self.spark, f"{self.path}/{run}", f"{self.path}/ended-{run}")
        found = self.answers().drop("asked_at").withColumnRenamed("key", "_key")
        return keyed.join(found, "_key", "left").drop("_key")


def _ask(llm: Inference, folder: str, run: str, max_tokens: int, temperature: float, max_retries: int, backoff: float, batch: int, sleep: Callable[[float], None]):
    kinds = to_arrow_schema(_schema())

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        client, waiting, bucket, done = None, [], None, set()
        fs, root = pafs.FileSystem.from_uri(folder)

        def commit(rows: list[tuple[str, str]]) -> None:
            nonlocal client
            client = client or llm.client()
            answers = [{"key": key, **llm.try_one(prompt, max_tokens, temperature, client, max_retries, backoff, sleep), "run": run, "asked_at": time.time()} for key, prompt in rows]
            name = uuid.uuid4().hex
            pq.write_table(pa.Table.from_pylist(answers, kinds), f"{root}/{bucket}/.{name}.tmp", filesystem=fs)
            fs.move(f"{root}/{bucket}/.{name}.tmp", f"{root}/{bucket}/{name}.parquet")

        asked = 0
        for b in batches:
            for at, key, prompt in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if at != bucket:
                    if waiting:
                        commit(waiting)
                    waiting, bucket, done = [], at, _committed(fs, f"{root}/{at}")
                if key in done:
                    continue
                waiting.append((key, prompt))
                asked += 1
                if len(waiting) >= batch:
                    commit(waiting)
                    waiting = []
        if waiting:
            commit(waiting)
        yield pa.RecordBatch.from_arrays([pa.array([asked], pa.int64())], names=["asked"])

    return ask


def _committed(fs: pafs.FileSystem, folder: str) -> set[str]:
    """Keys that an earlier try of the task has written."""
    files = [f.path for f in fs.get_file_info(pafs.FileSelector(folder, allow_not_found=True)) if f.path.endswith(".parquet")]
    return {key for f in files for key in pq.read_table(f, columns=["key"], filesystem=fs, partitioning=None)["key"].to_pylist()}


def _schema():
    from pyspark.sql.types import StructType

    return StructType.fromDDL(SCHEMA)
