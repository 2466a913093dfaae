"""The memory: chunks with their vectors as one table."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from dataclasses import dataclass
from functools import cached_property, partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.vectors import normalize
from ..storage import create_text, delete, exists, list_names, read_text, replace_text, size

SCHEMA = "batch_id string, doc_id long, position int, chunk_id string, text string, source string, file_type string, extension string, word_count int, char_count int, embedding array<float>, extra map<string,string>"
METRICS = ("L2", "cosine")
#: Log entries after which an append sums the log up.
CHECKPOINT = 50


class Memory:
    """An append-only store. The state is a DataFrame; ``idx`` orders it as inserted."""

    def __init__(self, spark: SparkSession, dimension: int, metric: str = "L2", table: DataFrame | None = None, batches: int = 0) -> None:
        if metric not in METRICS:
            raise ValueError(f"Unsupported index type: {metric}")
        self.spark, self.dimension, self.metric, self.batches = spark, dimension, metric, batches
        self.table = spark.createDataFrame([], SCHEMA) if table is None else table

    def add(self, chunks: DataFrame, batch_id: str | None = None) -> Memory:
        """Appends chunks (text and embedding at least; other columns of the schema are taken where there are any). A wrong dimension raises at run time."""
        names = [x.split()[0] for x in SCHEMA.split(", ")]
        kinds = dict(x.split() for x in SCHEMA.split(", "))
        have = set(chunks.columns)
        vector = F.col("embedding").cast("array<float>")
        vector = normalize(vector).cast("array<float>") if self.metric == "cosine" else vector
        ok = F.when(F.size("embedding") == self.dimension, vector).otherwise(F.raise_error(F.concat(F.lit(f"vectors need {self.dimension} values, not "), F.size("embedding").cast("string"))).cast("array<float>"))
        own = {"batch_id": F.lit(batch_id or f"{self.batches:09d}"), "embedding": ok, "extra": F.col("extra") if "extra" in have else F.create_map().cast("map<string,string>")}
        rows = chunks.select(*[own.get(c, F.col(c).cast(kinds[c]) if c in have else F.lit(None).cast(kinds[c])).alias(c) for c in names])
        return Memory(self.spark, self.dimension, self.metric, self.table.unionByName(rows), self.batches + 1)

    @cached_property
    def indexed(self) -> DataFrame:
        """The table with idx: a sortable key of batch, document and position, and of the chunk itself where these are missing."""
        content = F.hex(F.xxhash64("text", "source"))
        return self.table.withColumn("idx", F.concat_ws("|", "batch_id", F.lpad(F.coalesce(F.col("doc_id"), F.lit(0)).cast("string"), 20, "0"), F.lpad(F.coalesce(F.col("position"), F.lit(0)).cast("string"), 9, "0"), F.when(F.col("doc_id").isNull() | F.col("chunk_id").isNull(), content).otherwise(F.col("chunk_id"))))

    def statistics(self) -> DataFrame:
        return self.table.agg(F.count("*").alias("total_chunks")).withColumns({"dimension": F.lit(self.dimension), "index_type": F.lit(self.metric)})

    def clear(self) -> Memory:
        """An empty memory of the same kind; files stay."""
        return Memory(self.spark, self.dimension, self.metric)

    def save(self, path: str) -> str:
        """Writes a new version below ``path`` and then names it in config.json, so a reader always finds a whole one."""
        version = f"v-{uuid.uuid4().hex}"
        self.table.write.parquet(f"{path}/{version}")
        replace_text(self.spark, f"{path}/config.json", json.dumps({"dimension": self.dimension, "index_type": self.metric, "batches": self.batches, "version": version}))
        return version

    def append(self, path: str, chunks: DataFrame, once: tuple[str, int] | None = None) -> Memory:
        """Appends chunks to a saved memory: writes the new rows only.

        Each append first claims the next number of the log with a file that only one writer can make, so appends at the same
        time all count; a number whose rows were never finished is left out. With ``once``, a stream's name and an epoch of
        it, the entry has these as its name and is made when its rows are written: the epoch counts once, however often it comes.
        Every ``CHECKPOINT`` entries the log is summed up in a snapshot.
        """
        config = _config(self.spark, path)
        state = _state(self.spark, path, config)
        version = f"v-{uuid.uuid4().hex}"
        new = Memory(self.spark, config["dimension"], config["index_type"], batches=config["batches"] + state.next)
        if once:
            stream, epoch = once
            if state.seen(stream, epoch):
                return Memory.load(self.spark, path)
            new.add(chunks, f"{stream}@{epoch:012d}").table.write.parquet(f"{path}/{version}")
            if not create_text(self.spark, f"{state.log}/{stream}@{epoch:012d}", version):
                delete(self.spark, f"{path}/{version}")  # the same epoch at the same time
        else:
            n = state.next
            while not create_text(self.spark, f"{state.log}/{n:09d}", ""):
                n += 1
            new.batches = config["batches"] + n
            new.add(chunks).table.write.parquet(f"{path}/{version}")
            replace_text(self.spark, f"{state.log}/{n:09d}", version)
        if state.entries + 1 >= CHECKPOINT:
            Memory.checkpoint(self.spark, path)
        return Memory.load(self.spark, path)

    @staticmethod
    def checkpoint(spark: SparkSession, path: str, merged: dict[str, list[str]] | None = None) -> bool:
        """Sums the log up in one file. merged: new folders, each with those that it stands for; False if one of these isn't in use any more.

        The next snapshot is claimed by its number. Who comes second begins again from the first one's snapshot, so nothing gets lost.
        """
        config = _config(spark, path)
        while True:
            state = _state(spark, path, config)
            folders = state.folders
            for new, old in (merged or {}).items():
                if not set(old) <= set(folders):
                    return False
                folders = [f for f in folders if f not in old] + [new]
            said = {"folders": folders, "next": state.next, "open": state.open, "streams": state.streams}
            if create_text(spark, f"{path}/snap-{config['version']}/{state.number + 1:09d}", json.dumps(said)):
                return True

    @staticmethod
    def compact(spark: SparkSession, path: str, small: int = 64 << 20) -> int:
        """Rewrites folders of less than ``small`` bytes as one; how many went. Memories that are loaded keep reading the old ones, which ``vacuum`` deletes."""
        folders = [f for f in _state(spark, path, _config(spark, path)).folders if size(spark, f"{path}/{f}") < small]
        if len(folders) < 2:
            return 0
        version = f"v-{uuid.uuid4().hex}"
        spark.read.schema(SCHEMA).parquet(*[f"{path}/{f}" for f in folders]).hint("rebalance").write.parquet(f"{path}/{version}")
        if Memory.checkpoint(spark, path, {version: folders}):
            return len(folders)
        delete(spark, f"{path}/{version}")  # another compaction was first
        return 0

    @staticmethod
    def vacuum(spark: SparkSession, path: str) -> int:
        """Deletes folders that compaction has replaced, when nobody reads or appends; how many."""
        state = _state(spark, path, _config(spark, path))
        old = [name for name in list_names(spark, path) if name.startswith("v-") and name not in state.folders]
        for name in old:
            delete(spark, f"{path}/{name}")
        return len(old)

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> Memory:
        """The saved memory with all finished appends; its dimension and metric are the saved ones. Reads the last snapshot and the entries since."""
        config = _config(spark, path)
        state = _state(spark, path, config)
        table = spark.read.schema(SCHEMA).parquet(*[f"{path}/{v}" for v in state.folders])
        return cls(spark, config["dimension"], config["index_type"], table, config["batches"] + state.next)

    @staticmethod
    def exists(spark: SparkSession, path: str) -> bool:
        return exists(spark, f"{path}/config.json")


@dataclass
class _State:
    """What a log says: folders in use, the next number, numbers that were claimed and not finished, the last epoch of each stream, and how many entries came after snapshot ``number``."""

    log: str
    number: int
    folders: list[str]
    next: int
    open: list[int]
    streams: dict[str, int]
    entries: int = 0

    def seen(self, stream: str, epoch: int) -> bool:
        return epoch <= self.streams.get(stream, -1)


def _state(spark: SparkSession, path: str, config: dict) -> _State:
    return summed(partial(list_names, spark), partial(read_text, spark), path, config)


def summed(names: Callable[[str], list[str]], text: Callable[[str], str], path: str, config: dict) -> _State:
    """The last snapshot, and the entries that it doesn't cover. names: of a folder's files, in order; text: of a small file."""
    log, snaps = f"{path}/log-{config['version']}", f"{path}/snap-{config['version']}"
    last = (names(snaps) or [None])[-1]
    said = json.loads(text(f"{snaps}/{last}")) if last else {"folders": [config["version"]], "next": 0, "open": [], "streams": {}}
    state = _State(log, int(last or 0), said["folders"], said["next"], [], dict(said["streams"]))
    for name in names(log):
        stream, at, epoch = name.rpartition("@")
        if at and int(epoch) <= said["streams"].get(stream, -1) or not at and int(name) < said["next"] and int(name) not in said["open"]:
            continue
        state.entries += 1
        version = text(f"{log}/{name}")
        if version:
            state.folders.append(version)
        if at:
            state.streams[stream] = int(epoch)
        else:
            state.next = max(state.next, int(name) + 1)
            state.open += [] if version else [int(name)]
    return state


def _config(spark: SparkSession, path: str) -> dict:
    return json.loads(read_text(spark, f"{path}/config.json"))
