"""A saved memory as a data source, for SQL and ``spark.read``.

``register(spark)`` names it; then ``spark.read.format("quern_memory").load(path)`` and ``create temporary view m using
quern_memory options (path '...')`` read all finished appends. A schema that is given (``spark.read.schema(...)``) says
which columns are read. Options ``<column>_from`` and ``<column>_to`` (both inclusive) bound a plain column: the tasks skip the
row groups outside by the files' statistics and filter the rest. Filters of a query are Spark's own: the pushdown of Python
sources isn't used, since Spark keeps what one query has pushed for the next one over the same view.

The log is read where Spark plans, by pyarrow: the folder has to be one that pyarrow opens too. A memory without rows
has no partitions.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.dataset as pads
import pyarrow.fs as pafs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from ..operators.memory import SCHEMA, summed

NAME = "quern_memory"
#: Bytes of files that one task reads; a larger file is one task.
TASK_BYTES = 128 << 20
_NUMBERS = ("doc_id", "position", "word_count", "char_count")
_TEXTS = ("batch_id", "chunk_id", "source", "file_type", "extension")


@dataclass
class Files(InputPartition):
    """Files that one task reads."""

    paths: list[str] = field(default_factory=list)


def register(spark: SparkSession) -> None:
    """Makes the source known to a session."""
    spark.dataSource.register(MemorySource)


class MemorySource(DataSource):
    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> MemoryReader:
        return MemoryReader(self.options["path"], schema, dict(self.options))


def _opened(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path)


def finished_files(path: str) -> list[tuple[str, int]]:
    """Data files of all finished appends with their bytes, by the log's order."""
    fs, root = _opened(path)

    def listed(folder: str) -> list[pafs.FileInfo]:
        found = fs.get_file_info(pafs.FileSelector(folder, allow_not_found=True))
        return sorted((f for f in found if not f.base_name.startswith((".", "_"))), key=lambda f: f.base_name)

    def text(file: str) -> str:
        with fs.open_input_stream(file) as stream:
            return stream.read().decode()

    state = summed(lambda folder: [f.base_name for f in listed(folder)], text, root, json.loads(text(f"{root}/config.json")))
    return [(f.path, f.size) for folder in state.folders for f in listed(f"{root}/{folder}") if f.base_name.endswith(".parquet")]


def bounds(options: dict[str, str]) -> pc.Expression | None:
    """What the ``_from`` and ``_to`` options say; a null is within no bounds."""
    said = None
    for column in (*_NUMBERS, *_TEXTS):
        for end, compared in (("from", pc.greater_equal), ("to", pc.less_equal)):
            value = options.get(f"{column}_{end}")
            if value is not None:
                one = compared(pc.field(column), pc.scalar(int(value) if column in _NUMBERS else value))
                said = one if said is None else said & one
    return said


def row_groups(path: str, paths: list[str], where: pc.Expression | None = None) -> list[pads.Fragment]:
    """Of the files the row groups that may hold such rows, by the files' statistics."""
    parts = pads.dataset(paths, filesystem=_opened(path)[0], format="parquet").get_fragments()
    return [x for f in parts for x in f.split_by_row_group(where)]


class MemoryReader(DataSourceReader):
    def __init__(self, path: str, schema: StructType, options: dict[str, str]) -> None:
        self.path, self.kinds, self.options = path, schema, {k.lower(): v for k, v in options.items()}

    def partitions(self) -> list[Files]:
        tasks: list[Files] = []
        held = TASK_BYTES
        for file, size in finished_files(self.path):
            if held + size > TASK_BYTES:
                tasks.append(Files())
                held = 0
            tasks[-1].paths.append(file)
            held += size
        return tasks or [Files()]

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        schema = to_arrow_schema(self.kinds)
        if partition.paths:
            where = bounds(self.options)
            for group in row_groups(self.path, partition.paths, where):
                for batch in group.to_batches(columns=schema.names, filter=where, batch_size=4_096):
                    yield batch.cast(schema)
