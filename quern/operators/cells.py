"""Exact search that skips data: vectors lie in k-means cells, and a cell is read only where it may hold one of the k best.

A cell has a centre and a radius, the largest distance of its vectors from the centre; none of its vectors is nearer
to a query than the centre's distance less the radius. A query first reads the nearest cells that hold k vectors
together; its k-th distance there then tells which other cells could hold a nearer one. Cosine is searched as the distance
between unit vectors, which orders alike. Centres are fitted on a bounded sample, but every vector lies in a cell and
the bound holds for any centres, so that results are those of a full scan.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DoubleType, IntegerType, StructField, StructType

from ..functions.vectors import normalize
from ..storage import durable, read_text, replace_text
from .retrieval import _matrix, ranked
from .tiles import block_product

#: Vectors that fit the centres; of a cell at best; of a task; the most cells, whose centres are broadcast.
SAMPLE, CELL_ROWS, TASK_ROWS, MOST_CELLS = 100_000, 20_000, 1_000_000, 4_096
#: What rounding may add to a distance.
SLACK = 1e-6


def _point(vector: Column, metric: str, *zero: float) -> Column:
    """A vector as it is searched. Of cosine a unit vector and two places more, in which a zero vector and a zero query stand at right angles to everything: their cosine is 0."""
    v = vector.cast("array<double>")
    if metric != "cosine":
        return v
    none = F.forall(v, lambda x: x == 0)
    return F.concat(normalize(v), F.when(none, F.array(*map(F.lit, zero))).otherwise(F.array(F.lit(0.0), F.lit(0.0))))


class CellIndex:
    """Vectors (idx, embedding) in cells below a path. ``read`` tells of the last search how many files and cells it read, of how many."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")
        said = json.loads(read_text(spark, f"{self.path}/cells.json"))
        self.metric, self.kind = said["metric"], said["idx"]
        cells = spark.read.parquet(f"{self.path}/centres").orderBy("cell").toPandas()
        self.cells, self.radii, self.sizes, self.files = (cells[c].to_numpy() for c in ("cell", "radius", "rows", "files"))
        self.centres = np.array(cells.centre.to_list(), dtype=np.float64) if len(cells) else np.empty((0, 0))
        self.read: dict[str, int] = {}

    @staticmethod
    def build(vectors: DataFrame, path: str, metric: str = "cosine", id_col: str = "idx", vector_col: str = "embedding", cells: int | None = None, seed: int = 7) -> CellIndex:
        """Fits the centres and writes the vectors by cell; a cell of many rows takes many files."""
        spark = vectors.sparkSession
        rows = vectors.where(F.col(vector_col).isNotNull()).select(F.col(id_col).alias("idx"), _point(F.col(vector_col), metric, 1.0, 0.0).alias("embedding"))
        n = rows.count()
        k = min(cells or -(-n // CELL_ROWS), MOST_CELLS)
        sample = rows.withColumn("h", F.xxhash64("embedding")).orderBy("h").limit(SAMPLE) if n > SAMPLE else rows
        centres = KMeans(k=k, seed=seed, maxIter=10, initSteps=2).fit(durable(sample.select(array_to_vector("embedding").alias("features")))).clusterCenters() if k > 1 else [np.zeros(len(r.embedding)) for r in rows.limit(1).collect()]
        held = spark.sparkContext.broadcast(np.array(centres))  # MOST_CELLS rows at most

        def nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            c = held.value
            for b in batches:
                for at in range(0, b.num_rows, 4096):
                    part = b.slice(at, 4096)
                    d = _distances(_matrix(part.column(1)), c)
                    best = d.argmin(axis=1)
                    yield pa.RecordBatch.from_arrays([*part.columns, pa.array(best, pa.int32()), pa.array(d[np.arange(len(best)), best])], names=["idx", "embedding", "cell", "distance"])

        placed = rows.mapInArrow(nearest, StructType([*rows.schema.fields, StructField("cell", IntegerType()), StructField("distance", DoubleType())]))
        placed.hint("rebalance", "cell").write.partitionBy("cell").option("maxRecordsPerFile", TASK_ROWS).parquet(f"{path}/vectors")
        if n:
            stored = spark.read.parquet(f"{path}/vectors").groupBy("cell").agg(F.max("distance").alias("radius"), F.count("*").alias("rows"), F.count_distinct(F.col("_metadata.file_path")).alias("files"))
        else:
            stored = spark.createDataFrame([], "cell int, radius double, rows long, files long")
        table = spark.createDataFrame([(i, [float(x) for x in c]) for i, c in enumerate(centres)], "cell int, centre array<double>")
        stored.join(table, "cell").coalesce(1).write.parquet(f"{path}/centres")  # MOST_CELLS rows at most
        replace_text(spark, f"{path}/cells.json", json.dumps({"metric": metric, "idx": rows.schema["idx"].dataType.simpleString()}))
        return CellIndex(spark, path)

    def vectors(self, cells: list[int] | None = None) -> DataFrame:
        schema = f"idx {self.kind}, embedding array<double>, distance double, cell int"
        rows = self.spark.read.schema(schema).parquet(f"{self.path}/vectors")
        return rows if cells is None else rows.where(F.col("cell").isin(cells))

    def search(self, queries: DataFrame, k: int) -> DataFrame:
        """(query_id, rank, idx, score) of the k best vectors of every query (query_id, qvec), as ``retrieval.search`` without a threshold; computed."""
        asked = queries.where("qvec is not null").select("query_id", _point(F.col("qvec"), self.metric, 0.0, 1.0).alias("v"))
        bounds = durable(self._bounds(asked, k))
        first = durable(self._met(asked, bounds.where("first"), k))
        kth = F.when(F.count("*") >= k, F.max(F.sqrt("score")))
        edge = ranked(first, k, "L2").groupBy("query_id").agg(kth.alias("kth"))
        more = bounds.where("not first").join(edge, "query_id", "left").where(F.col("kth").isNull() | (F.col("least") <= F.col("kth") + SLACK))
        more = durable(more.select("query_id", "cell"))
        both = first.unionByName(self._met(asked, more, k))
        cells = [r.cell for r in bounds.where("first").select("cell").union(more.select("cell")).distinct().collect()]  # MOST_CELLS at most
        self.read = {"cells_read": len(cells), "cells": len(self.cells), "files_read": int(self.files[np.isin(self.cells, cells)].sum()), "files": int(self.files.sum())}
        score = F.col("score") if self.metric == "L2" else 1 - F.col("score") / 2
        return durable(ranked(both.select("query_id", "idx", score.alias("score")), k, self.metric))

    def _bounds(self, asked: DataFrame, k: int) -> DataFrame:
        """(query_id, cell, least, first): the least distance of a cell's vectors, and whether it is among the nearest that hold k together."""
        held = self.spark.sparkContext.broadcast((self.cells, self.centres, self.radii, self.sizes))

        def bound(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            cells, centres, radii, sizes = held.value
            for b in batches:
                for at in range(0, b.num_rows if len(cells) else 0, 1024):
                    part = b.slice(at, 1024)
                    d = _distances(_matrix(part.column(1)), centres)
                    order = d.argsort(axis=1)
                    before = np.cumsum(sizes[order], axis=1) - sizes[order]
                    first = np.empty(d.shape, dtype=bool)
                    np.put_along_axis(first, order, before < k, axis=1)
                    who = np.repeat(np.arange(len(d)), len(cells))
                    yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(who)), pa.array(np.tile(cells, len(d)), pa.int32()), pa.array(np.maximum(d - radii, 0).ravel()), pa.array(first.ravel())], names=["query_id", "cell", "least", "first"])

        return asked.mapInArrow(bound, StructType([asked.schema["query_id"], StructField("cell", IntegerType()), StructField("least", DoubleType()), StructField("first", BooleanType())]))

    def _met(self, asked: DataFrame, pairs: DataFrame, k: int) -> DataFrame:
        """(query_id, idx, score): the k best, by squared distance, of each query in each of its cells; only these cells' files are read."""
        cells = [r.cell for r in pairs.select("cell").distinct().collect()]  # MOST_CELLS at most
        sizes = dict(zip(self.cells.tolist(), self.sizes.tolist(), strict=True))
        parts = [(c, -(-sizes[c] // TASK_ROWS)) for c in cells]
        split = F.broadcast(self.spark.createDataFrame(parts, "i int, parts int"))
        v = self.vectors(cells).withColumnRenamed("cell", "i").join(split, "i").select("i", F.pmod(F.xxhash64("idx"), "parts").cast("int").alias("j"), "idx", F.col("embedding").alias("v"))
        q = asked.join(pairs, "query_id").withColumnRenamed("cell", "i").join(split, "i").select("i", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("j"), "query_id", "v")
        return block_product(v, q, max(1, sum(n for _, n in parts)), k, "L2", None)


def _distances(rows: np.ndarray, centres: np.ndarray) -> np.ndarray:
    square = (rows * rows).sum(1)[:, None] + (centres * centres).sum(1)[None, :] - 2 * rows @ centres.T
    return np.sqrt(np.maximum(square, 0.0))
