"""Exact search with both sides distributed: query tiles meet vector tiles in a partitioned block product."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, FloatType, StructField, StructType

from .retrieval import Best, _matrix, _rows, ranked

#: Queries and vectors of a tile.
QUERY_ROWS, VECTOR_ROWS = 16_384, 1_000_000
#: Tiles for each core, at least: hashing puts several into one task now and then.
SPREAD = 3


def grid(n_queries: int, n_vectors: int, cores: int, query_rows: int = QUERY_ROWS, vector_rows: int = VECTOR_ROWS) -> tuple[int, int]:
    """Into how many groups vectors and queries are dealt: tiles of bounded size, at least as many as there are cores. Each query moves once for every group of vectors, each vector once for every group of queries."""
    columns = max(1, -(-n_queries // query_rows))
    return max(1, -(-n_vectors // vector_rows), -(-cores // columns)), columns


def _product(k: int, metric: str, least: float | None, query_rows: int):
    """Of rows (i, j, side, query_id, idx, v) in order of tile and side, the queries (side 0) first: each tile's k best vectors of its queries, ``query_rows`` of which are multiplied at once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, best, ids, queries, kind = None, [], [], [], None
        for batch in batches:
            kind = batch.schema.field("idx").type
            keys = np.stack([batch.column(c).to_numpy() for c in range(3)])
            edges = np.flatnonzero(np.append(True, (np.diff(keys) != 0).any(axis=0)))
            for begin, end in zip(edges, [*edges[1:], batch.num_rows], strict=True):
                part = batch.slice(begin, end - begin)
                tile, side = tuple(keys[:2, begin]), keys[2, begin]
                if tile != at:
                    for b in best:
                        yield from b.result(kind)
                    at, best, ids, queries = tile, [], [], []
                if side == 0:
                    ids.append(part.column(3))
                    queries.append(_matrix(part.column(5)))
                elif ids:
                    if not best:
                        q, names = np.concatenate(queries), pa.concat_arrays(ids)
                        best = [Best(q[x : x + query_rows], names.slice(x, query_rows), k, metric, least) for x in range(0, len(q), query_rows)]
                    m = _rows(part.column(5), metric)
                    for b in best:
                        b.add_matrix(part.column(4), m)
        for b in best:
            yield from b.result(kind)

    return run


def block_product(vectors: DataFrame, queries: DataFrame, tiles: int, k: int, metric: str, least: float | None, query_rows: int = QUERY_ROWS) -> DataFrame:
    """vectors: (i, j, idx, v), queries: (i, j, query_id, v). (query_id, idx, score): the k best of each query in every tile (i, j) that it is in."""
    kinds = queries.schema["query_id"].dataType, vectors.schema["idx"].dataType
    same = all(isinstance(d.schema["v"].dataType, ArrayType) and isinstance(d.schema["v"].dataType.elementType, FloatType) for d in (vectors, queries))
    vector = F.col("v").cast(ArrayType(FloatType() if same else DoubleType()))
    asked = queries.select("i", "j", F.lit(0).alias("side"), "query_id", F.lit(None).cast(kinds[1]).alias("idx"), vector.alias("v"))
    met = vectors.select("i", "j", F.lit(1).alias("side"), F.lit(None).cast(kinds[0]).alias("query_id"), "idx", vector.alias("v"))
    rows = asked.unionByName(met).where("v is not null").repartition(tiles, "i", "j").sortWithinPartitions("i", "j", "side")
    return rows.mapInArrow(_product(k, metric, least, query_rows), StructType([StructField("query_id", kinds[0]), StructField("idx", kinds[1]), StructField("score", DoubleType())]))


def search_tiled(vectors: DataFrame, queries: DataFrame, k: int, metric: str = "cosine", id_col: str = "idx", vector_col: str = "embedding", threshold: float | None = None, query_rows: int = QUERY_ROWS, vector_rows: int = VECTOR_ROWS) -> DataFrame:
    """``retrieval.search`` for any number of queries: one job, in which no query or vector passes the driver.

    Vectors are dealt to rows and queries to columns of a grid by the hash of their ids, so that copies and hot groups
    spread; a task holds one tile's queries and the k best so far of each, and streams the tile's vectors. Fewer
    ``query_rows`` than ``QUERY_ROWS`` bound a product: a tile still has that many queries, so vectors move once for all of these.
    """
    found, wide = vectors.where(F.col(vector_col).isNotNull()), max(k, 0)
    tasks = SPREAD * vectors.sparkSession.sparkContext.defaultParallelism
    rows, columns = grid(queries.count(), found.count(), tasks, max(query_rows, QUERY_ROWS), vector_rows)
    down = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n)).cast("int")
    v = found.select(down(id_col, rows).alias("i"), F.explode(F.sequence(F.lit(0), F.lit(columns - 1))).alias("j"), F.col(id_col).alias("idx"), F.col(vector_col).alias("v"))
    q = queries.select(F.explode(F.sequence(F.lit(0), F.lit(rows - 1))).alias("i"), down("query_id", columns).alias("j"), "query_id", F.col("qvec").alias("v"))
    least = threshold if metric == "cosine" else None
    return ranked(block_product(v if wide else v.limit(0), q, rows * columns, max(wide, 1), metric, least, query_rows), wide, metric)
