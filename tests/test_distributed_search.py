import numpy as np
import pytest
from pyspark.sql import functions as F

from quern.operators import retrieval
from quern.operators.cells import CellIndex
from quern.operators.retrieval import search
from quern.operators.tiles import grid, search_tiled

VEC, QUERY = "idx long, embedding array<float>", "query_id long, qvec array<float>"


def frame(spark, m, schema=VEC):
    return spark.createDataFrame([(i, None if v is None else [float(x) for x in v]) for i, v in enumerate(m)], schema)


def rows(found):
    return sorted((r.query_id, r["rank"], r.idx, round(r.score, 6) + 0.0) for r in found.collect())


@pytest.fixture(scope="module")
def data():
    r = np.random.default_rng(1)
    centres = r.normal(size=(30, 12)) * 10
    m = (centres[r.integers(0, 30, 3000)] + r.normal(size=(3000, 12))).astype(np.float32)
    return [*m, *m[:40], *[m[0]] * 25, np.zeros(12, np.float32), None], [*(centres + 0.1).astype(np.float32), m[0], np.zeros(12, np.float32), m[7], m[7]]


def test_grid():
    assert grid(200_000, 10**7, 8, 16_384, 10**6) == (10, 13) and grid(0, 0, 8) == (8, 1)
    assert grid(1, 10**12, 8)[0] == 10**6


@pytest.mark.parametrize("metric", ["L2", "cosine"])
@pytest.mark.parametrize("k", [0, 1, 7, 5_000])
def test_tiled_is_the_plain_search(spark, data, metric, k):
    v, q = frame(spark, data[0]), frame(spark, data[1], QUERY)
    for tile in ({}, {"query_rows": 5, "vector_rows": 400}):
        assert rows(search_tiled(v, q, k, metric, **tile)) == rows(search(v, q, k, metric))


def test_tiled_threshold_ids_and_empty_sides(spark, data):
    v, q = frame(spark, data[0]).withColumn("idx", F.concat(F.lit("v"), "idx")), frame(spark, data[1], QUERY).withColumn("query_id", F.struct("query_id", F.lit("q").alias("s")))
    got, want = (sorted((str(r.query_id), r["rank"], r.idx, round(r.score, 6)) for r in x.collect()) for x in (search_tiled(v, q, 9, threshold=0.9, query_rows=4), search(v, q, 9, threshold=0.9)))
    assert got == want and got
    assert search_tiled(v.limit(0), q, 3).collect() == [] and search_tiled(v, q.limit(0), 3).collect() == []


def test_many_queries_take_one_job_of_tiles(spark, data, monkeypatch):
    v = frame(spark, data[0])
    q = spark.range(6_000).select(F.col("id").alias("query_id"), F.transform(F.sequence(F.lit(0), F.lit(11)), lambda i: F.cos(F.col("id") * (i + 1)).cast("float")).alias("qvec"))
    found = search(v, q, 2)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(i" in plan and "WindowGroupLimit" in plan and not any(x in plan for x in ("Broadcast", "Cartesian", "NestedLoop"))
    assert plan.count("MapInArrow") == 1 and found.count() == 12_000
    monkeypatch.setattr(retrieval, "QUERY_BLOCK", 10_000)
    assert rows(search(v, q, 2)) == rows(found)


@pytest.mark.parametrize("metric", ["L2", "cosine"])
def test_cells_give_what_a_full_scan_gives_and_read_less(spark, data, metric, tmp_path):
    v, q = frame(spark, data[0]), frame(spark, data[1], QUERY)
    index = CellIndex.build(v, f"file://{tmp_path}/cells", metric, cells=30)
    assert index.vectors().count() == len(data[0]) - 1
    for k in (1, 7, 400, 5_000):
        assert rows(index.search(q, k)) == rows(search(v, q, k, metric))
    few = q.where("query_id in (3, 30)")
    assert rows(CellIndex(spark, f"file://{tmp_path}/cells").search(few, 5)) == rows(search(v, few, 5, metric))
    index.search(few, 5)
    assert 0 < index.read["files_read"] < index.read["files"] / 2 and 0 < index.read["cells_read"] < index.read["cells"] / 2


def test_the_bound_holds_for_any_centres(spark, tmp_path):
    """One cell, more cells than vectors, and vectors without clusters."""
    r = np.random.default_rng(5)
    v, q = frame(spark, r.normal(size=(300, 6))), frame(spark, r.normal(size=(20, 6)), QUERY)
    for cells in (None, 2, 40):
        index = CellIndex.build(v, f"file://{tmp_path}/{cells}", "L2", cells=cells)
        assert rows(index.search(q, 4)) == rows(search(v, q, 4, "L2"))
    empty = CellIndex.build(v.limit(0), f"file://{tmp_path}/empty", "L2")
    assert empty.search(q, 4).collect() == [] and empty.read["files"] == 0


def test_a_hot_cell_is_split(spark, tmp_path, monkeypatch):
    from quern.operators import cells

    monkeypatch.setattr(cells, "TASK_ROWS", 100)
    r = np.random.default_rng(9)
    v, q = frame(spark, [*r.normal(size=(50, 4)), *([r.normal(size=4)] * 900)]), frame(spark, r.normal(size=(5, 4)), QUERY)
    index = CellIndex.build(v, f"file://{tmp_path}/cells", "L2", cells=3)
    assert rows(index.search(q, 6)) == rows(search(v, q, 6, "L2")) and index.read["files"] >= 9


def test_few_scores_over_a_threshold_cost_no_sort():
    """2,000 queries of which none has k results over the threshold."""
    import time

    import pyarrow as pa

    r = np.random.default_rng(3)
    q, v = r.normal(size=(2_000, 16)), r.normal(size=(20_000, 16))
    best, began = retrieval.Best(q, pa.array(range(2_000)), 10, "cosine", 0.8), time.perf_counter()
    for at in range(0, len(v), 10_000):
        best.add(pa.array(range(at, at + 10_000)), pa.FixedSizeListArray.from_arrays(pa.array(v[at : at + 10_000].ravel()), 16))
    found = {(x, y) for b in best.result(pa.int64()) for x, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)}
    assert time.perf_counter() - began < 6
    u, w = (m / np.linalg.norm(m, axis=1, keepdims=True) for m in (q, v))
    s = u @ w.T
    at = np.argsort(-s, axis=1)[:, :10]
    assert found == {(i, int(j)) for i in range(2_000) for j in at[i] if s[i, j] >= 0.8} and found


def test_small_tiles_of_queries_do_not_multiply_the_vectors(spark, data, monkeypatch):
    from quern.operators import tiles

    moved, product = [], tiles.block_product
    monkeypatch.setattr(tiles, "block_product", lambda v, *a, **k: moved.append(v.count()) or product(v, *a, **k))
    v, q = frame(spark, data[0]), frame(spark, data[1], QUERY)
    assert rows(search_tiled(v, q, 3, "L2", query_rows=4)) == rows(search(v, q, 3, "L2")) and moved == [len(data[0]) - 1]
