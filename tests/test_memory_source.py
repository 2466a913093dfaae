import pytest

from quern.operators.memory import Memory
from quern.sources.memory_source import MemoryReader, bounds, finished_files, register, row_groups

SCHEMA = "doc_id long, position int, text string, embedding array<float>"


@pytest.fixture
def path(spark, tmp_path):
    """Five appends of 20 documents each."""
    folder = f"file://{tmp_path}/m"
    Memory(spark, 2, "L2").save(folder)
    for i in range(5):
        rows = [(d, 0, f"text {d}", [1.0, float(d)]) for d in range(20 * i, 20 * i + 20)]
        Memory.load(spark, folder).append(folder, spark.createDataFrame(rows, SCHEMA).coalesce(1))
    register(spark)
    return folder


def test_equal_to_a_load(spark, path):
    cast = lambda df: sorted((r.batch_id, r.doc_id, r.position, r.text, list(r.embedding), r.extra) for r in df.collect())
    found = spark.read.format("quern_memory").load(path)
    assert found.schema == Memory.load(spark, path).table.schema
    assert cast(found) == cast(Memory.load(spark, path).table)


def test_from_sql_with_filters(spark, path):
    spark.sql(f"create or replace temporary view chunks using quern_memory options (path '{path}')")
    assert [r.doc_id for r in spark.sql("select doc_id from chunks where doc_id > 37 and doc_id <= 41 order by doc_id").collect()] == [38, 39, 40, 41]
    assert [r.n for r in spark.sql("select count(*) as n from chunks where doc_id in (3, 99, 1000) or text = 'text 50'").collect()] == [3]
    assert spark.sql("select * from chunks where source = 'none'").count() == 0


def test_row_groups_are_skipped_by_statistics(spark, path):
    from pyspark.sql.types import StructType

    said = {"doc_id_from": "65", "doc_id_to": "75"}
    files = [f for f, _ in finished_files(path)]
    assert len(row_groups(path, files, bounds(said))) == 1 < len(row_groups(path, files))
    reader = MemoryReader(path, StructType.fromDDL("doc_id long"), said)
    assert sorted(x for p in reader.partitions() for b in reader.read(p) for x in b.column(0).to_pylist()) == list(range(65, 76))
    found = spark.read.format("quern_memory").options(**said).load(path).where("doc_id % 2 = 0")
    assert sorted(r.doc_id for r in found.collect()) == [66, 68, 70, 72, 74]
    one = spark.read.format("quern_memory").option("batch_id_to", "000000001").option("source_from", "").load(path)
    assert one.count() == 0  # sources are null here


def test_open_appends_and_compacted_folders(spark, path):
    from quern.operators.memory import _config, _state
    from quern.storage import create_text

    state = _state(spark, path, _config(spark, path))
    create_text(spark, f"{state.log}/{state.next:09d}", "")  # claimed and never finished
    before = spark.read.format("quern_memory").load(path).count()
    assert Memory.compact(spark, path) > 1
    assert spark.read.format("quern_memory").load(path).count() == before == 100
