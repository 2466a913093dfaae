import random

import pytest

from quern.operators.chunking import chunk_by_words
from quern.sources.large_text import chunk_files


@pytest.fixture
def small_splits(spark):
    for k, v in (("maxPartitionBytes", "300"), ("openCostInBytes", "1")):
        spark.conf.set(f"spark.sql.files.{k}", v)
    yield
    for k in ("maxPartitionBytes", "openCostInBytes"):
        spark.conf.unset(f"spark.sql.files.{k}")


@pytest.mark.parametrize(("size", "overlap"), [(10, 2), (7, 6), (200, 50), (1, 0), (64, 0)])
def test_chunks_are_those_of_the_whole_text(spark, small_splits, tmp_path, size, overlap):
    r = random.Random(size)
    texts = {f"f{i}": "".join(r.choice(("wort", "é", "x" * 400, "a", " b")) + r.choice((" ", " ", "  ", "\n", "\t", " ")) for _ in range(r.choice((0, 1, 9, 700)))) for i in range(9)}
    texts |= {"blank": " \n ", "none": "", "exact": " ".join(map(str, range(size)))}
    for name, text in texts.items():
        (tmp_path / f"{name}.txt").write_text(text, newline="")
    whole = spark.createDataFrame([(i, *x) for i, x in enumerate(texts.items())], "doc_id long, source string, text string")
    want = sorted((r.source, r.position, r.text, r.word_count) for r in chunk_by_words(whole, size, overlap).collect())
    found = chunk_files(spark, f"file://{tmp_path}/*.txt", size, overlap).collect()
    assert sorted((r.source.rsplit("/", 1)[1][:-4], r.position, r.text, r.word_count) for r in found) == want


def test_a_file_is_read_by_many_tasks(spark, small_splits, tmp_path):
    (tmp_path / "big.txt").write_text(" ".join(f"w{i}" for i in range(5_000)))
    found = chunk_files(spark, f"file://{tmp_path}/big.txt", 100, 10)
    assert found.count() == 56 and spark.read.text(f"file://{tmp_path}/big.txt").rdd.getNumPartitions() > 50
    with pytest.raises(ValueError):
        chunk_files(spark, f"file://{tmp_path}/big.txt", 10, 10)


def test_a_word_goes_to_python_without_its_path(spark, tmp_path):
    (tmp_path / "a.txt").write_text("one two")
    plan = chunk_files(spark, f"file://{tmp_path}/a.txt", 100, 10)._jdf.queryExecution().optimizedPlan().toString().split("\n")
    sent = plan[next(i for i, line in enumerate(plan) if "MapInArrow" in line) + 1]
    assert "value" in sent and "source" not in sent and "words" not in sent
