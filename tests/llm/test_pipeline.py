import corpus_pipeline as pipeline
from quern.llm.decontaminate import contamination
from quern.llm.exact_dedup import exact_dedup
from quern.llm.language_id import identify, learn, training_rows
from quern.llm.near_dedup import near_duplicate_classes

SF = "/root/testdata/sf0.001"


def test_each_stage_on_its_own_input(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    benchmark = spark.read.parquet(f"{SF}/benchmark.parquet")
    columns = docs.columns
    wanted = {
        "language_id": lambda d: [r.row.doc_id for r in identify(d, learn(training_rows(d))).where("not rejected").collect()],
        "exact_dedup": lambda d: [r.doc_id for r in exact_dedup(d).where("kept").collect()],
        "near_dedup": lambda d: [r.doc_id for r in near_duplicate_classes(d).where("kept").collect()],
        "decontaminate": lambda d: [r.doc_id for r in contamination(d, benchmark).where("not contaminated").collect()],
    }
    assert [n for n, _ in pipeline.STAGES] == [*wanted, "mix_sources"]
    for name, stage in pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == columns
        out.write.parquet(str(tmp_path / name))
        kept = spark.read.parquet(str(tmp_path / name))
        assert sorted(r.doc_id for r in kept.collect()) == sorted(wanted[name](docs)), name
        docs = kept
    last = pipeline.STAGES[-1][1](spark, docs, SF)
    assert {r.doc_id for r in last.collect()} <= {r.doc_id for r in docs.collect()}
    key = lambda rows: sorted((r.doc_id, r["pass"], r.block) for r in rows)
    assert key(pipeline.run(spark, SF).collect()) == key(last.collect())


def test_nulls_repeated_rows_clashing_columns_and_empty_tables(spark, tmp_path):
    schema = "doc_id long, text string, lang string, source string, n_chars long, row string, id long, digest string"
    story = lambda i: " ".join(f"{a}{b}" for a in ("river", "window", "brother", "letter", "stone") for b in (f"ing{i}", f"ed{i * 7}", "s", f"ly{i}", "ness") * 4)
    rows = [(i, story(i), "en", f"s{i % 2}", 1, "r", 1, "d") for i in range(12)]
    rows += [rows[0], rows[0], (None, story(3), "en", None, 1, "r", 1, "d"), (None, story(50), None, None, 1, "r", 1, "d"), (20, None, "en", "s0", 0, None, 1, "d"), (21, "", None, None, 0, "r", 1, "d"), (22, "1 2 3", "en", "s0", 5, "r", 1, "d")]
    folder = tmp_path / "sf"
    spark.read.parquet(f"{SF}/benchmark.parquet").write.parquet(str(folder / "benchmark.parquet"))
    spark.createDataFrame(rows, schema).write.parquet(str(folder / "documents.parquet"))
    found = pipeline.run(spark, str(folder)).collect()
    assert {r.doc_id for r in found} <= {None, *range(12)} and len({r.doc_id for r in found}) >= 8
    empty = tmp_path / "none"
    spark.read.parquet(f"{SF}/benchmark.parquet").write.parquet(str(empty / "benchmark.parquet"))
    spark.createDataFrame([], schema).write.parquet(str(empty / "documents.parquet"))
    assert pipeline.run(spark, str(empty)).collect() == []
