import json

import pytest
from pyspark.sql import functions as F

from quern import cli, storage
from quern.log import operation
from quern.operators.assembly import assemble_prompts, citations, conversational_prompts, truncate_to_fit
from quern.operators.embedding import HashEmbedder
from quern.operators.evaluation import Report, accuracy, compare_grounding, grounding, hit_rate, latency
from quern.operators.inference import Inference, error_class, judged, read_verdict, with_retry
from quern.operators.memory import Memory
from quern.operators.recall import direct_recall, recall_demo
from quern.operators.retrieval import retrieve
from quern.sources.config import Config, load_config
from quern.sources.files import extension, file_type, pdf_files, text_files
from quern.sources.synthetic import fact_document, facts, questions
from quern.streaming.ingest import chunk_stream, ingest, only_new, read_documents
from quern.system import MemorySystem

RESULT = "query_id long, rank int, score double, source string, extension string, text string"


def packed(rows, most):
    out, n = [], 0
    for r in sorted(rows, key=lambda r: -r[2]):
        if n + len(r[5]) > most:
            if n == 0:
                out.append(r[5][:most])
            break
        out.append(r[5])
        n += len(r[5])
    return out


@pytest.mark.parametrize("texts", [["a" * 37, "b" * 47], ["x" * 60, "y"], ["", "", "z" * 99, "w"], ["p" * 50, "q", ""], []])
def test_packing(spark, texts):
    rows = [(1, i, 1.0 - i / 10, None, None, t) for i, t in enumerate(texts)]
    got = truncate_to_fit(spark.createDataFrame(rows, RESULT), 50).orderBy("packed").collect()
    assert [r.text for r in got] == packed(rows, 50)


def test_prompts(spark):
    rows = [(1, 0, 0.95, None, None, "Paris {query} $1 \\ is"), (1, 1, 0.85, "b.md", "md", "Second")]
    queries = spark.createDataFrame([(1, "Where?"), (2, "Nothing?")], "query_id long, text string")
    found = {r.query_id: r.prompt for r in assemble_prompts(queries, spark.createDataFrame(rows, RESULT), max_length=1_000).collect()}
    assert "[Source: Document 1 (.txt) - Score: 0.950]\nParis {query} $1 \\ is\n\n[Source: b.md (.md) - Score: 0.850]\nSecond" in found[1]
    assert "QUESTION:\nWhere?" in found[1] and "CONTEXT:\n\n\nQUESTION:\nNothing?" in found[2]
    again = assemble_prompts(queries, spark.createDataFrame(rows, RESULT), "no such template", 1_000).where("query_id = 1").first().prompt
    assert again == found[1]
    turns = spark.createDataFrame([(1, 0, "user", "Hi"), (1, 1, "assistant", "Hello!"), (1, 2, None, "x")], "conv_id long, turn int, role string, text string")
    prompts = spark.createDataFrame([(1, "P"), (2, "Q")], "conv_id long, prompt string")
    told = {r.conv_id: r.prompt for r in conversational_prompts(prompts, turns).collect()}
    assert told == {1: "CONVERSATION HISTORY:\nUSER: Hi\nASSISTANT: Hello!\nUSER: x\n\nCURRENT TASK:\nP", 2: "Q"}
    assert citations(spark.createDataFrame(rows, RESULT)).first().citations == ["[1] Chunk 1", "[2] b.md"]


def test_inference(spark):
    asked = spark.sparkContext.accumulator(0)

    def client(prompt, max_tokens, temperature):
        asked.add(1)
        return f"re: {prompt}", 5, 1

    llm = Inference("Mock", "m", client=client)
    df = spark.createDataFrame([(1, "a"), (2, "a"), (3, "b")], "i int, prompt string")
    rows = {r.i: r for r in llm.generate(df).collect()}
    assert rows[2].response == "re: a" and rows[1].tokens_used.total == 6 and rows[3].provider == "mock" and asked.value == 2
    with pytest.raises(ValueError):
        Inference("unknown")
    tries, waits = [], []

    def fails():
        tries.append(1)
        if len(tries) < 3:
            raise OSError("timeout")
        return {"ok": 1}

    assert with_retry(fails, 3, 1.0, waits.append) == {"ok": 1} and waits == [1.0, 2.0]
    with pytest.raises(RuntimeError, match="Failed after 0 attempts: None"):
        with_retry(fails, 0)
    with pytest.raises(RuntimeError, match="Failed after 1 attempts: x"):
        with_retry(lambda: (_ for _ in ()).throw(OSError("x")), 1)


def test_error_classes_and_judge(spark):
    rows = spark.createDataFrame([("HTTP 429", 2), ("Rate Limit", 0), ("Timeout!", 3), ("bad key", 1)], "m string, n int").select(error_class(F.col("m"), F.col("n")).alias("e")).collect()
    assert [(r.e.should_retry, r.e.wait_time) for r in rows] == [(True, 6), (True, 2), (True, 1), (False, 0)]
    texts = ['```json\n{"score": 0.5, "reason": "r"}\n```', '{"reason": "r"}', "no", "", None, '{"score": 1']
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").orderBy("i").select(judged(F.col("t")).alias("j")).collect()
    assert [r.j.score for r in rows] == [0.5, 0.0, 0.0, 0.0, 0.0, 0.0]
    assert rows[0].j.reason == "r" and rows[2].j.reason == "Error calculating score: Expecting value: line 1 column 1 (char 0)"


@pytest.mark.parametrize(
    ("answer", "want"),
    [('{"score": "0.8"}', (0.8, "")), ('{"score": 1.0} trailing words', (0.0, "Error calculating score: Extra data: line 1 column 16 (char 15)")), ('```json\n{"score": 1, "reason": null}```', (1.0, None)), ("[1]", (0.0, "Error calculating score: 'list' object has no attribute 'get'"))],
)
def test_verdicts(answer, want):
    assert read_verdict(answer) == want


def test_a_provider_that_counts_its_tokens():
    assert Inference("p", client=lambda p, m, t: ("x", 2, 3, 9)).generate_one("q")["tokens_used"] == {"prompt": 2, "completion": 3, "total": 9}
    assert Inference("p", client=lambda p, m, t: ("x", 2, 3)).generate_one("q")["tokens_used"]["total"] == 5


def test_evaluation(spark, tmp_path):
    queries = spark.createDataFrame([(1,), (2,), (3,)], "query_id long")
    results = spark.createDataFrame([(1, "a"), (1, "b"), (2, "c")], "query_id long, source string")
    truth = spark.createDataFrame([(1, "b"), (2, "x")], "query_id long, expected string")
    assert hit_rate(queries, results, truth).first().hit_rate == pytest.approx(1 / 3)
    assert hit_rate(queries.limit(0), results, truth).first().hit_rate == 0.0
    got = accuracy(spark.createDataFrame([("It is AZURE.", "Azure"), (None, "x"), ("no", "yes")], "response string, expected string")).first()
    assert (got.correct, got.total) == (1, 3)
    judge = Inference("judge", client=lambda p, m, t: ('{"score": 1.0, "reason": "ok"}' if "ANSWER: good" in p else '{"score": 0.25, "reason": "no"}', 1, 1))
    rows = spark.createDataFrame([("q1", "c", "good"), ("q2", "", "good")], "question string, context string, answer string")
    assert {r.question: (r.score, r.reason) for r in grounding(rows, judge).collect()} == {"q1": (1.0, "ok"), "q2": (0.0, "")}
    assert {r.question: r.improvement for r in compare_grounding(rows, judge).collect()} == {"q1": 0.75, "q2": 0.0}
    same = spark.createDataFrame([("q", "c", "good"), ("q", "c", "bad"), ("q", "d", "bad")], "question string, context string, answer string")
    assert sorted((r.context, r.answer, r.improvement) for r in compare_grounding(same, judge).collect()) == [("c", "bad", 0.0), ("c", "good", 0.75), ("d", "bad", 0.0)]
    assert set(latency(lambda: None, lambda: {"latency_ms": 3}, 2)) == {"avg_retrieval_ms", "avg_llm_ms", "total_latency_ms"}
    report = Report()
    report.results["efficiency"] = {"avg_llm_ms": 3}
    report.write(str(tmp_path / "r.json"))
    assert json.loads((tmp_path / "r.json").read_text())["efficiency"] == {"avg_llm_ms": 3}


def test_sources(spark, tmp_path):
    names = ["a.md", "b.tsx", "c.PDF", "noext", ".env", "x.tar.gz", "d.unknown", "e.py"]
    rows = spark.createDataFrame([(n,) for n in names], "n string").select("n", extension(F.col("n")).alias("e"), file_type(extension(F.col("n"))).alias("t")).collect()
    assert {r.n: (r.e, r.t) for r in rows} == {"a.md": ("md", "markdown"), "b.tsx": ("tsx", "react-typescript"), "c.PDF": ("PDF", "text"), "noext": ("txt", "text"), ".env": ("txt", "text"), "x.tar.gz": ("gz", "text"), "d.unknown": ("unknown", "text"), "e.py": ("py", "python")}
    (tmp_path / "my note+1.md").write_text("line one\nline two\n")
    doc = text_files(spark, f"file://{tmp_path}/*.md").first()
    assert (doc.text, doc.source, doc.file_type, doc.extension) == ("line one\nline two\n", "my note+1.md", "markdown", "md")
    with pytest.raises(RuntimeError, match="pypdf"):
        pdf_files(spark, "x.pdf")
    text = fact_document(facts(spark, 10)).first().text
    assert len(text.split()) == 1_070 and "filler The secret color of Snark is Magenta. filler" in text
    assert [r.expected for r in questions(facts(spark, 11)).orderBy("pos").collect()][10] == "Crimson"
    (tmp_path / "c.yaml").write_text("chunking:\n  chunk_size: 200\nllm:\n  provider: Gemini\n  max_tokens: 5\n  gemini:\n    model: g\n")
    config = load_config(tmp_path / "c.yaml")
    assert (config.chunk_size, config.overlap, config.provider, config.provider_settings, config.max_tokens) == (200, 50, "gemini", {"model": "g"}, 5)
    assert operation("x", a=1, b=2) == "Operation: x | a=1 | b=2"


def test_facade_and_command_line(spark, tmp_path):
    config = Config(chunk_size=10, overlap=2, dimension=64, top_k=2, similarity_threshold=0.0, index_path=str(tmp_path / "index"))
    system = MemorySystem(spark, config, HashEmbedder(64))
    assert system.ingest_document("  ")["message"] == "No text content found to ingest"
    assert system.ingest_document("Machine learning learns from data. Paris is in France.", "test_doc")["chunks_created"] == 1
    (tmp_path / "fox.txt").write_text("the quick brown fox jumps")
    said = []
    assert cli.main(["ingest", str(tmp_path / "fox.txt"), "--source", "tale"], system, said.append) == 0
    result = system.query("the quick fox", return_context=True)
    assert result["sources"][0]["metadata"]["source"] == "tale" and "quick brown" in result["answer"] and "QUESTION:\nthe quick fox" in result["full_prompt"]
    cli.main(["query", "machine learning", "--k", "1", "--verbose"], system, said.append)
    cli.main(["stats"], system, said.append)
    answers = iter(["machine", "QUIT"])
    cli.main(["interactive"], system, said.append, lambda _: next(answers))
    assert "Created 1 chunks" in said[0] and any("Source: test_doc (.txt)" in s for s in said) and any("total_chunks: 2" in s for s in said)
    cli.main(["save", str(tmp_path / "copy")], system, said.append)
    again = MemorySystem(spark, config, HashEmbedder(64))
    assert again.statistics()["total_chunks"] == 2
    again.clear()
    assert again.statistics()["total_chunks"] == 0
    cli.main(["load", str(tmp_path / "copy")], again, said.append)
    assert again.statistics() == system.statistics()
    many = again.ask(spark.createDataFrame([(1, "fox"), (2, "Paris")], "query_id long, text string")).collect()
    assert {r.query_id for r in many} == {1, 2}


def test_streaming_ingest_is_incremental(spark, tmp_path):
    schema = "doc_id long, text string"
    write = lambda rows: spark.createDataFrame(rows, schema).write.mode("append").parquet(f"file://{tmp_path}/in")
    run = lambda: ingest(chunk_stream(read_documents(spark, f"file://{tmp_path}/in", schema), 3, 1, HashEmbedder(8)), f"file://{tmp_path}/out", f"file://{tmp_path}/log").awaitTermination()
    write([(1, "a b c d e")])
    run()
    write([(2, "x y")])
    run()
    run()
    out = spark.read.parquet(f"file://{tmp_path}/out")
    assert sorted((r.doc_id, r.position, r.text) for r in out.collect()) == [(1, 0, "a b c"), (1, 1, "c d e"), (2, 0, "x y")]
    assert only_new(out, out.where("doc_id = 1")).count() == 1


def test_memory_versions_and_appends_at_the_same_time(spark, tmp_path):
    path = f"file://{tmp_path}/m"
    chunk = lambda i: spark.createDataFrame([(i, 0, f"text {i}", [float(i), 1.0])], "doc_id long, position int, text string, embedding array<float>")
    Memory(spark, 2).add(chunk(0)).save(path)
    log = f"{path}/log-{json.loads(storage.read_text(spark, f'{path}/config.json'))['version']}"
    assert storage.create_text(spark, f"{log}/000000000", "") and not storage.create_text(spark, f"{log}/000000000", "x")  # a writer that never finished
    a = Memory.load(spark, path)
    assert a.table.count() == 1
    Memory.load(spark, path).append(path, chunk(1))
    grown = a.append(path, chunk(2))
    assert [r.text for r in grown.indexed.orderBy("idx").collect()] == ["text 0", "text 1", "text 2"]
    grown.add(chunk(3)).save(path)
    assert Memory.load(spark, path).table.count() == 4
    assert not list(tmp_path.glob("m/.config*")) or all(p.name.endswith(".crc") for p in tmp_path.glob("m/.config*"))


def test_rows_without_ids_are_retrieved_once(spark):
    rows = [(None, None, "one", [1.0, 0.0]), (None, None, "two", [0.9, 0.1]), (None, None, "two", [0.9, 0.1])]
    memory = Memory(spark, 2, "cosine").add(spark.createDataFrame(rows, "doc_id long, position int, text string, embedding array<float>"))
    found = retrieve(memory.indexed, spark.createDataFrame([("q", [1.0, 0.0])], "query_id string, qvec array<float>"), 3, 0.0, payload=["text"])
    assert sorted((r.query_id, r["rank"], r.text) for r in found.collect()) == [("q", 0, "one"), ("q", 1, "two"), ("q", 2, "two")]


def test_recall_of_facts(spark):
    rows = {r.flow: (r.accuracy, r.correct, r.total, r.improvement) for r in recall_demo(spark, HashEmbedder(64), Inference()).collect()}
    assert rows["direct"] == (0.0, 0, 10, 0.0) and rows["retrieval"][2] == 10 and rows["retrieval"][3] == rows["retrieval"][0]
    knows = Inference("k", client=lambda p, m, t: ("It is " + ("Crimson" if "Xylon?" in p else "unknown"), 1, 1))
    assert direct_recall(fact_document(facts(spark, 10)), questions(facts(spark, 10)), knows).first().accuracy == 0.1


def test_facade_merges_deduplicates_and_explains(spark, tmp_path):
    config = Config(chunk_size=10, overlap=2, dimension=64, top_k=2, index_path=str(tmp_path / "index"))
    system = MemorySystem(spark, config, HashEmbedder(64), auto_save=False)
    for text in ("Paris is in France.", "The fox jumps over dogs.", "Paris is in France!"):
        system.ingest_document(text)
    merged = system.retrieve_multi_query(spark.createDataFrame([(1, 0, "Paris is in"), (1, 1, "fox jumps")], "group_id long, qpos long, text string"), 3).orderBy("merged_rank").collect()
    assert len({r.text for r in merged}) == 3 and [r.merged_rank for r in merged] == [0, 1, 2]
    asked = spark.createDataFrame([(1, "Paris is in France.")], "query_id long, text string")
    assert system.retrieve(asked, 3, 0.5).count() == 2 and system.deduplicate(system.retrieve(asked, 3, 0.5)).count() == 1
    told = system.explain(asked, 2).first()
    assert told.embedding_norm == pytest.approx(1.0) and [x["rank"] for x in told.retrieved] == [0, 1]
