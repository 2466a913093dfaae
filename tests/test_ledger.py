from collections import Counter

import pytest
from pyspark.errors import PySparkException

from quern.operators.inference import Inference, error_class, wait_for
from quern.operators.ledger import AnswerLedger


def client(log, refuses=lambda p: False, stops=lambda p: False):
    def call(prompt, max_tokens, temperature):
        if stops(prompt):
            raise SystemExit("stopped")
        with open(log, "a") as f:
            f.write(prompt + "\n")
        if refuses(prompt):
            raise ValueError(f"no answer to {prompt}")
        return f"re: {prompt}", 1, 1

    return call


def asked(log):
    return Counter(log.read_text().split("\n")[:-1]) if log.exists() else Counter()


@pytest.fixture
def prompts(spark):
    return spark.createDataFrame([(i, f"p{i % 100}") for i in range(120)] + [(120, None), (121, "")], "i long, prompt string")


refuses = lambda p: p != "" and int(p[1:]) % 7 == 0  # noqa: E731  by value, since workers don't import the tests


def test_failures_are_rows_and_nothing_is_asked_twice(spark, tmp_path, prompts):
    log, ledger = tmp_path / "log", AnswerLedger(spark, f"file://{tmp_path}/ledger", buckets=4)
    for _ in range(2):
        rows = {r.i: r for r in ledger.generate(Inference("x", client=client(log, refuses)), prompts, batch=5).collect()}
        assert len(rows) == 122 and rows[120].response is None and rows[120].error is None and rows[121].response == "re: "
        for i in range(120):
            p = f"p{i % 100}"
            assert (rows[i].response, rows[i].error) == ((None, f"no answer to {p}") if refuses(p) else (f"re: {p}", None))
        assert set(asked(log).values()) == {1} and len(asked(log)) == 101
    ledger.generate(Inference("x", client=client(log)), prompts, retry_failed=True)
    again = asked(log)
    assert {p for p, n in again.items() if n == 2} == {p for p in again if refuses(p)}
    assert ledger.answers().where("error is not null").isEmpty() and ledger.rows().count() == 101 + 15
    ledger.generate(Inference("x", client=client(log)), prompts, temperature=0.1)
    assert sum(asked(log).values()) == sum(again.values()) + 101  # other settings, other keys


def test_a_stopped_job_goes_on(spark, tmp_path, prompts):
    log, ledger = tmp_path / "log", AnswerLedger(spark, f"file://{tmp_path}/ledger", buckets=4)
    with pytest.raises(PySparkException):
        ledger.generate(Inference("x", client=client(log, stops=lambda p: p == "p77")), prompts, batch=1)
    first = asked(log)
    assert 0 < len(first) < 101 and ledger.rows().count() == len(first)
    rows = ledger.generate(Inference("x", client=client(log)), prompts, batch=1).collect()
    assert set(asked(log).values()) == {1} and len(asked(log)) == 101 and sum(r.response is not None for r in rows) == 121


def test_a_task_tried_again_finds_its_batches(spark, tmp_path):
    import pyarrow as pa

    from quern.operators.ledger import _ask

    log = tmp_path / "log"
    for n in (0, 1):
        (tmp_path / "run" / str(n)).mkdir(parents=True)
    batch = pa.RecordBatch.from_pydict({"_bucket": [0, 0, 0, 1], "_key": list("abcd"), "_prompt": list("abcd")})
    run = lambda stops: list(_ask(Inference("x", client=client(log, stops=stops)), f"file://{tmp_path}/run", "run", 10, 0.0, 1, 0.0, 1, lambda s: None)(iter([batch])))
    with pytest.raises(SystemExit):
        run(lambda p: p == "c")
    assert run(lambda p: False)[0].to_pylist() == [{"asked": 2}]
    assert asked(log) == Counter("abcd")


def test_waits_follow_the_class_of_the_error(spark):
    texts = ["HTTP 429: slow down", "Rate limit reached", "read Timeout", "Connection reset", "bad key", ""]
    rows = spark.createDataFrame([(t, n) for t in texts for n in (0, 2)], "t string, n int")
    for r in rows.select("t", "n", error_class(rows.t, rows.n).alias("e")).collect():
        assert (wait_for(r.t, r.n) or 0, wait_for(r.t, r.n) is not None) == (r.e.wait_time, r.e.should_retry)
    for text, waited in (("429", [1.0, 2.0]), ("timeout", [0.5, 0.5]), ("other", [0.5, 1.0])):
        waits = []

        def fails(prompt, max_tokens, temperature, text=text):
            raise OSError(text)

        out = Inference("x", client=fails).try_one("p", 1, 0.0, None, 3, 0.5, waits.append)
        assert waits == waited and out["error"] == text and out["response"] is None


def test_one_failing_prompt_leaves_the_others(spark, prompts, tmp_path):
    rows = Inference("x", client=client(tmp_path / "log", refuses)).generate(prompts.where("i < 20")).collect()
    assert len(rows) == 20 and {r.i for r in rows if r.error} == {0, 7, 14} and all(r.response for r in rows if not r.error)


def test_empty(spark, tmp_path):
    ledger = AnswerLedger(spark, f"file://{tmp_path}/ledger")
    assert ledger.generate(Inference(), spark.createDataFrame([], "prompt string")).collect() == [] and ledger.answers().isEmpty()


def test_what_a_task_writes_after_its_job_has_failed_does_not_count(spark, tmp_path, prompts):
    """A slow task of a stopped job is still at its prompts when the next job has begun."""
    import time

    log, ledger = tmp_path / "log", AnswerLedger(spark, f"file://{tmp_path}/ledger", buckets=4)

    def slow(prompt, max_tokens, temperature):
        if prompt == "p77":
            raise SystemExit("stopped")
        time.sleep(0.05)
        return f"re: {prompt}", 1, 1

    for _ in range(2):
        with pytest.raises(PySparkException):
            ledger.generate(Inference("x", client=slow), prompts, batch=2)
    ledger.generate(Inference("x", client=client(log)), prompts)
    time.sleep(1)
    assert ledger.rows().count() == ledger.answers().count() == 101


def test_buckets_grow_with_the_prompts(spark, tmp_path, prompts, monkeypatch):
    monkeypatch.setattr("quern.operators.ledger.BUCKET_CHARS", 20, raising=False)
    ledger = AnswerLedger(spark, f"file://{tmp_path}/ledger", buckets=2)
    assert ledger.generate(Inference("x", client=client(tmp_path / "log")), prompts, batch=5).where("response is not null").count() == 121
    folders = list((tmp_path / "ledger").glob("*run-*/*"))
    assert len(folders) == 17 and len([f for f in folders if list(f.glob("*.parquet"))]) > 12  # 340 characters
    assert set(asked(tmp_path / "log").values()) == {1}
