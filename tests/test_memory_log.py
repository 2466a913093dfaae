import threading

import pytest

from quern.operators import memory as module
from quern.operators.embedding import HashEmbedder
from quern.operators.memory import Memory, _config, _state
from quern.storage import create_text
from quern.streaming.ingest import ingest_into


@pytest.fixture
def path(spark, tmp_path):
    Memory(spark, 2, "L2").save(f"file://{tmp_path}/m")
    return f"file://{tmp_path}/m"


def chunks(spark, *texts):
    return spark.createDataFrame([(i, 0, t, [1.0, float(i)]) for i, t in enumerate(texts)], "doc_id long, position int, text string, embedding array<float>")


def texts(memory):
    return sorted(r.text for r in memory.table.select("text").collect())


def state(spark, path):
    return _state(spark, path, _config(spark, path))


def test_a_load_reads_a_snapshot_and_the_entries_since(spark, path, monkeypatch):
    log = state(spark, path).log
    Memory.load(spark, path).append(path, chunks(spark, "a"))
    folder = state(spark, path).folders[-1]
    for n in range(1, 1000):  # entries as appends leave them, without their rows
        create_text(spark, f"{log}/{n:09d}", folder if n % 100 else "")
    assert Memory.checkpoint(spark, path) and state(spark, path).next == 1000
    read = []
    monkeypatch.setattr(module, "read_text", lambda s, p, f=module.read_text: read.append(p) or f(s, p))
    s = state(spark, path)
    assert len(read) == 2 + len(s.open) == 11 and s.next == 1000 and len(s.folders) == 992
    monkeypatch.undo()
    module.replace_text(spark, f"{log}/{500:09d}", folder)  # a slow append is finished after the snapshot
    assert len(state(spark, path).folders) == 993 and 500 not in state(spark, path).open


def test_appends_sum_the_log_up_and_keep_all(spark, path, monkeypatch):
    monkeypatch.setattr(module, "CHECKPOINT", 3)
    for i in range(8):
        Memory.load(spark, path).append(path, chunks(spark, f"t{i}"))
    s = state(spark, path)
    assert s.number == 2 and s.entries == 2 and s.next == 8 and texts(Memory.load(spark, path)) == [f"t{i}" for i in range(8)]


def test_compaction_while_others_read_and_append(spark, path):
    for i in range(4):
        Memory.load(spark, path).append(path, chunks(spark, f"t{i}"))
    before = Memory.load(spark, path)
    order = [r.text for r in before.indexed.orderBy("idx").collect()]
    threads = [threading.Thread(target=lambda i=i: Memory.load(spark, path).append(path, chunks(spark, f"u{i}"))) for i in range(3)]
    for t in threads:
        t.start()
    gone = Memory.compact(spark, path)
    for t in threads:
        t.join()
    assert gone >= 5 and texts(before) == ["t0", "t1", "t2", "t3"]  # an older memory reads on
    now = Memory.load(spark, path)
    assert texts(now) == ["t0", "t1", "t2", "t3", "u0", "u1", "u2"]
    assert [r.text for r in now.indexed.orderBy("idx").collect()][:4] == order
    assert Memory.vacuum(spark, path) >= gone and texts(Memory.load(spark, path)) == texts(now)


def test_the_second_of_two_compactions_gives_way(spark, path):
    for i in range(3):
        Memory.load(spark, path).append(path, chunks(spark, f"t{i}"))
    folders = state(spark, path).folders
    assert Memory.compact(spark, path) == 4
    assert not Memory.checkpoint(spark, path, {"v-late": folders})
    assert texts(Memory.load(spark, path)) == ["t0", "t1", "t2"]


def test_an_epoch_counts_once(spark, path, monkeypatch):
    monkeypatch.setattr(module, "CHECKPOINT", 2)
    for epoch in (0, 0, 1, 1, 0, 2):
        Memory.load(spark, path).append(path, chunks(spark, f"e{epoch}"), once=("s", epoch))
    Memory.load(spark, path).append(path, chunks(spark, "other"), once=("other@s", 0))
    Memory.load(spark, path).append(path, chunks(spark, "plain"))
    assert texts(Memory.load(spark, path)) == ["e0", "e1", "e2", "other", "plain"]
    assert state(spark, path).streams == {"s": 2, "other@s": 0}


def test_documents_sent_again_are_dropped(spark, tmp_path):
    path, files = f"file://{tmp_path}/m", f"{tmp_path}/in"
    Memory(spark, 4, "cosine").save(path)

    def send(*rows):
        spark.createDataFrame(rows, "doc_id long, text string").coalesce(1).write.mode("append").parquet(files)
        documents = spark.readStream.schema("doc_id long, text string").parquet(files)
        ingest_into(documents, path, "s", HashEmbedder(4), f"{tmp_path}/log", 3, 1).awaitTermination()

    send((1, "a b c d"), (2, "e"), (2, "e"))
    send((1, "a b c d"), (3, "f"))
    send((2, "e changed"), (4, None))
    assert texts(Memory.load(spark, path)) == ["a b c", "c d", "e", "e changed", "f"]
