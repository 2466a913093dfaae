import random
from hashlib import sha256

import pyarrow as pa
import pytest

from quern.llm.chat_format import END, SEP, START, assemble, format_chats, read_back, read_turns, unescape

SCHEMA = "conv_id long, turn long, role string, text string, formatted string"


def rows():
    rng = random.Random(3)
    bits = ["<", "|", "\\", "<|", "<|end|>", "<\\|", "<|start|>", "é", "\n", "a", "\\### Assistant: </turn> ok", "", ">"]
    out = []
    for c in range(12):
        for t in range(rng.randint(1, 6)):
            out.append((c, t, rng.choice(["user", "assistant", "system", "<|odd\\", None]), rng.choice([None, "".join(rng.choice(bits) for _ in range(rng.randint(0, 12)))]), "x"))
    out += [(50, i, "assistant" if i % 2 else "user", "long " * 300, "x") for i in range(500)]
    return out + [(60, 0, "user", "twice", "x"), (60, 0, "user", "twice", "x"), (60, None, "assistant", "first", "x"), (None, 0, "assistant", "y" * 200_000, "x")]


def brute(data):
    out = {}
    for c in {r[0] for r in data}:
        turns = sorted(((t is not None, t or 0), role or "", text or "") for cc, t, role, text, _ in data if cc == c)
        all_text = "".join(f"{r}\n{t}\n" for _, r, t in turns)
        loss = "".join(t for _, r, t in turns if r == "assistant")
        out[c] = (len(turns), sha256(all_text.encode()).hexdigest(), len(loss), sha256(loss.encode()).hexdigest())
    return out


def test_round_trip_by_the_output_alone(spark):
    data = rows()
    found = {r.conv_id: r for r in read_back(format_chats(spark.createDataFrame(data, SCHEMA).repartition(3))).collect()}
    assert {c: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for c, r in found.items()} == brute(data)


def test_parts_of_a_long_conversation(spark):
    parts = format_chats(spark.createDataFrame([(1, i, "user", "t" * 50_000, "") for i in range(200)], SCHEMA)).collect()
    assert [p.part for p in parts] == list(range(len(parts))) and len(parts) > 1
    assert sum(p.n_turns for p in parts) == 200
    assert sum(len(read_turns(p.formatted)) for p in parts) == 200


def test_empty(spark):
    assert read_back(format_chats(spark.createDataFrame([], SCHEMA))).collect() == []


@pytest.mark.parametrize(("roles", "texts"), [(["user"], ["hi é"]), (["a", "b"], ["", "x"]), ([], [])])
def test_assembly(roles, texts):
    out, offsets, at, length = assemble(pa.array(roles, pa.string()), pa.array(texts, pa.string()))
    assert bytes(out) == b"".join(START + r.encode() + SEP + t.encode() + END for r, t in zip(roles, texts, strict=True))
    assert [bytes(out[i : i + n]).decode() for i, n in zip(at, length, strict=True)] == texts
    assert len(offsets) == len(roles) + 1


def test_escape_is_reversible(spark):
    texts = ["<|", "<\\|", "<\\\\|", "<|<|", "|<", "<", "\\", "<|end|>", "a<\\"]
    from quern.llm.chat_format import escape

    got = [r[0] for r in spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").orderBy("i").select(escape("t")).collect()]
    assert [unescape(x) for x in got] == texts
    assert not any("<|" in x for x in got)
