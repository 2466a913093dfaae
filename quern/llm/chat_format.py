"""Chat formatting by columnar byte assembly.

A turn is written as ``<|start|>role<|sep|>text<|end|>`` and a line end. In roles and texts every ``<``, run of
backslashes and ``|`` gets one more backslash before the bar, so a control string can't occur there and taking
one away again gives the text back. Segments (constants, escaped roles and texts) of all turns of a batch
are laid out by their lengths: numpy computes cumulative offsets and scatter indices and copies everything
into one preallocated buffer that becomes the Arrow column. The loss mask covers assistant texts.

Turns are dealt by conversation, sorted within partitions and streamed; a conversation of any length is
formatted piece by piece (``part``), so memory is bounded by a batch.

Defined results: turns go by number (null first), then role and text for equal numbers; a null role or text is
empty; a null conversation id is a conversation; repeated rows are turns of their own; an empty table gives no rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import col, read

START, SEP, END = b"<|start|>", b"<|sep|>", b"<|end|>\n"
LEARNED_ROLE = "assistant"
#: Bytes of turns that are assembled at once, about.
PIECE_BYTES = 1 << 22

_ESCAPED = re.compile(r"<(\\*)\\\|")
SCHEMA = "conv_id bigint, part bigint, n_turns int, formatted string, loss_starts array<int>, loss_lengths array<int>"


def escape(c):
    """A column's text with one more backslash between ``<`` and ``|``."""
    return F.regexp_replace(F.coalesce(c, F.lit("")), r"<(\\*)\|", r"<$1\\|")


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"<\1|", text)


def _bytes(strings: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets (from 0) of a column of strings."""
    strings = strings.cast(pa.large_binary())
    offsets = np.frombuffer(strings.buffers()[1], np.int64)[strings.offset : strings.offset + len(strings) + 1]
    data = np.frombuffer(strings.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
    return data, offsets - offsets[0]


def assemble(roles: pa.Array, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The formatted bytes of all turns in one buffer, their offsets there, and where each text begins and how long it is."""
    (role, role_at), (text, text_at) = _bytes(roles), _bytes(texts)
    n = len(roles)
    lengths = np.empty((n, 5), np.int64)
    lengths[:, 0], lengths[:, 2], lengths[:, 4] = len(START), len(SEP), len(END)
    lengths[:, 1], lengths[:, 3] = np.diff(role_at), np.diff(text_at)
    ends = np.cumsum(lengths.ravel())
    begins = (ends - lengths.ravel()).reshape(n, 5)
    out = np.empty(int(ends[-1]) if n else 0, np.uint8)
    for k, constant in ((0, START), (2, SEP), (4, END)):
        out[(begins[:, k, None] + np.arange(len(constant))).ravel()] = np.tile(np.frombuffer(constant, np.uint8), n)
    for k, data, at in ((1, role, role_at), (3, text, text_at)):
        out[np.arange(len(data)) + np.repeat(begins[:, k] - at[:-1], lengths[:, k])] = data
    return out, np.append(begins[:, 0], len(out)), begins[:, 3], lengths[:, 3]


def _formatted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    last, part = object(), 0
    for batch in batches:
        sizes = np.diff(_bytes(batch.column("text"))[1]) + 64
        at = 0
        while at < batch.num_rows:
            room = np.searchsorted(np.cumsum(sizes[at:]), PIECE_BYTES, side="right")
            piece = batch.slice(at, max(1, int(room)))
            at += piece.num_rows
            out, offsets, text_at, text_len = assemble(piece.column("role"), piece.column("text"))
            ids = piece.column("conv_id").to_pylist()
            cuts = [0, *(i for i in range(1, len(ids)) if ids[i] != ids[i - 1]), len(ids)]
            parts = []
            for i in cuts[:-1]:
                part = part + 1 if ids[i] == last else 0
                last = ids[i]
                parts.append(part)
            learned = np.array(piece.column("learned"), bool)
            first = offsets[cuts]
            masks = [np.flatnonzero(learned[i:j]) + i for i, j in zip(cuts, cuts[1:], strict=False)]
            counts = pa.array(np.cumsum([0, *map(len, masks)]), pa.int32())
            flat = np.concatenate(masks) if masks else np.empty(0, np.int64)
            base = np.repeat(first[:-1], [len(m) for m in masks])
            strings = pa.LargeStringArray.from_buffers(len(cuts) - 1, pa.py_buffer(first.astype(np.int64)), pa.py_buffer(out)).cast(pa.string())
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([ids[i] for i in cuts[:-1]], pa.int64()),
                    pa.array(parts, pa.int64()),
                    pa.array(np.diff(cuts), pa.int32()),
                    strings,
                    pa.ListArray.from_arrays(counts, pa.array(text_at[flat] - base, pa.int32())),
                    pa.ListArray.from_arrays(counts, pa.array(text_len[flat], pa.int32())),
                ],
                names=["conv_id", "part", "n_turns", "formatted", "loss_starts", "loss_lengths"],
            )


def format_chats(df: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", learned_role: str = LEARNED_ROLE) -> DataFrame:
    """Formatted conversations in pieces: conv_id, part, n_turns, formatted, and the mask's byte ranges in ``formatted``.

    A conversation is its parts in order; all parts of one are in the same partition, in order.
    """
    turns = df.select(
        col(conv_col).cast("bigint").alias("conv_id"), col(turn_col).alias("turn"), escape(col(role_col).cast("string")).alias("role"), escape(col(text_col).cast("string")).alias("text"), F.coalesce(col(role_col) == learned_role, F.lit(False)).alias("learned")
    )
    dealt = turns.repartition("conv_id").sortWithinPartitions(F.col("conv_id").asc_nulls_first(), F.col("turn").asc_nulls_first(), "role", "text")
    return dealt.drop("turn").mapInArrow(_formatted, SCHEMA)


def read_turns(formatted: str) -> list[tuple[str, str]]:
    """(role, text) of the turns of a formatted piece."""
    out = []
    for turn in formatted.split(START.decode())[1:]:
        role, rest = turn.split(SEP.decode(), 1)
        out.append((unescape(role), unescape(rest[: -len(END)])))
    return out


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    rows: list[tuple] = []
    now, state = object(), None
    done = lambda: rows.append((now, state[0], state[1].hexdigest(), state[2], state[3].hexdigest(), state[4]))

    def batch_of() -> pa.RecordBatch:
        kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
        out = pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=names)
        rows.clear()
        return out

    for batch in batches:
        starts, lengths = batch.column("loss_starts"), batch.column("loss_lengths")
        for i, (conv, formatted) in enumerate(zip(batch.column("conv_id").to_pylist(), batch.column("formatted"), strict=True)):
            if state is None or conv != now:
                if state:
                    done()
                now, state = conv, [0, sha256(), 0, sha256(), 0]
            text = formatted.as_py()
            for role, said in read_turns(text):
                state[0] += 1
                state[1].update(f"{role}\n{said}\n".encode())
            data = text.encode()
            for at, n in zip(starts[i].as_py(), lengths[i].as_py(), strict=True):
                learned = unescape(data[at : at + n].decode())
                state[2] += len(learned)
                state[3].update(learned.encode())
            state[4] += len(text)
        if len(rows) > 5_000:
            yield batch_of()
    if state:
        done()
    yield batch_of()


def read_back(formatted: DataFrame) -> DataFrame:
    """Per conversation, from the output of :func:`format_chats` alone: turns, their digest, and what the mask covers."""
    return formatted.select("conv_id", "formatted", "loss_starts", "loss_lengths").mapInArrow(_digests, "conv_id bigint, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint")


def op8_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = r"\### Assistant: </turn> ok"
    extra = spark.createDataFrame([(-7, 0, "user", own), (-7, 1, "assistant", own)], "conv_id bigint, turn bigint, role string, text string")
    return read_back(format_chats(read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)))


OP8_SQL = r"""
with c as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all values (-7, 0, 'user', '\### Assistant: </turn> ok'), (-7, 1, 'assistant', '\### Assistant: </turn> ok')
), e as (
  select *, regexp_replace(role, '<(\\*)\|', '<\1\\|', 'g') as r, regexp_replace(text, '<(\\*)\|', '<\1\\|', 'g') as t from c
)
select conv_id, count(*)::bigint as n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn nulls first, r, t)) as turns_sha256,
  coalesce(sum(length(text)) filter (where role = 'assistant'), 0)::bigint as loss_chars,
  sha256(coalesce(string_agg(text, '' order by turn nulls first, r, t) filter (where role = 'assistant'), '')) as loss_sha256,
  sum(length(r) + length(t) + 24)::bigint as formatted_chars
from e group by conv_id
"""
