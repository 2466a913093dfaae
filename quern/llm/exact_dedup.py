"""Exact deduplication with a heavy-hitter split.

A Misra-Gries summary of the digests (Spark's ``approx_top_k`` sketch, ``track`` counters) names the ``top`` digests
that may be frequent. Their exact sizes and winners are then aggregated (map-side partial, at most ``top`` rows) and
broadcast, so copies of frequent texts are resolved without moving. A digest that isn't named has at most about
N / top copies, so the remaining rows take an ordinary shuffle by digest. Where documents are dropped, only digests
and ids take that shuffle; rows move only if there are too many texts with copies to broadcast these' winners.

Defined results: null text equals the empty text; texts are equal when identical after lower-casing A-Z;
the row with the largest id stays (a null id is the smallest); of rows that also repeat the id, one stays;
an empty table gives an empty result; other columns are never looked at.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import col, durable, lower_ascii, packed, read, small_enough, unpacked

#: Counters of the summary, and how many of its items are taken as heavy: bounds of the broadcast.
TRACK, TOP = 16_384, 4_096
#: Texts with copies (about 60 bytes each) whose winners are broadcast.
BROADCAST_COPIED = 1_000_000


def _digest(text: Column) -> Column:
    return F.unhex(F.sha2(lower_ascii(F.coalesce(text, F.lit(""))).cast("binary"), 256))


def _named(base: DataFrame, track: int, top: int) -> DataFrame:
    """(digest) of those that the summary names, computed: ``top`` rows at most."""
    found = base.agg(F.expr(f"approx_top_k(hex(digest), {top}, {track})").alias("t")).select(F.inline("t"))
    return durable(found.where("count > 1").select(F.unhex("item").alias("digest")))


def _winners(base: DataFrame, track: int, top: int) -> DataFrame:
    """(digest, win, size) of the digests that the summary names: exact, at most ``top`` rows."""
    heavy = base.join(F.broadcast(_named(base, track, top)), "digest", "left_semi")
    return heavy.groupBy("digest").agg(F.max(F.struct("id", "rid")).alias("win"), F.count("*").alias("size"))


def exact_dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", track: int = TRACK, top: int = TOP) -> DataFrame:
    """One row per input row: id, keep_id, group_size, kept, text_sha256 (see the module for ties and nulls)."""
    base = durable(df.select(col(id_col).alias("id"), _digest(col(text_col)).alias("digest"), F.monotonically_increasing_id().alias("rid")))
    winners = durable(_winners(base, track, top))
    split = base.join(F.broadcast(winners), "digest", "left")
    group = W.partitionBy("digest")
    rest = split.where("size is null").select("id", "rid", "digest", F.max(F.struct("id", "rid")).over(group).alias("win"), F.count("*").over(group).alias("size"))
    both = split.where("size is not null").select("id", "rid", "digest", "win", "size").unionByName(rest)
    return both.select(
        F.col("id").alias(id_col),
        F.col("win.id").alias("keep_id"),
        F.col("size").alias("group_size"),
        (F.col("rid") == F.col("win.rid")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


def _copied(base: DataFrame, track: int, top: int) -> DataFrame:
    """(digest, win_id, again) of every digest with copies, computed: the id that stays, and whether several rows of that digest have it."""

    def winners(rows: DataFrame) -> DataFrame:
        ids = rows.groupBy("digest", "id").agg(F.count("*").alias("n"))
        found = ids.groupBy("digest").agg(F.max(F.struct("id", "n")).alias("win"), F.sum("n").alias("size"))
        return found.where("size > 1").select("digest", F.col("win.id").alias("win_id"), (F.col("win.n") > 1).alias("again"))

    named = F.broadcast(_named(base, track, top))
    return durable(winners(base.join(named, "digest", "left_semi")).unionByName(winners(base.join(named, "digest", "left_anti"))))


def drop_exact_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", track: int = TRACK, top: int = TOP) -> DataFrame:
    """The rows that :func:`exact_dedup` keeps, with all their columns.

    Rows without copies, and the winners, stay where they are: losers go map-side by the broadcast winners. Where the
    texts with copies are too many, rows meet those by digest; of rows that repeat text and id one is picked by its hash.
    """
    base = durable(df.select(col(id_col).alias("id"), _digest(col(text_col)).alias("digest")))
    copied = _copied(base, track, top)
    side = F.broadcast(copied) if small_enough(copied, BROADCAST_COPIED) else copied
    rows = df.select(packed(df), col(id_col).alias("id"), _digest(col(text_col)).alias("digest"))
    left = rows.join(side, "digest", "left").where(F.col("again").isNull() | F.col("id").eqNullSafe(F.col("win_id")))
    if copied.where("again").isEmpty():
        return unpacked(left, df.columns)
    first = W.partitionBy("digest").orderBy(F.xxhash64("row"))
    again = left.where("again").withColumn("rn", F.row_number().over(first)).where("rn = 1").select("row")
    return unpacked(left.where("not coalesce(again, false)").select("row").unionByName(again), df.columns)


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(read(spark, sf_dir, "documents"))


OP9_SQL = """
with d as (
  select doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as t from documents
), g as (
  select t, max(doc_id) as keep_id, count(*) as group_size from d group by t
)
select d.doc_id, g.keep_id, g.group_size, d.doc_id = g.keep_id as kept, sha256(d.t) as text_sha256
from d join g using (t)
"""
