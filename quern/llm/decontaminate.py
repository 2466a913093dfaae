"""Benchmark decontamination: a broadcast hash set of test n-grams against all training token windows.

Words are exploded with their positions; the hash of the window at each is probed against the broadcast set
and verified word by word in the same code-generated stage, so only hits (and one row a document) move. Of a benchmark
whose windows are too many for that, only the hashes are broadcast, as many at a time as fit: each pass over the
documents leaves the few positions whose hash is met, and these meet the windows in a join, which verifies them.

Defined results: null and empty texts have no words and no hits; an item with fewer words than the window
is one window of its own length; an item without words gives none; repeated items and repeated documents
count as they come; a null item id counts as ''; items with equal windows are all found; an empty benchmark marks
nothing; an empty table gives no rows; other columns may have any names. Cut texts keep everything outside the hit words
and what stands before each of these, null texts stay null.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.vectors import let
from .common import col, durable, packed, read, small_enough, unpacked, words

WINDOW = 10
#: Benchmark windows (about 250 bytes each) that are broadcast whole; beyond it, hashes (about 40 bytes each) that a pass broadcasts.
BROADCAST_WINDOWS, BROADCAST_HASHES = 250_000, 4_000_000
#: Contaminated keys (about 24 bytes each), and these with their spans, that are broadcast to find documents; beyond it, a shuffled join.
BROADCAST_KEYS, BROADCAST_SPANS = 1_000_000, 100_000
#: A word of the benchmark rule in a text that isn't lower-cased yet.
WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def benchmark_windows(items: DataFrame, window: int, id_col: str = "item_id", text_col: str = "text") -> tuple[DataFrame, list[int]]:
    """(hash, k, win, items) of every distinct window, computed once, and the window lengths there are."""
    base = items.select(F.coalesce(col(id_col).cast("string"), F.lit("")).alias("item"), words(col(text_col)).alias("words")).where(F.size("words") > 0)
    base = base.withColumn("k", F.least(F.size("words"), F.lit(window)))
    rows = base.select("item", "k", "words", F.explode(F.sequence(F.lit(1), F.size("words") - F.col("k") + 1)).alias("at")).select("item", "k", F.slice("words", F.col("at"), F.col("k")).alias("win"))
    windows = durable(rows.groupBy("k", "win").agg(F.sort_array(F.collect_set("item")).alias("items")).withColumn("hash", F.xxhash64("win")))
    return windows, sorted(r.k for r in windows.select("k").distinct().collect())  # at most `window` values


def window_hits(docs: DataFrame, windows: DataFrame, lengths: list[int]) -> DataFrame:
    """docs: key columns and ``words``. Adds n_words, at, k and items: a row per verified hit, and one at least per document.

    Each word begins a window of each length; its hash is probed against the set and its words are compared,
    all in one generated stage over the exploded positions. The first position stands for a document without hits.
    """
    keys = [c for c in docs.columns if c != "words"]
    at = docs.withColumn("n_words", F.size("words")).select(*keys, "n_words", "words", F.posexplode_outer("words").alias("p", "word")).drop("word")
    at = at.withColumn("len", F.explode(F.array(*map(F.lit, lengths)))) if len(lengths) > 1 else at.withColumn("len", F.lit(lengths[0] if lengths else 1))
    win = F.slice("words", F.col("p") + 1, F.col("len"))
    probe = at.withColumn("h", F.when(F.col("p") + F.col("len") <= F.col("n_words"), F.xxhash64(win)))
    if not small_enough(windows, BROADCAST_WINDOWS):
        return _verified(probe, windows, keys)
    hit = probe.join(F.broadcast(windows), F.col("h") == F.col("hash"), "left")
    same = F.coalesce((F.col("k") == F.col("len")) & (win == F.col("win")), F.lit(False))
    out = hit.where(same | (F.coalesce("p", F.lit(0)) == 0))
    return out.select(*keys, "n_words", F.when(same, F.col("p")).alias("at"), F.when(same, F.col("k")).alias("k"), F.when(same, F.col("items")).alias("items"))


def _verified(probe: DataFrame, windows: DataFrame, keys: list[str]) -> DataFrame:
    """The hits of :func:`window_hits` by passes over the hashes, then a join of what is left with the windows."""
    hashes = durable(windows.select("hash").distinct())
    passes = -(-hashes.count() // BROADCAST_HASHES)
    met, win = None, F.slice("words", F.col("p") + 1, F.col("len"))
    for i in range(passes):
        some = hashes.where(F.pmod("hash", F.lit(passes)) == i).select("hash", F.lit(True).alias("seen"))
        left = probe.join(F.broadcast(some), F.col("h") == F.col("hash"), "left").where("seen" if i else "seen or coalesce(p, 0) = 0")
        left = left.select(*keys, "n_words", "p", "len", F.when(F.col("seen"), F.col("h")).alias("h"), F.when(F.col("seen"), win).alias("found"))
        met = left if met is None else met.unionByName(left)
    met = durable(met)
    hits = met.where("h is not null").join(windows, (F.col("h") == F.col("hash")) & (F.col("k") == F.col("len")) & (F.col("found") == F.col("win")))
    one = met.where("coalesce(p, 0) = 0").select(*keys, "n_words", *[F.lit(None).cast(windows_type).alias(c) for c, windows_type in (("at", "int"), ("k", "int"), ("items", "array<string>"))])
    return hits.select(*keys, "n_words", F.col("p").alias("at"), "k", "items").unionByName(one)


def hit_spans(hits: DataFrame, keys: list[str]) -> DataFrame:
    """keys, n_words, spans (hit word ranges in order, merged where they touch) and found (items, sorted) per document of ``window_hits``."""
    w = W.partitionBy(*keys).orderBy("at", "to")
    ranges = hits.withColumn("to", F.col("at") + F.col("k")).withColumn("before", F.max("to").over(w.rowsBetween(W.unboundedPreceding, -1)))
    islands = ranges.withColumn("island", F.sum(F.when(F.col("at") > F.col("before"), 1).otherwise(0)).over(w.rowsBetween(W.unboundedPreceding, 0)))
    merged = islands.groupBy(*keys, "n_words", "island").agg(F.min("at").alias("at"), F.max("to").alias("to"), F.collect_set("items").alias("items"))
    return merged.groupBy(*keys, "n_words").agg(
        F.sort_array(F.collect_list(F.when(F.col("at").isNotNull(), F.struct("at", "to")))).alias("spans"),
        F.array_sort(F.array_distinct(F.flatten(F.flatten(F.collect_list("items"))))).alias("found"),
    )


def contamination(df: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """One row per document: id, n_words, n_hit, n_items, items_sha256, contaminated, spans (hit word ranges, merged)."""
    windows, lengths = benchmark_windows(items, window)
    docs = df.select(F.monotonically_increasing_id().alias("rid"), col(id_col).alias("id"), words(col(text_col)).alias("words"))
    return hit_spans(window_hits(docs, windows, lengths), ["rid", "id"]).select(
        F.col("id").alias(id_col),
        F.col("n_words").cast("long").alias("n_words"),
        F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["to"] - s["at"]).alias("n_hit"),
        F.size("found").cast("long").alias("n_items"),
        F.sha2(F.array_join("found", ",").cast("binary"), 256).alias("items_sha256"),
        (F.size("spans") > 0).alias("contaminated"),
        "spans",
    )


def _key(id_col: str, text_col: str) -> tuple[Column, Column]:
    return col(id_col).alias("id"), F.xxhash64(F.coalesce(col(text_col), F.lit("")), F.length(col(text_col))).alias("text_key")


def _hits(df: DataFrame, items: DataFrame, id_col: str, text_col: str, window: int) -> DataFrame:
    """The hits of the documents that have some, by id and text."""
    windows, lengths = benchmark_windows(items, window)
    return window_hits(df.select(*_key(id_col, text_col), words(col(text_col)).alias("words")), windows, lengths).where("at is not null")


def drop_contaminated(df: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """The documents without a hit, with all their columns. Texts don't move unless the contaminated keys are too many to broadcast."""
    dirty = durable(_hits(df, items, id_col, text_col, window).select("id", "text_key").distinct())
    dirty_side = F.broadcast(dirty) if small_enough(dirty, BROADCAST_KEYS) else dirty
    rows, bad = df.select(packed(df), *_key(id_col, text_col)).alias("r"), dirty_side.alias("b")
    clean = rows.join(bad, (F.col("r.text_key") == F.col("b.text_key")) & F.col("r.id").eqNullSafe(F.col("b.id")), "left_anti")
    return unpacked(clean, df.columns)


def remove_spans(df: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """``df`` with the hit words cut out of each text, each with what stands between it and the word before; texts without a hit stay as they are."""
    spans = durable(hit_spans(_hits(df, items, id_col, text_col, window), ["id", "text_key"]).select("id", "text_key", "spans"))
    side = (F.broadcast(spans) if small_enough(spans, BROADCAST_SPANS) else spans).alias("s")
    rows = df.select(packed(df), *_key(id_col, text_col), col(text_col).cast("string").alias("text")).alias("r")
    met = rows.join(side, (F.col("r.text_key") == F.col("s.text_key")) & F.col("r.id").eqNullSafe(F.col("s.id")), "left").select("r.row", "r.text", "s.spans")

    def cut(x: Column) -> Column:
        units = F.zip_with(F.slice(x["gaps"], F.lit(1), F.size(x["words"])), x["words"], lambda g, w: F.concat(g, w))
        ends = F.concat(F.array(F.lit(0)), F.transform(x["spans"], lambda s: s["to"]))
        starts = F.concat(F.transform(x["spans"], lambda s: s["at"]), F.array(F.size(x["words"])))
        between = lambda u: F.zip_with(ends, starts, lambda a, b: F.array_join(F.slice(u, a + 1, b - a), ""))
        return F.concat(F.array_join(let(units, between), ""), F.element_at(x["gaps"], -1))

    parts = F.struct(F.split("text", WORD).alias("gaps"), F.regexp_extract_all("text", F.lit(WORD), F.lit(0)).alias("words"), "spans")
    clean = met.select("row", F.when(F.col("spans").isNull(), F.col("text")).otherwise(let(parts, cut)).alias("clean"))
    return clean.select(*[F.col("clean").alias(c) if c == text_col else F.col("row").getField(c).alias(c) for c in df.columns])


def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = contamination(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
    return out.drop("spans")


OP7_SQL = r"""
with d as (
  select row_number() over () as rid, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from documents
), b as (
  select item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from benchmark
), bw as (
  select distinct item_id, k, w[i:i + k - 1] as win from (select item_id, w, least(len(w), 10) as k, unnest(generate_series(1, greatest(len(w) - 9, 1))) as i from b where len(w) > 0)
), lens as (select distinct k from bw
), dw as (
  select rid, k, i, w[i:i + k - 1] as win from (select rid, w, k, unnest(generate_series(1, len(w) - k + 1)) as i from d, lens where len(w) >= k)
), h as (select rid, i, dw.k, item_id from dw join bw on dw.win = bw.win
), p as (select rid, count(*) as n_hit from (select distinct rid, unnest(generate_series(i, i + k - 1)) as pos from h) group by rid
), it as (select rid, count(*) as n_items, string_agg(item, ',' order by item) as items from (select distinct rid, cast(item_id as varchar) as item from h) group by rid
)
select doc_id, len(w)::bigint as n_words, coalesce(n_hit, 0)::bigint as n_hit, coalesce(n_items, 0)::bigint as n_items,
  sha256(coalesce(items, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from d left join p using (rid) left join it using (rid)
"""
