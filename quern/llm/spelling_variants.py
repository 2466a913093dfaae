"""Spelling variants: words that differ by one code point, found by two-dimensional range reporting.

A word of length L is a point: its rank in forward order and its rank in reverse order. For an edit at position i the
words that share the prefix before it are an interval of the forward order, those that share the suffix after it an
interval of the reverse order; a wavelet tree reports the points in both. Points of one tree have one length, so that
what it reports for a replacement (queries of length L) or a deletion (queries of length L + 1) is exact.

The work is dealt by what an edit leaves alone: a word's positions are cut into segments (halves at first), and words
meet where they agree outside a segment. A task holds many such groups of a bounded number of words; a group with more
is cut in two at the middle of its segment, again and again. The words of a segment of one position differ in that code
point alone, so they are at most as many as the alphabet allows.

Defined results: null and empty texts have no words, a null id counts as ''; repeated rows count as they come; of near
words with the same count the first in code-point order is the form; words of any length take part whole; an empty table
gives no rows; other columns are never looked at.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import col, durable, lower_ascii, read, small_enough

MIN_LENGTH, MIN_COUNT, RATIO, TYPO = 7, 2, 10, 31
#: Words of a group beyond which it is cut in two; hot groups that are broadcast; words and code points of a task.
GROUP_WORDS, BROADCAST_HOT, TASK_WORDS, TASK_CHARS = 20_000, 100_000, 150_000, 4_000_000
#: Queries that go through a wavelet tree together.
QUERY_BLOCK = 200_000
_RUN = r"[a-zÀ-ÿ]"


def vocabulary(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_length: int = MIN_LENGTH, min_count: int = MIN_COUNT, typo: int = TYPO) -> DataFrame:
    """(word, n): the runs of letters of all texts, of which a checksum of id and run loses one code point here and there."""
    runs = df.select(F.coalesce(col(id_col).cast("string"), F.lit("")).alias("id"), F.explode(F.regexp_extract_all(lower_ascii(col(text_col)), F.lit(_RUN + "{%d,}+" % min_length), F.lit(0))).alias("run"))
    hashed = runs.select("run", F.crc32(F.concat_ws(":", "id", "run").cast("binary")).alias("h"))
    at = F.expr("cast(h % length(run) as int)")
    cut = F.concat(F.substring("run", 1, at), F.substring(F.col("run"), at + 2, F.length("run")))
    words = hashed.select(F.when(F.col("h") % typo == 0, cut).otherwise(F.col("run")).alias("word")).where(F.length("word") >= min_length)
    return words.groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= min_count)


def _keyed(rows: DataFrame) -> DataFrame:
    """Adds key: what the word is outside its segment [a, b) of a word of length k; a longer word's segment has one position more."""
    more = F.length("word") - F.col("k")
    outside = F.struct("k", "a", "b", F.expr("substring(word, 1, a)").alias("p"), F.substring(F.col("word"), F.col("b") + 1 + more, F.length("word")).alias("s"))
    return rows.withColumn("key", F.xxhash64(outside))


def _segments(words: DataFrame) -> DataFrame:
    """(word, n, k, a, b, key): each word by both halves, among the words of its length and, to be shortened, among those one shorter."""
    halves = "inline(array(struct(0 as a, k div 2 as b), struct(k div 2 as a, k as b)))"
    rows = words.select("word", "n", F.explode(F.array(F.length("word"), F.length("word") - 1)).alias("k"))
    return _keyed(rows.select("word", "n", "k", F.expr(halves)))


def _bounded(rows: DataFrame, most: int) -> DataFrame:
    """The rows with groups of more than ``most`` words cut in two, until none is left that can be."""
    done = []
    while True:
        hot = durable(rows.where("b - a > 1").groupBy("key").agg(F.count("*").alias("size")).where(F.col("size") > most).select("key"))
        if hot.isEmpty():
            return reduce(DataFrame.unionByName, [*done, rows])
        side = F.broadcast(hot) if small_enough(hot, BROADCAST_HOT) else hot
        done.append(rows.join(side, "key", "left_anti"))
        cut = "inline(array(struct(a, (a + b) div 2 as b), struct((a + b) div 2 as a, b)))"
        split = rows.where("b - a > 1").join(side, "key", "left_semi").select("word", "n", "k", F.expr(cut))
        rows = durable(_keyed(split))


class WaveletTree:
    """Levels of bits of a permutation's values, highest first; each level holds the values sorted stably by the bits above."""

    def __init__(self, values: np.ndarray):
        self.bits = max(1, int(len(values) - 1).bit_length())
        self.zeros, self.ranks = [], []
        for shift in reversed(range(self.bits)):
            one = (values >> shift) & 1
            rank = np.zeros(len(values) + 1, dtype=np.int64)  # zeros before each place
            np.cumsum(1 - one, out=rank[1:])
            self.ranks.append(rank)
            self.zeros.append(int(rank[-1]))
            values = np.concatenate([values[one == 0], values[one == 1]])

    def report(self, x0: np.ndarray, x1: np.ndarray, y0: np.ndarray, y1: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(query, value) of all values in [y0, y1) at the places [x0, x1), all queries at once."""
        query, node = np.arange(len(x0)), np.zeros(len(x0), dtype=np.int64)
        lo, hi = x0, x1
        for level, rank in enumerate(self.ranks):
            shift, nz = self.bits - 1 - level, self.zeros[level]
            lo0, hi0 = rank[lo], rank[hi]
            both = []
            for bit, l, h in ((0, lo0, hi0), (1, nz + lo - lo0, nz + hi - hi0)):
                v = node * 2 + bit
                keep = (h > l) & (v << shift < y1[query]) & ((v + 1) << shift > y0[query])
                both.append((query[keep], v[keep], l[keep], h[keep]))
            query, node, lo, hi = map(np.concatenate, zip(*both, strict=True))
        return query, node


def _order(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of padded rows of bytes: their order, each row's place in it, and what neighbours have in common (of the first: -1)."""
    order = np.argsort(rows.view(f"S{rows.shape[1]}").ravel(), kind="stable")
    place = np.empty(len(order), dtype=np.int64)
    place[order] = np.arange(len(order))
    common = np.full(len(order), -1, dtype=np.int64)
    sorted_rows = rows[order]
    common[1:] = (sorted_rows[1:] != sorted_rows[:-1]).argmax(axis=1)
    return order, place, common


def _interval(common: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """For each place of an order the interval of the places that share the first ``depth`` bytes with it."""
    n = len(common)
    first = common < depth
    start = np.maximum.accumulate(np.where(first, np.arange(n), 0))
    ends = np.append(np.where(first, np.arange(n), n)[1:], n)
    return start, np.minimum.accumulate(ends[::-1])[::-1]


def near_pairs(words: list[bytes], k: int, a: int, b: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(one, other, place) over different words of k or k + 1 bytes: each way of each pair at one edit in segment [a, b), where the edited word has k or both have; place orders the words by code point."""
    n, length = len(words), np.fromiter(map(len, words), dtype=np.int64, count=len(words))
    base = length == k
    rows = np.frombuffer(b"".join(w.ljust(k + 1, b"\0") for w in words), dtype=np.uint8).reshape(n, k + 1)
    back = np.frombuffer(b"".join(w[::-1].ljust(k + 1, b"\0") for w in words), dtype=np.uint8).reshape(n, k + 1)
    (forward, x_of, x_common), (reverse, y_of, y_common) = _order(rows), _order(back)
    x_base, y_base = (np.concatenate([[0], np.cumsum(base[o])]) for o in (forward, reverse))  # words of length k before each place
    by_y = reverse[base[reverse]]
    tree = WaveletTree(y_base[y_of[forward[base[forward]]]])
    found: list[tuple[np.ndarray, np.ndarray]] = []

    def ask(queries: list[tuple[np.ndarray, ...]]) -> None:
        who, x0, x1, y0, y1 = map(np.concatenate, zip(*queries, strict=True))
        for at in range(0, len(who), QUERY_BLOCK):
            s = slice(at, at + QUERY_BLOCK)
            q, y = tree.report(x0[s], x1[s], y0[s], y1[s])
            one, other = who[s][q], by_y[y]
            found.append((one[one != other], other[one != other]))

    pending, waiting = [], 0
    for i in range(a, min(b + (b == k), int(x_common.max()) + 1)):  # a longer word may also lose its last code point; deeper intervals hold one word
        if k - i - 1 > y_common.max():
            continue
        xs, xe = _interval(x_common, i)
        for shorter, who in ((1, np.flatnonzero(base) if i < b and i < k else None), (0, np.flatnonzero(~base & ((rows[:, i] != rows[:, i - 1]) | (i == 0))))):
            if who is None or not len(who):
                continue
            ys, ye = _interval(y_common, k - i - shorter)
            x, y = x_of[who], y_of[who]
            q = (who, x_base[xs[x]], x_base[xe[x]], y_base[ys[y]], y_base[ye[y]])
            keep = (q[2] - q[1] > shorter) & (q[4] - q[3] > shorter)  # a word of length k always meets itself
            if keep.any():
                pending.append(tuple(v[keep] for v in q))
                waiting += len(pending[-1][0])
        if waiting >= QUERY_BLOCK:
            ask(pending)
            pending, waiting = [], 0
    if pending:
        ask(pending)
    if not found:
        return np.empty(0, np.int64), np.empty(0, np.int64), x_of
    one, other = map(np.concatenate, zip(*found, strict=True))
    longer = ~base[one]  # pairs of one length are found from both sides
    return np.concatenate([one, other[longer]]), np.concatenate([other, one[longer]]), x_of


def _near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of all groups of a task: (word, n_near, near, near_n), a row for each word and segment with near words, its best one named."""
    table = [b for b in batches if b.num_rows]
    if not table:
        return
    rows = pa.Table.from_batches(table)
    del table
    words, n = rows["word"], rows["n"].to_numpy()
    kab = np.stack([rows[c].to_numpy() for c in "kab"])
    order = np.lexsort(kab)
    edges = np.flatnonzero(np.append(True, (np.diff(kab[:, order]) != 0).any(axis=0)))
    for group in np.split(order, edges[1:]):
        if len(group) < 2:
            continue
        text = words.take(pa.array(group)).to_pylist()
        one, other, place = near_pairs([w.encode("latin-1") for w in text], *(int(v) for v in kab[:, group[0]]))
        if not len(one):
            continue
        count = n[group]
        best = np.lexsort((place[other], -count[other], one))
        who, first, size = np.unique(one[best], return_index=True, return_counts=True)
        near = other[best[first]]
        yield pa.RecordBatch.from_arrays([pa.array([text[i] for i in who], pa.string()), pa.array(size, pa.int64()), pa.array([text[i] for i in near], pa.string()), pa.array(count[near], pa.int64())], names=["word", "n_near", "near", "near_n"])


def near_words(words: DataFrame, group_words: int = GROUP_WORDS) -> DataFrame:
    """words (word, n; distinct, of Latin-1 letters): word, n, n_near, near, near_n; near is the near word of largest n."""
    rows = _bounded(_segments(words), group_words)
    total = words.agg(F.count("*").alias("n"), F.sum(F.length("word")).alias("chars")).first()
    tasks = max(1, -(-4 * total.n // TASK_WORDS), -(-4 * (total.chars or 0) // TASK_CHARS))
    met = rows.repartition(tasks, "key").select("word", "n", "k", "a", "b").mapInArrow(_near, "word string, n_near long, near string, near_n long")
    best = met.groupBy("word").agg(F.sum("n_near").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), "near")).alias("best"))
    return words.join(best, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.col("best.near").alias("near"), (-F.col("best.less")).alias("near_n"))


def spelling_variants(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", ratio: int = RATIO, group_words: int = GROUP_WORDS, **rule: int) -> DataFrame:
    """word, form, root, n, n_near, form_n: a word's form is its most frequent near word, if ``ratio`` times as frequent; forms lead to the root."""
    words = durable(vocabulary(df, id_col, text_col, **rule))
    formed = F.col("near_n") >= ratio * F.col("n")
    out = durable(near_words(words, group_words).select("word", "n", "n_near", F.when(formed, F.col("near")).alias("form"), F.when(formed, F.col("near_n")).alias("form_n")))
    links = durable(out.where("form is not null").select("word", F.col("form").alias("root")))
    chain, most = 0, out.agg(F.max("n")).first()[0] or 0
    while most >= ratio ** (chain + 1) * 2:  # each link multiplies n by the ratio at least
        chain += 1
    while chain > 1:  # each round follows twice as many links
        further = links.select(F.col("word").alias("root"), F.col("root").alias("further"))
        links, chain = durable(links.join(further, "root", "left").select("word", F.coalesce("further", "root").alias("root"))), -(-chain // 2)
    return out.join(links, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_variants(read(spark, sf_dir, "documents"))


#: The checksum is computed bit by bit, since DuckDB has no crc32.
OP11_SQL = r"""
with recursive d as (
  select coalesce(cast(doc_id as varchar), '') as id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z\x{C0}-\x{FF}]+')) as run from documents
), g as (select id, run, count(*) as n from d where length(run) >= 7 group by all
), b as (select *, hex(encode(id || ':' || run)) as bytes from g
), bits as (
  select id, run, n, flatten(list_transform(range(1, length(bytes), 2), lambda i: list_transform(range(0, 8), lambda j: (cast('0x' || bytes[i:i + 1] as bigint) >> j) & 1))) as bits from b
), crc as (
  select id, run, n, xor(list_reduce(list_prepend(4294967295::bigint, bits), lambda c, x: xor(c >> 1, 3988292384::bigint * (xor(c, x) & 1))), 4294967295::bigint) as h from bits
), w as (
  select case when h % 31 = 0 then substr(run, 1, (h % length(run))::int) || substr(run, (h % length(run))::int + 2) else run end as word, sum(n)::bigint as n from crc group by 1
), v as (select word, n from w where n >= 2 and length(word) >= 7
), del as (select word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) as rest from (select word, n, unnest(range(1, length(word) + 1)) as i from v)
), near as (
  select x.word, y.word as near, y.n as near_n from del x join del y on x.i = y.i and x.rest = y.rest and x.word <> y.word
  union select x.word, y.word, y.n from del x join v y on x.rest = y.word
  union select y.word, x.word, x.n from del x join v y on x.rest = y.word
), best as (select word, count(*) as n_near, first(near order by near_n desc, near) as near, max(near_n) as near_n from near group by word
), f as (
  select word, n, coalesce(n_near, 0) as n_near, case when near_n >= 10 * n then near end as form, case when near_n >= 10 * n then near_n end as form_n from v left join best using (word)
), walk as (
  select word, word as root, form as further from f
  union all select walk.word, f.word, f.form from walk join f on walk.further = f.word
)
select f.word, f.form, walk.root, f.n, f.n_near::bigint as n_near, f.form_n from f join walk on f.word = walk.word where walk.further is null
"""
