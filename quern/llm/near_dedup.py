"""Near-duplicate classes by Order MinHash.

A text's k-mers are its shingles of five words, labelled with their occurrence. Each of ``FUNCTIONS`` hash
functions picks the ``TUPLE`` smallest and keeps them in text order; texts with an equal tuple are candidates.
Texts with the same words are one node. In a bucket every member is first paired with the smallest and the
largest id there. Pairs are verified by a banded alignment of their words: similarity = L / (na + nb - L) with L
the aligned words, which is the Jaccard similarity of the words where order is kept (an edit similarity). Shingles
that both texts have once are the alignment's fixed points as far as they keep their order; between them words
are aligned within the band that the threshold leaves. Verified links make classes (alternating star contraction).
Buckets that then hold several classes pair their members, ``ROUNDS`` times, with two others: the one that has most
links so far and one picked by a hash. Where the members are still not all of one class (unrelated texts with a shared
passage), they meet once more by the ``RARE`` rarest shingles that each has in common with any other, which are of its own
part, and all of them are compared by an exact prefix-filter join: every pair from different classes whose shingles'
Jaccard similarity reaches the threshold is verified too, so no such pair of a bucket is left out.

Chance that a pair shares no tuple, by the Jaccard similarity of the shingles: 0.8: 2 in 10 billion; 0.6: 2 in 100,000;
0.45 (one word of twelve exchanged): 0.5 %; 0.38 (the least that evenly spread exchanges leave of an edit similarity of
0.8): 2.5 %. Texts of under twenty words keep few shingles after an edit and are found less often.

Defined results: words are those of the benchmark rule; a text of one to four words is one shingle; null
texts and texts without words belong to no group (each is its own class); a class is named by its smallest
id; copies with the same words share a class; rows that repeat id and words share a class and the first of
them is kept; a row with a null id joins the class of its exact copies or has none (null) and is kept only
there where no copy has an id; an empty table gives no rows.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Callable, Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import col, durable, packed, read, scratch, small_enough, unpacked

SHINGLE, SIMILARITY = 5, 0.8
FUNCTIONS, TUPLE = 24, 2
#: Times that buckets of several classes are paired with further members before the exact join.
ROUNDS = 2
#: Rarest shingles of a text by which members of such buckets meet once more.
RARE = 24
#: Words of a stretch without fixed points that are aligned at once; longer ones are cut along the diagonal.
STRETCH = 4_096
#: Partners of a text that meet it in one task; the pairs of a text with more are salted.
PARTNERS = 1_000
#: Ids (8 bytes each) that are broadcast to pick texts for verification or to drop rows; beyond it, shuffled joins.
BROADCAST_IDS = 1_000_000
#: Cells that shingles are counted in to order them by rarity; any order gives the same pairs.
CELL_BITS = 18
#: Bytes of text that are tokenised at once.
SLICE_BYTES = 1 << 19

_R = np.uint64(0x9E3779B97F4A7C15)
_R_INV = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_LOW = np.arange(256, dtype=np.uint8)
_LOW[65:91] += 32
_IS_WORD = np.zeros(256, bool)
_IS_WORD[48:58] = _IS_WORD[65:91] = _IS_WORD[97:123] = _IS_WORD[128:] = True
_MULTIPLIERS = np.random.default_rng(20).integers(1, 1 << 63, FUNCTIONS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_SKETCH = "id bigint, text_key bigint, rid bigint, words_key binary, n int, sketch array<bigint>"


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xFF51AFD7ED558CCD)
    return x ^ (x >> np.uint64(32))


def _powers(n: int, base: np.uint64) -> np.ndarray:
    return np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(n, base, np.uint64)]))


class Tokens:
    """Hashes of the words of many texts at once, from their UTF-8 bytes."""

    def __init__(self) -> None:
        self.pow = self.inv = np.ones(1, np.uint64)

    def words(self, data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """data: bytes of texts back to back, ``ends`` where each stops. Word hashes and each text's end among them."""
        n = len(data)
        if len(self.pow) <= n:
            self.pow, self.inv = _powers(n, _R), _powers(n, _R_INV)
        word = np.concatenate([_IS_WORD[data], [False]])
        first = word.copy()
        first[1:] &= ~word[:-1]
        cuts = ends[(ends > 0) & (ends < n)]
        first[cuts] = word[cuts]  # a text's first byte begins a word even right after another text's word
        starts = np.flatnonzero(first)
        last = word.copy()
        last[:-1] &= ~word[1:]
        last[cuts - 1] = word[cuts - 1]
        stops = np.flatnonzero(last) + 1
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_LOW[data].astype(np.uint64) * self.pow[:n], dtype=np.uint64)])
        return _mix((total[stops] - total[starts]) * self.inv[starts]), np.searchsorted(starts, ends)


def shingles(words: np.ndarray) -> np.ndarray:
    """Hashes of all runs of five words; of all words if there are fewer; empty if there is none."""
    k = min(len(words), SHINGLE)
    if not k:
        return words
    n = len(words) - k + 1
    out = np.full(n, np.uint64(k))
    for i in range(k):
        out = (out ^ words[i : i + n]) * _R
        out ^= out >> np.uint64(31)
    return _mix(out)


def _labelled(s: np.ndarray) -> np.ndarray:
    """Shingle hashes mixed with the number of earlier occurrences."""
    order = np.argsort(s, kind="stable")
    new = np.ones(len(s), bool)
    new[1:] = s[order[1:]] != s[order[:-1]]
    if new.all():
        return s
    at = np.arange(len(s))
    occurrence = np.empty(len(s), np.uint64)
    occurrence[order] = (at - np.maximum.accumulate(np.where(new, at, 0))).astype(np.uint64)
    return np.where(occurrence > 0, _mix(s + occurrence * _R), s)


def _tuples(x: np.ndarray, size: int) -> np.ndarray:
    """For each function the hash of its ``size`` smallest of x, in text order."""
    tag = np.arange(FUNCTIONS, dtype=np.uint64) + np.uint64(1000 * size)
    step = max(1, (1 << 21) // len(x))  # long texts: a few functions at a time
    picked = []
    for i in range(0, FUNCTIONS, step):
        h = x[None, :] * _MULTIPLIERS[i : i + step, None]
        at = np.argpartition(h, size - 1, axis=1)[:, :size]
        at.sort(axis=1)
        picked.append(x[at])
    chosen = np.concatenate(picked)
    out = _mix(tag)
    for j in range(size):
        out = _mix((out ^ chosen[:, j]) * _R)
    return out


def sketch(s: np.ndarray) -> np.ndarray:
    """Bucket keys of a text's shingles; a text of fewer than ``TUPLE`` is looked up by all it has."""
    if not len(s):
        return np.empty(0, np.int64)
    return _tuples(_labelled(s), min(TUPLE, len(s))).view(np.int64)


def _slices(texts: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """First row, bytes and text ends of runs of rows of about ``SLICE_BYTES``; a longer text is one run."""
    texts = texts.cast(pa.large_binary()).fill_null(b"")
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
    at = 0
    while at < len(texts):
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + SLICE_BYTES, side="right")) - 1)
        yield at, data[offsets[at] : offsets[to]], offsets[at + 1 : to + 1] - offsets[at]
        at = to


def _word_lists(texts: pa.Array, tokens: Tokens) -> list[np.ndarray]:
    out = []
    for _, data, ends in _slices(texts):
        w, stops = tokens.words(data, ends)
        out += np.split(w, stops[:-1])
    return out


def _sketches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    tokens = Tokens()
    for batch in batches:
        keys, counts, rows, lengths = [], [], [], [0]
        for words in _word_lists(batch.column("text"), tokens):
            s = shingles(words)
            k = sketch(s)
            keys.append(blake2b(words.tobytes(), digest_size=16).digest() if len(words) else None)
            counts.append(len(s))
            rows.append(k)
            lengths.append(len(k))
        values = np.concatenate(rows) if rows else np.empty(0, np.int64)
        lists = pa.ListArray.from_arrays(pa.array(np.cumsum(lengths), pa.int32()), pa.array(values, pa.int64()))
        yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("text_key"), batch.column("rid"), pa.array(keys, pa.binary()), pa.array(counts, pa.int32()), lists], names=["id", "text_key", "rid", "words_key", "n", "sketch"])


def _common(a: list[int], b: list[int], band: int) -> int:
    """Longest common subsequence of matches within ``band`` places of the diagonal: a row a step, its cells the bits of one number."""
    at: dict[int, int] = {}
    for j, w in enumerate(b):
        at[w] = at.get(w, 0) | 1 << j
    full = (1 << len(b)) - 1
    row, near = full, (1 << (2 * band + 1)) - 1
    for i, w in enumerate(a):
        m = at.get(w, 0) & (near << (i - band) if i >= band else near >> (band - i))
        if m:
            hit = row & m
            row = ((row + hit) | (row ^ hit)) & full
    return len(b) - row.bit_count()


def _increasing(x: np.ndarray) -> np.ndarray:
    """Places of a longest increasing subsequence of different numbers."""
    if (np.diff(x) > 0).all():
        return np.arange(len(x))
    ends: list[int] = []
    last: list[int] = []
    before = np.full(len(x), -1)
    for i, v in enumerate(x.tolist()):
        k = bisect_left(ends, v)
        if k:
            before[i] = last[k - 1]
        if k == len(ends):
            ends.append(v)
            last.append(i)
        else:
            ends[k], last[k] = v, i
    out = [last[-1]]
    while before[out[-1]] >= 0:
        out.append(before[out[-1]])
    return np.array(out[::-1])


def _stretches(a: np.ndarray, b: np.ndarray) -> tuple[int, list[tuple[int, int, int, int]]]:
    """Words that lie in fixed points, and the stretches (from, to in a; from, to in b) between these."""
    k = SHINGLE if min(len(a), len(b)) >= SHINGLE else 1
    (ua, ia, ca), (ub, ib, cb) = (np.unique(shingles(x) if k > 1 else x, return_index=True, return_counts=True) for x in (a, b))
    _, i, j = np.intersect1d(ua[ca == 1], ub[cb == 1], assume_unique=True, return_indices=True)
    i, j = ia[ca == 1][i], ib[cb == 1][j]
    order = np.argsort(i)
    i, j = i[order], j[order]
    fixed, out, p, q = 0, [], 0, 0
    if len(i):
        chain = _increasing(j)
        i, j = i[chain], j[chain]
        cut = np.flatnonzero((np.diff(i) > k) | (np.diff(i) != np.diff(j))) + 1
        for first, last in zip(np.concatenate([[0], cut]).tolist(), np.concatenate([cut, [len(i)]]).tolist(), strict=True):
            skip = max(0, p - int(i[first]), q - int(j[first]))
            x, y, to = int(i[first]) + skip, int(j[first]) + skip, int(i[last - 1]) + k
            if x >= to:
                continue
            out.append((p, x, q, y))
            fixed += to - x
            p, q = to, y + to - x
    out.append((p, len(a), q, len(b)))
    return fixed, [s for s in out if s[1] > s[0] and s[3] > s[2]]


def similarity(a: np.ndarray, b: np.ndarray, least: float = SIMILARITY) -> float:
    """Aligned similarity of two texts' words if it reaches ``least``, else an upper bound below it."""
    total = len(a) + len(b)
    if not len(a) or not len(b):
        return 0.0
    needed = int(np.ceil(least * total / (1 + least) - 1e-9))
    if min(len(a), len(b)) < needed:
        return min(len(a), len(b)) / max(len(a), len(b))
    found, between = _stretches(a, b)
    held = [_bound(a[p:x], b[q:y]) for p, x, q, y in between]
    most = found + sum(held)
    band = total - 2 * needed
    for (p, x, q, y), bound in zip(between, held, strict=True):
        if most < needed:
            break
        parts = 1 + max(x - p, y - q) // STRETCH
        cuts = [(p + (x - p) * k // parts, q + (y - q) * k // parts) for k in range(parts + 1)]
        most -= bound - sum(_common(a[i:u].tolist(), b[j:v].tolist(), min(band, u - i + v - j)) for (i, j), (u, v) in zip(cuts, cuts[1:], strict=False) if bound)
    return most / (total - most)


def _bound(a: np.ndarray, b: np.ndarray) -> int:
    """Words that two stretches have in common, in any order."""
    if len(a) == 1 or len(b) == 1:
        return int(np.isin(a, b).any())
    (ua, ca), (ub, cb) = np.unique(a, return_counts=True), np.unique(b, return_counts=True)
    _, i, j = np.intersect1d(ua, ub, assume_unique=True, return_indices=True)
    return int(np.minimum(ca[i], cb[j]).sum())


def _verify(least: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = Tokens()
        for batch in batches:
            pairs = zip(_word_lists(batch.column("text_a"), tokens), _word_lists(batch.column("text_b"), tokens), strict=True)
            found = np.array([similarity(x, y, least) for x, y in pairs], float)
            good = pa.array(found >= least, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column("a").filter(good), batch.column("b").filter(good), pa.array(found, pa.float64()).filter(good)], names=["a", "b", "similarity"])

    return run


def components(edges: DataFrame, keep: Callable[[DataFrame], DataFrame] = durable) -> DataFrame:
    """(node, root) of every node of ``edges`` (a, b) but the roots: root is the smallest node it is connected to.

    Large-star and small-star steps alternate until the edges are stars; each step is computed by ``keep``.
    """
    tidy = lambda e: keep(e.where("u > v").distinct())
    e = tidy(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")))
    while True:
        ends = keep(e.groupBy("u").agg(F.min("v").alias("v"), (F.min("v") < F.max("v")).alias("several")))
        # stars: everyone has one smaller neighbour, and that has none
        if ends.where("several").isEmpty() and ends.select("u").join(ends.select(F.col("v").alias("u")), "u", "left_semi").isEmpty():
            return ends.select(F.col("u").alias("node"), F.col("v").alias("root"))
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = tidy(both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")))
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        e = tidy(large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v"))))


def _text_key(text_col: str):
    return F.xxhash64(F.coalesce(col(text_col), F.lit("")))


def bucket_rows(nodes: DataFrame) -> DataFrame:
    """nodes: (id, n, sketch, and others). A row per node and bucket."""
    return nodes.withColumn("key", F.explode(F.array_distinct("sketch"))).drop("sketch")


def candidate_pairs(rows: DataFrame, least: float = SIMILARITY) -> DataFrame:
    """rows: (key, id, n). Distinct pairs a < b of every bucket's members with its smallest and its largest id, of such lengths that they can reach ``least``."""
    members = rows.select("key", F.struct("id", "n").alias("m"))
    ends = members.groupBy("key").agg(F.min("m").alias("lo"), F.max("m").alias("hi")).where("lo.id < hi.id")
    return _near_pairs(members.join(ends, "key").select("m", F.explode(F.array("lo", "hi")).alias("e")).where("m.id != e.id"), least)


def further_pairs(rows: DataFrame, first: Column, last: Column, least: float = SIMILARITY) -> DataFrame:
    """rows: (key, id, n, root, degree). The same with the least member by ``first`` and the greatest by ``last``, of different classes only."""
    members = rows.select("key", F.struct("id", "n", "root").alias("m"), F.struct(first, "id").alias("first"), F.struct(last, "id").alias("last"))
    ends = members.groupBy("key").agg(F.min_by("m", "first").alias("lo"), F.max_by("m", "last").alias("hi"))
    return _near_pairs(members.join(ends, "key").select("m", F.explode(F.array("lo", "hi")).alias("e")).where("m.root != e.root"), least)


def _near_pairs(sides: DataFrame, least: float) -> DataFrame:
    words = lambda x: F.col(x) + F.lit(SHINGLE - 1)
    near = F.least(words("m.n"), words("e.n")) >= F.greatest(words("m.n"), words("e.n")) * F.lit(least)
    return sides.where(near).select(F.least("m.id", "e.id").alias("a"), F.greatest("m.id", "e.id").alias("b")).distinct()


def _with_text(pairs: DataFrame, side: str, texts: DataFrame, many: DataFrame) -> DataFrame:
    """pairs with the text of their ``side``. many: (id, parts) of texts with more than ``PARTNERS``; their pairs are dealt to several tasks, each with a copy of the text."""
    dealt = pairs.join(many.withColumnRenamed("id", side), side, "left").withColumn("salt", F.pmod(F.xxhash64("a", "b"), F.coalesce("parts", F.lit(1))).cast("int")).drop("parts")
    copies = texts.join(many, "id", "left").withColumn("salt", F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1)))
    return dealt.join(copies.select(F.col("id").alias(side), "salt", F.col("text").alias(f"text_{side}")), [side, "salt"]).drop("salt")


def verified_links(pairs: DataFrame, docs: DataFrame, id_col: str, text_col: str, least: float = SIMILARITY, keep: Callable[[DataFrame], DataFrame] = durable) -> DataFrame:
    """pairs: (a, b), computed. Those (a, b, similarity) that their texts' alignment confirms."""
    needed = keep(pairs.select(F.explode(F.array("a", "b")).alias("id")).groupBy("id").agg(F.ceil(F.count("*") / PARTNERS).cast("int").alias("parts")))
    side = F.broadcast(needed) if small_enough(needed, BROADCAST_IDS) else needed
    texts = docs.select(col(id_col).cast("bigint").alias("id"), col(text_col).cast("string").alias("text")).join(side.select("id"), "id", "left_semi")
    many = needed.where("parts > 1")
    many = F.broadcast(many) if small_enough(many, BROADCAST_IDS) else many
    joined = _with_text(_with_text(pairs, "a", texts, many), "b", texts, many)
    return joined.select("a", "b", "text_a", "text_b").mapInArrow(_verify(least), "a bigint, b bigint, similarity double")


def open_rows(rows: DataFrame, roots: DataFrame, keep: Callable[[DataFrame], DataFrame] = durable) -> DataFrame:
    """rows: (key, id, n), roots: (node, root, degree). (key, id, n, root, degree) of the members of buckets that hold several classes, computed."""
    rooted = rows.select("key", "id", "n").join(roots, F.col("id") == F.col("node"), "left").select("key", "id", "n", F.coalesce("root", "id").alias("root"), F.coalesce("degree", F.lit(0)).alias("degree"))
    mixed = keep(rooted.groupBy("key").agg((F.min("root") < F.max("root")).alias("several"), F.count("*").alias("m")).where("several and m > 3").select("key"))
    return keep(rooted.join(F.broadcast(mixed) if small_enough(mixed, BROADCAST_IDS) else mixed, "key", "left_semi"))


def _cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    tokens, total = Tokens(), np.zeros(1 << CELL_BITS, np.int64)
    for batch in batches:
        found = [_labelled(shingles(words)) >> np.uint64(64 - CELL_BITS) for words in _word_lists(batch.column("text"), tokens)]
        total += np.bincount(np.concatenate([np.empty(0, np.int64), *[c.astype(np.int64) for c in found]]), minlength=len(total))
    cells = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(cells, pa.int64()), pa.array(total[cells], pa.int64())], names=["cell", "n"])


def _cell_counts(texts: DataFrame) -> np.ndarray:
    """Labelled shingles of the texts, counted in ``1 << CELL_BITS`` cells whatever their number."""
    counts = np.zeros(1 << CELL_BITS, np.int64)
    for r in texts.select("text").mapInArrow(_cells, "cell bigint, n bigint").groupBy("cell").agg(F.sum("n").alias("n")).toArrow().to_batches():
        counts[r.column("cell").to_numpy()] = r.column("n").to_numpy()
    return counts


def _rarest(counts: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = Tokens()
        for batch in batches:
            keys, held, sizes = [np.empty(0, np.uint64)], [], []
            for words in _word_lists(batch.column("text"), tokens):
                x = _labelled(shingles(words))
                c = counts[(x >> np.uint64(64 - CELL_BITS)).astype(np.int64)]
                sizes.append(len(x))
                x, c = x[c > 1], c[c > 1]
                keys.append(x[np.lexsort((x, c))[:RARE]])
                held.append(len(keys[-1]))
            rows = np.repeat(np.arange(len(held)), np.array(held, np.int64))
            at = pa.array(rows)
            columns = [pa.array(np.concatenate(keys).view(np.int64), pa.int64()), batch.column("id").take(at), pa.array(np.array(sizes, np.int32)[rows]), batch.column("root").take(at)]
            yield pa.RecordBatch.from_arrays(columns, names=["key", "id", "n", "root"])

    return run


def rare_rows(texts: DataFrame, counts: np.ndarray) -> DataFrame:
    """texts: (id, root, text). (key, id, n, root) of each text's ``RARE`` rarest shingles that another text may have too.

    What a family shares comes last in that order, so these are of the texts' own parts, and what only one text has
    (its edits) is left out: near copies keep most of them in common however long the shared part is.
    """
    return texts.select("id", "root", "text").mapInArrow(_rarest(counts), "key bigint, id bigint, n int, root bigint")


def _prefixes(counts: np.ndarray, least: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = Tokens()
        for batch in batches:
            rare, lengths, shorter = [np.empty(0, np.uint64)], [], []
            for words in _word_lists(batch.column("text"), tokens):
                x = _labelled(shingles(words))
                n = len(x)
                taken = n - int(np.ceil(least * n - 1e-9)) + 1 if n else 0
                order = np.lexsort((x, counts[(x >> np.uint64(64 - CELL_BITS)).astype(np.int64)]))[:taken]
                rare.append(x[order])
                lengths.append((n, len(order)))
                shorter.append(n - int(np.ceil(2 * least / (1 + least) * n - 1e-9)) + 1)
            held = np.array([k for _, k in lengths], np.int64)
            rows = np.repeat(np.arange(len(held)), held)
            at = np.arange(len(rows)) - np.repeat(np.cumsum(held) - held, held)
            n = np.array([n for n, _ in lengths], np.int64)[rows]
            short = at < np.array(shorter, np.int64)[rows]
            columns = [pa.array(np.concatenate(rare).view(np.int64), pa.int64()), batch.column("id").take(pa.array(rows)), batch.column("root").take(pa.array(rows)), pa.array(n), pa.array(at), pa.array(short)]
            yield pa.RecordBatch.from_arrays(columns, names=["shingle", "id", "root", "n", "at", "short"])

    return run


def member_texts(members: DataFrame, docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """members: (id, root), computed. (id, root, text)."""
    side = F.broadcast(members) if small_enough(members, BROADCAST_IDS) else members
    return docs.select(col(id_col).cast("bigint").alias("id"), col(text_col).cast("string").alias("text")).join(side, "id")


def exact_pairs(texts: DataFrame, counts: np.ndarray, least: float = SIMILARITY, keep: Callable[[DataFrame], DataFrame] = durable) -> DataFrame:
    """texts: (id, root, text), counts: of their shingles' cells. Distinct pairs a < b of different roots, among them all whose shingles' similarity reaches ``least``.

    Prefix filter: shingles are ordered by rarity. Of two texts that reach ``least`` the longer one's first
    n - least * n + 1 and the shorter one's first n - 2 * least / (1 + least) * n + 1 have one in common, and at
    the first common one enough shingles are left on both sides. Texts of one root never meet.
    """
    entries = keep(texts.select("id", "root", "text").mapInArrow(_prefixes(counts, least), "shingle bigint, id bigint, root bigint, n bigint, at bigint, short boolean"))
    shared = entries.groupBy("shingle").agg((F.min("root") < F.max("root")).alias("several"), F.max("short").alias("short")).where("several and short").select("shingle")
    sets = entries.join(shared, "shingle", "left_semi").groupBy("shingle", "root").agg(F.collect_list(F.struct("n", "id", "at", "short")).alias("members"))
    one = sets.select("shingle", F.col("root").alias("root_x"), F.explode(F.filter("members", lambda m: m.short)).alias("x"))
    needed = lambda y: F.ceil((F.col("x.n") + y.n) * F.lit(least / (1 + least)) - F.lit(1e-9))
    longer = lambda y: (F.struct(y.n, y.id) > F.struct("x.n", "x.id")) & (F.least(F.col("x.n") - F.col("x.at"), y.n - y["at"]) >= needed(y))
    met = one.join(sets, "shingle").where("root != root_x").select("x", F.explode(F.filter("members", longer)).alias("y"))
    return met.select(F.least("x.id", "y.id").alias("a"), F.greatest("x.id", "y.id").alias("b")).distinct()


def _joined(roots: DataFrame, links: DataFrame, keep: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """roots: (node, root), links: (a, b), both computed. The roots with the links, computed."""
    end = lambda c: links.join(roots.select(F.col("node").alias(c), F.col("root").alias(f"root_{c}")), c, "left").select(*links.columns, F.coalesce(f"root_{c}", c).alias(f"of_{c}"))
    between = end("a").join(end("b"), ["a", "b"]).select(F.col("of_a").alias("a"), F.col("of_b").alias("b"))
    with scratch(roots.sparkSession) as step:
        merged = keep(components(between, step))
    of = merged.select(F.col("node").alias("root"), F.col("root").alias("now"))
    new = merged.join(roots.select("root").distinct().withColumnRenamed("root", "node"), "node", "left_anti")
    return keep(roots.join(of, "root", "left").select("node", F.coalesce("now", "root").alias("root")).unionByName(new.select("node", "root")))


def _roots(nodes: DataFrame, df: DataFrame, id_col: str, text_col: str, keep: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """nodes: (id, n, sketch), computed. (node, root) of every linked node."""

    def verified(pairs: DataFrame) -> DataFrame:
        return keep(verified_links(keep(pairs), df, id_col, text_col, keep=keep).select("a", "b"))

    def counted(roots: DataFrame, links: DataFrame) -> DataFrame:
        degrees = links.select(F.explode(F.array("a", "b")).alias("node")).groupBy("node").agg(F.count("*").alias("degree"))
        return keep(degrees.join(roots, "node", "left").select("node", F.coalesce("root", "node").alias("root"), "degree"))

    links = verified(candidate_pairs(bucket_rows(nodes)))
    with scratch(df.sparkSession) as step:
        roots = counted(components(links, step), links)
    rows, new = open_rows(bucket_rows(nodes), roots, keep), None
    for a_round in range(ROUNDS):
        if new is not None:
            links = keep(links.unionByName(new))
            roots = counted(_joined(roots, new, keep), links)
            rows = open_rows(rows, roots, keep)
        new = verified(further_pairs(rows, -F.col("degree"), F.xxhash64("key", "id", F.lit(a_round))))
        if new.isEmpty():
            break
    # the last round's links join the classes together with those by rare shingles and of the exact join
    members = keep(rows.select("id", "root").distinct())
    if not members.isEmpty():
        texts = member_texts(members, df, id_col, text_col)
        counts = _cell_counts(texts)
        by_hash = F.xxhash64("key", "id")
        rare = further_pairs(keep(rare_rows(texts, counts)), by_hash, by_hash)
        new = keep(new.unionByName(verified(rare.unionByName(exact_pairs(texts, counts, keep=keep)).distinct())).distinct())
    return roots if new.isEmpty() else _joined(roots, new, keep)


def _classes(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, text_key, rid, class_id, kept) per row, computed once."""
    docs = df.select(col(id_col).cast("bigint").alias("id"), _text_key(text_col).alias("text_key"), F.monotonically_increasing_id().alias("rid"), col(text_col).cast("string").alias("text"))
    with scratch(df.sparkSession) as keep:
        base = keep(docs.mapInArrow(_sketches, _SKETCH))
        wordy = base.where("words_key is not null")
        node = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "rid")).alias("first")
        nodes = keep(wordy.groupBy("words_key").agg(node, F.first("n").alias("n"), F.first("sketch").alias("sketch")).select("words_key", F.col("first.id").alias("node"), F.col("first.rid").alias("first_rid"), "n", "sketch"))
        roots = _roots(nodes.where("node is not null").select(F.col("node").alias("id"), "n", "sketch"), df, id_col, text_col, keep).withColumnRenamed("node", "linked")
        classes = keep(nodes.join(roots, F.col("node") == F.col("linked"), "left").select("words_key", "node", "first_rid", F.coalesce("root", "node").alias("class_id")))
        grouped = wordy.join(classes, "words_key").select("id", "text_key", "rid", "class_id", (F.col("node").eqNullSafe(F.col("class_id")) & (F.col("rid") == F.col("first_rid"))).alias("kept"))
        return durable(grouped.unionByName(base.where("words_key is null").select("id", "text_key", "rid", F.col("id").alias("class_id"), F.lit(True).alias("kept"))))


def near_duplicate_classes(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, class_id (the smallest id of its group) and kept (one row of each group)."""
    return _classes(df, id_col, text_col).select(F.col("id").alias(id_col), "class_id", "kept")


def drop_near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One document of each group, with all its columns."""
    found = _classes(df, id_col, text_col)
    key = ["id", "text_key"]
    states = found.groupBy(*key).agg(F.max(F.col("kept").cast("int")).alias("k"), F.count("*").alias("n"))
    odd = durable(states.where("k = 0 or n > 1").withColumn("found", F.lit(True)))
    side = F.broadcast(odd) if small_enough(odd, BROADCAST_IDS) else odd
    rows = df.select(packed(df), col(id_col).cast("bigint").alias("id"), _text_key(text_col).alias("text_key")).alias("r")
    met = rows.join(side.alias("o"), (F.col("r.text_key") == F.col("o.text_key")) & F.col("r.id").eqNullSafe(F.col("o.id")), "left").select("row", "r.id", "r.text_key", "o.k", "o.found")
    single = met.where("found is null").select("row")
    # rows that repeat id and text: one of them stays
    first = W.partitionBy("id", "text_key").orderBy(F.xxhash64("row"))
    again = met.where("k = 1").withColumn("rn", F.row_number().over(first)).where("rn = 1").select("row")
    return unpacked(single.unionByName(again), df.columns)


def op5_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicate_classes(read(spark, sf_dir, "documents"))
