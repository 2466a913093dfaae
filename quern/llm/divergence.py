"""Source divergence audit: how the words of each source of a language differ from those of its other sources and of the language.

Two passes over the texts. The first counts in how many documents of a language each term stands; those with enough are
kept. The second counts the kept terms' occurrences by automata (pyahocorasick) of the terms padded with the delimiter,
over texts whose gaps are one delimiter. The most frequent terms of all languages, of bounded number and length, form the
automata that are broadcast. What these leave of the texts is dealt by the checksum of its terms to shards,
where it meets the other kept terms, a bounded number of them at a time; a shard with much text is spread over salts. So no
automaton grows with the corpus, each text is scanned once and only what is rare moves.

Occurrences become postings (language, term, source, n), of which there is none where a source lacks a term. Pairs of
sources are summed from them by tiles of source blocks and term buckets: with f0 the value of a term that both lack,
V * f0 for all terms, corrected for the terms that one has (by its distinct counts) and for those that both have.

Defined results: null text, language and source are ''; every row counts, repeated ones too; texts and terms of any length
count whole; a language without kept terms has pairs of value 0 and no terms; values that tie are ranked by item; an
empty table gives no rows; other columns are never looked at. Exact up to 9e13 occurrences in a language.
"""

from __future__ import annotations

import uuid
import zlib
from collections import Counter, defaultdict
from collections.abc import Iterator
from itertools import chain

import ahocorasick
import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import col, delete, durable, read, shared_dir, small_enough

MIN_DOCS, TOP_TERMS, SCALE = 3, 200, 1_000_000_000
#: Terms of the broadcast automata and their longest; code points of a shard's terms, of a salt's text and of texts scanned together; matches and terms counted together.
HEAD_TERMS, HEAD_LENGTH, SHARD_CHARS, SALT_CHARS, TEXT_CHARS, MATCHES, TERMS = 150_000, 64, 1_500_000, 16_000_000, 8_000_000, 6_000_000, 400_000
#: Sources of a block, postings of a tile, groups that are broadcast.
BLOCK, TILE_ROWS, BROADCAST_GROUPS, PAIRS = 256, 200_000, 200_000, 1_000_000
_SCAN = "lang string, source string, term string, n long, shard int, text string, tail boolean"
#: To one delimiter, or lower case; what isn't ASCII stays.
_TABLE = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c > 127 else 32 for c in range(256))


def kept_terms(docs: DataFrame, min_docs: int = MIN_DOCS) -> DataFrame:
    """docs (lang, source, text): (lang, term, df) of the terms that stand in enough documents of their language."""
    found = docs.select("lang", "text").mapInArrow(_documents, "lang string, term string, df long")
    return found.groupBy("lang", "term").agg(F.sum("df").alias("df")).where(F.col("df") >= min_docs)


def _clean(text: str) -> bytes:
    """Terms with one delimiter between; what is white space beyond ASCII belongs to terms."""
    return b" ".join(text.encode().translate(_TABLE).split())


def _documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, term, df): in how many texts of a task each term stands, given out whenever there are many terms."""
    met: dict[str, Counter] = defaultdict(Counter)

    def flush() -> Iterator[pa.RecordBatch]:
        for lang, df in met.items():
            yield pa.RecordBatch.from_arrays([pa.repeat(pa.scalar(lang), len(df)), pa.array(df.keys(), pa.binary()).cast(pa.string()), pa.array(df.values(), pa.int64())], names=["lang", "term", "df"])
        met.clear()

    for batch in batches:
        for lang, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if words := set(_clean(text).split()):
                met[lang].update(words)
                if sum(map(len, met.values())) >= TERMS:
                    yield from flush()
    yield from flush()


class Automaton:
    """The padded terms of one language; counts of what it meets, and what it leaves."""

    def __init__(self, terms: list[str]):
        self.terms, self.lengths = pa.array(terms, pa.string()), np.array([len(t) + 2 for t in terms])
        self.found = ahocorasick.Automaton(ahocorasick.STORE_INTS)
        for i, t in enumerate(terms):
            self.found.add_word(f" {t} ", i)
        self.found.make_automaton()

    def scan(self, text: str) -> tuple[np.ndarray, list[str]]:
        """text: terms with one delimiter before, between and after. The terms that are met, by number, and the stretches between them, delimiter first."""
        end, term = np.fromiter(chain.from_iterable(self.found.iter(text)), dtype=np.int64).reshape(-1, 2).T
        starts, ends = np.append(end - self.lengths[term] + 1, len(text) - 1), np.append(0, end)
        gaps = np.flatnonzero(starts > ends)
        return term.astype(np.int32), [text[i:j] for i, j in zip(ends[gaps].tolist(), starts[gaps].tolist(), strict=True)]


class _Counts:
    """Occurrences by (lang, source), counted together now and then."""

    def __init__(self) -> None:
        self.met: dict[tuple[str, str], list[np.ndarray]] = defaultdict(list)
        self.size = 0

    def add(self, lang: str, source: str, terms: np.ndarray) -> None:
        self.met[lang, source].append(terms)
        self.size += len(terms) + 16

    def flush(self, automata: dict[str, Automaton]) -> Iterator[pa.RecordBatch]:
        for (lang, source), arrays in self.met.items():
            met = np.concatenate(arrays)
            if len(met):
                terms = automata[lang].terms
                if len(met) * 8 > len(terms):
                    n = np.bincount(met, minlength=len(terms))
                    number = np.flatnonzero(n)
                    n = n[number]
                else:
                    number, n = np.unique(met, return_counts=True)
                yield _rows(lang, source, terms.take(pa.array(number)), n)
        self.met.clear()
        self.size = 0


def _rows(lang: str, source: str, terms: pa.Array | None, n: np.ndarray | None, shard: list[int] | None = None, text: list[str] | None = None) -> pa.RecordBatch:
    size = len(terms if terms is not None else text)
    columns = [pa.repeat(pa.scalar(lang), size), pa.repeat(pa.scalar(source), size), terms if terms is not None else pa.nulls(size, pa.string())]
    columns += [pa.array(n, pa.int64()) if n is not None else pa.nulls(size, pa.int64()), pa.array(shard, pa.int32()) if shard else pa.nulls(size, pa.int32())]
    return pa.RecordBatch.from_arrays([*columns, pa.array(text, pa.string()) if text else pa.nulls(size, pa.string()), pa.repeat(pa.scalar(text is not None), size)], names="lang source term n shard text tail".split())


_built: dict[str, dict[str, Automaton]] = {}  # the broadcast automata of this worker


def _scan_head(head, name: str, shards: int):
    """Counts the broadcast terms in (lang, source, text); with shards, gives the rest of each text by shard."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if name not in _built:
            _built.clear()
            _built[name] = {lang: Automaton(terms.split("\n")) for lang, terms in head.value.items()}
        automata, counts = _built[name], _Counts()
        none = Automaton([" "])  # meets nothing: texts have no two delimiters together
        waiting: dict[tuple[str, str], list[bytes]] = defaultdict(list)
        chars = 0

        def drain() -> Iterator[pa.RecordBatch]:
            for (lang, source), texts in waiting.items():
                met, rest = automata.get(lang, none).scan(f" {b' '.join(texts).decode()} ")
                counts.add(lang, source, met)
                if shards and rest:
                    parts = defaultdict(list)
                    for t in "".join(rest)[1:].split(" "):
                        parts[zlib.crc32(t.encode()) % shards].append(t)
                    yield _rows(lang, source, None, None, list(parts), [f" {' '.join(p)} " for p in parts.values()])
                if counts.size >= MATCHES:
                    yield from counts.flush(automata)
            waiting.clear()

        for batch in batches:
            for lang, source, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if clean := _clean(text):
                    waiting[lang, source].append(clean)
                    chars += len(clean)
                if chars >= TEXT_CHARS:
                    yield from drain()
                    chars = 0
        yield from drain()
        yield from counts.flush(automata)

    return scan


def _scan_tail(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows in order of (shard, salt, lang), the terms before the texts: counts each shard's terms in its texts."""
    at, terms, automata, counts = None, [], {}, _Counts()
    for batch in batches:
        for shard, salt, lang, source, term, text in zip(*(batch[c].to_pylist() for c in "shard salt lang source term text".split()), strict=True):
            if (shard, salt, lang) != at:
                yield from counts.flush(automata)
                at, terms, automata = (shard, salt, lang), [], {}
            if text is None:
                terms.append(term)
            elif terms:
                automata = automata or {lang: Automaton(terms)}
                counts.add(lang, source, automata[lang].scan(text)[0])
                if counts.size >= MATCHES:
                    yield from counts.flush(automata)
    yield from counts.flush(automata)


def _tail_counts(scanned: DataFrame, tail: DataFrame, shards: int) -> DataFrame:
    """Occurrences of the terms that aren't broadcast: texts and terms meet by (shard, salt), the more salts the more text a shard has."""
    texts = scanned.where("tail")
    salts = durable(texts.groupBy("shard").agg(F.ceil(F.sum(F.length("text")) / SALT_CHARS).cast("int").alias("salts")))
    parts = salts.agg(F.sum("salts")).first()[0] or 1
    dealt = texts.join(F.broadcast(salts), "shard").select("shard", F.pmod(F.monotonically_increasing_id(), "salts").cast("int").alias("salt"), "lang", "source", "term", "text")
    terms = tail.select((F.crc32(F.col("term").cast("binary")) % shards).cast("int").alias("shard"), "lang", "term").join(F.broadcast(salts), "shard")
    terms = terms.select("shard", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), "lang", F.lit(None).cast("string").alias("source"), "term", F.lit(None).cast("string").alias("text"))
    together = dealt.unionByName(terms).repartition(2 * parts, "shard", "salt")
    # the order of texts doesn't matter, so that only their short keys are compared
    return together.sortWithinPartitions("shard", "salt", "lang", F.col("text").isNotNull()).mapInArrow(_scan_tail, _SCAN).select("lang", "source", "term", "n")


def postings(docs: DataFrame, kept: DataFrame, folder: str, head_terms: int = HEAD_TERMS, shard_chars: int = SHARD_CHARS) -> DataFrame:
    """(lang, term, source, n, total): occurrences of the kept terms by source and, as total, in their language; written below ``folder``."""
    spark = docs.sparkSession
    order = [F.desc("df"), F.asc("lang"), F.asc("term")]
    head = kept.where(F.length("term") <= HEAD_LENGTH).orderBy(*order).limit(head_terms).toArrow()  # bounded in number and length
    by_lang: dict[str, list[str]] = defaultdict(list)
    for lang, term in zip(head["lang"].to_pylist(), head["term"].to_pylist(), strict=True):
        by_lang[lang].append(term)
    tail = kept
    if head.num_rows:
        last = {c: F.lit(head[c][-1].as_py()) for c in ("df", "lang", "term")}
        within = (F.col("df") > last["df"]) | ((F.col("df") == last["df"]) & (F.struct("lang", "term") <= F.struct(last["lang"].alias("lang"), last["term"].alias("term"))))
        tail = kept.where((F.length("term") > HEAD_LENGTH) | ~within)
    shards = -(-(tail.agg(F.sum(F.length("term") + 2)).first()[0] or 0) // shard_chars)
    broadcast = spark.sparkContext.broadcast({lang: "\n".join(terms) for lang, terms in by_lang.items()})
    docs.select("lang", "source", "text").mapInArrow(_scan_head(broadcast, uuid.uuid4().hex, shards), _SCAN).write.partitionBy("tail").parquet(f"{folder}/scan")
    scanned = spark.read.schema(_SCAN).parquet(f"{folder}/scan")
    counts = scanned.where("not tail").select("lang", "source", "term", "n")
    if shards:
        counts = counts.unionByName(_tail_counts(scanned, tail, shards))
    summed = counts.repartition("lang", "term").groupBy("lang", "term", "source").agg(F.sum("n").alias("n"))
    summed.withColumn("total", F.sum("n").over(W.partitionBy("lang", "term"))).write.parquet(f"{folder}/postings")
    return spark.read.parquet(f"{folder}/postings")


def _p(n: str, of: str, terms: str) -> Column:
    """1 + floor(SCALE * (n + 1) / (of + terms)) by long division, so that nothing overflows."""
    m = f"greatest({of} + {terms}, 1L)"
    first, rest = f"(({n} + 1) div {m})", f"(({n} + 1) % {m})"
    high = f"({rest} * 100000L)"
    return F.expr(f"1L + {first} * {SCALE}L + ({high} div {m}) * 10000L + (({high} % {m}) * 10000L) div {m}")


def _f(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) * (p - q) // q


def _tile(rows: pd.DataFrame) -> pd.DataFrame:
    """rows (lang, lo, hi, source number, p0, term, p) of the sources of two blocks, each once without a term: for each ordered pair the sum of f over the bucket's terms that one has, less f0 for each."""
    has = rows.term.notna().to_numpy()
    sources = rows[~has].drop_duplicates("number").sort_values("number")
    number, p0 = sources.number.to_numpy(), sources.p0.to_numpy()
    block, m = number // BLOCK, len(number)
    both = np.not_equal.outer(block, block) if rows.lo.iat[0] != rows.hi.iat[0] else ~np.eye(m, dtype=bool)
    f0, out = _f(p0[:, None], p0[None, :]), np.zeros((m, m), dtype=np.int64)
    at, p = np.searchsorted(number, rows.number.to_numpy()[has]), rows.p.to_numpy()[has].astype(np.int64)
    pairs, times = np.unique(np.stack([at, p]), axis=1, return_counts=True)
    step = max(1, PAIRS // max(m, 1))
    for i in range(0, len(times), step):  # a term that one of two has
        g, pg, n = pairs[0, i : i + step], pairs[1, i : i + step, None], times[i : i + step, None]
        np.add.at(out, g, n * (_f(pg, p0[None, :]) - f0[g]))
        np.add.at(out.T, g, n * (_f(p0[None, :], pg) - f0.T[g]))
    term = pd.factorize(rows.term.to_numpy()[has])[0]
    order = np.argsort(term, kind="stable")
    at, p, term = at[order], p[order], term[order]
    first, size = np.unique(term, return_index=True, return_counts=True)[1:]
    start, k = np.repeat(first, size), np.repeat(size, size)
    cuts = np.searchsorted(np.cumsum(k), np.arange(PAIRS, int(k.sum()) + PAIRS, PAIRS)) if len(k) else []
    begin = 0
    for end in [*(int(c) + 1 for c in cuts)]:  # a term that both have: what was added for either goes, their own f comes
        s = slice(begin, min(end, len(k)))
        i = np.repeat(np.arange(s.start, s.stop), k[s])
        j = np.repeat(start[s], k[s]) + np.arange(len(i)) - np.repeat(np.cumsum(k[s]) - k[s], k[s])
        g, h, pg, ph = at[i], at[j], p[i], p[j]
        np.add.at(out, (g, h), _f(pg, ph) - _f(pg, p0[h]) - _f(p0[g], ph) + f0[g, h])
        begin = s.stop
    g, h = np.nonzero(both)
    return pd.DataFrame({"lang": rows.lang.iat[0], "g": number[g], "h": number[h], "part": out[g, h]})


def _pairs(posted: DataFrame, groups: DataFrame, side) -> DataFrame:
    """(lang, source, item, value) of all ordered pairs of different sources of a language."""
    sizes = groups.groupBy("lang").agg(F.count("*").alias("sources"), F.sum("postings").alias("postings"))
    blocks = F.ceil(F.col("sources") / BLOCK).cast("int")
    buckets = F.ceil(F.col("postings") * F.least(F.lit(1.0), 2 * BLOCK / F.col("sources")) / TILE_ROWS).cast("int")
    tiled = durable(groups.join(sizes.select("lang", blocks.alias("blocks"), F.greatest(buckets, F.lit(1)).alias("buckets")), "lang"))
    near = side(tiled)
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")
    rows = posted.join(near.drop("postings"), ["lang", "source"]).select("lang", "number", "p0", "term", _p("n", "of", "terms").alias("p"), F.pmod(F.xxhash64("term"), "buckets").alias("bucket"), other)
    bare = tiled.select("lang", "number", "p0", F.lit(None).cast("string").alias("term"), F.lit(None).cast("long").alias("p"), F.explode(F.sequence(F.lit(0).cast("long"), (F.col("buckets") - 1).cast("long"))).alias("bucket"), "blocks")
    bare = bare.select("lang", "number", "p0", "term", "p", "bucket", other)
    block = F.floor(F.col("number") / BLOCK).cast("int")
    tiles = rows.unionByName(bare).select("lang", F.least(block, "other").alias("lo"), F.greatest(block, "other").alias("hi"), "bucket", "number", "p0", "term", "p")
    parts = tiles.groupBy("lang", "lo", "hi", "bucket").applyInPandas(_tile, "lang string, g int, h int, part long").groupBy("lang", "g", "h").agg(F.sum("part").alias("part"))
    g, h = (tiled.select("lang", "terms", *[F.col(c).alias(f"{x}_{c}") for c in ("source", "number", "p0")]) for x in "gh")
    skeleton = g.join(side(h.drop("terms")), "lang").where("g_number <> h_number")
    met = skeleton.join(parts, (skeleton.lang == parts.lang) & (skeleton.g_number == parts.g) & (skeleton.h_number == parts.h), "left")
    value = F.expr("terms * ((g_p0 - h_p0) * (g_p0 - h_p0) div h_p0) + coalesce(part, 0L)")
    return met.select(skeleton.lang.alias("lang"), F.col("g_source").alias("source"), F.lit("pair").alias("part"), F.col("h_source").alias("item"), value.alias("value"))


def divergence(df: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source", min_docs: int = MIN_DOCS, top: int = TOP_TERMS, head_terms: int = HEAD_TERMS, shard_chars: int = SHARD_CHARS) -> DataFrame:
    """lang, source, part ('pair' or 'term'), item, value, rank; computed, the files in between are gone."""
    spark = df.sparkSession
    docs = df.select(*[F.coalesce(col(c).cast("string"), F.lit("")).alias(n) for c, n in ((lang_col, "lang"), (source_col, "source"), (text_col, "text"))])
    folder = f"{shared_dir(spark)}/quern-divergence-{uuid.uuid4().hex}"
    kept = durable(kept_terms(docs, min_docs))
    posted = postings(docs, kept, folder, head_terms, shard_chars)
    counted = posted.groupBy("lang", "source").agg(F.sum("n").alias("of"), F.count("*").alias("postings"))
    zero = F.lit(0).cast("long")
    groups = docs.select("lang", "source").distinct().join(counted, ["lang", "source"], "left").join(kept.groupBy("lang").agg(F.count("*").alias("terms")), "lang", "left")
    groups = groups.select("lang", "source", *[F.coalesce(c, zero).alias(c) for c in ("of", "postings", "terms")], (F.row_number().over(W.partitionBy("lang").orderBy("source")) - 1).alias("number"))
    groups = durable(groups.withColumn("in_lang", F.sum("of").over(W.partitionBy("lang"))).withColumn("zero", zero).withColumn("p0", _p("zero", "of", "terms")).drop("zero"))
    few = small_enough(groups, BROADCAST_GROUPS)
    side = F.broadcast if few else (lambda t: t)
    weighed = posted.join(side(groups.select("lang", "source", "of", "terms", "in_lang")), ["lang", "source"]).select("lang", "source", "term", _p("n", "of", "terms").alias("p"), _p("total", "in_lang", "terms").alias("q"))
    telling = weighed.where("p > q").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), F.expr("(p - q) * (p - q) div q").alias("value"))
    ranked = F.row_number().over(W.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item"))
    pairs = _pairs(posted, groups.drop("in_lang"), side).withColumn("rank", ranked)
    out = durable(pairs.unionByName(telling.withColumn("rank", ranked).where(F.col("rank") <= top)))
    delete(spark, folder)
    return out


def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence(read(spark, sf_dir, "documents"))


OP12_SQL = r"""
with d as (
  select row_number() over () as rid, coalesce(lang, '') as lang, coalesce(source, '') as source,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') as w from documents
), o as (select rid, lang, source, unnest(w) as term from d
), kept as (select lang, term from (select distinct rid, lang, term from o) group by all having count(*) >= 3
), c as (select lang, source, term, count(*)::hugeint as n from o join kept using (lang, term) group by all
), g as (
  select lang, source, coalesce(of, 0) as of, coalesce(v, 0) as v
  from (select distinct lang, source from d) left join (select lang, source, sum(n) as of from c group by all) using (lang, source) left join (select lang, count(*)::hugeint as v from kept group by all) using (lang)
), p as (
  select g.lang, g.source, k.term, coalesce(n, 0) as n, 1 + (1000000000::hugeint * (coalesce(n, 0) + 1)) // (of + v) as p
  from g join kept k using (lang) left join c on c.lang = g.lang and c.source = g.source and c.term = k.term
), q as (
  select lang, term, 1 + (1000000000::hugeint * (n + 1)) // (of + v) as q
  from (select lang, term, sum(n) as n from c group by all) join (select lang, sum(of) as of, max(v) as v from g group by all) using (lang)
), pair as (
  select a.lang, a.source, b.source as item, coalesce(value, 0)::bigint as value
  from g a join g b on a.lang = b.lang and a.source <> b.source left join (
    select x.lang, x.source, y.source as item, sum((x.p - y.p) * (x.p - y.p) // y.p) as value
    from p x join p y on x.lang = y.lang and x.term = y.term and x.source <> y.source group by all
  ) s on s.lang = a.lang and s.source = a.source and s.item = b.source
), term as (select lang, source, term as item, ((p - q) * (p - q) // q)::bigint as value from p join q using (lang, term) where n > 0 and p > q
)
select lang, source, 'pair' as part, item, value, row_number() over (partition by lang, source order by value desc, item)::int as rank from pair
union all
select * from (select lang, source, 'term' as part, item, value, row_number() over (partition by lang, source order by value desc, item)::int as rank from term) where rank <= 200
"""
