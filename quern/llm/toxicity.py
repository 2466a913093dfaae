"""Toxicity by maximum-scoring segments.

Token scores are log-odds between toxic and other labelled documents with Dirichlet priors; a token counts
once per distinct pair of neighbours, so copies of a passage don't teach twice. Tokens are words, backed off
to the first ``STEM`` letters. All other tokens score a little below zero. A linear scan finds every maximal segment
(the all-maximal-segments rule of Ruzzo and Tompa, with runs of equal background tokens taken at once), and
a segment's score S in a text of n tokens becomes an expected count K n exp(-lambda S) under the extreme-value
law; lambda is 1 for log-likelihood ratios and K is fitted on the labelled documents that aren't toxic. Evidence
beyond that count adds up over segments and moves the prior odds: that is the document's score.

Defined results: null and empty texts have no tokens and the score of no evidence; labels of repeated or unknown
documents count as they join; without labels of both kinds every document gets the prior; a document's other
columns are never looked at.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import col, durable, read

#: The bounded samples of labelled documents; they bound the table of scores too.
TOXIC_DOCS, OTHER_DOCS = 2_000, 8_000
#: Dirichlet pseudo-count of each token, and how many standard errors a score is shrunk.
PRIOR, SHRINK = 0.5, 1.0
#: Least score of a token: less telling ones count as background, so that totals drift down outside toxic passages.
LEAST_SCORE = 2.0
STEM = 5
#: Expected count of equally good segments below which a segment is significant.
SIGNIFICANT = 0.1
PREDICTED_AT = 0.7

_WORD = re.compile(r"[^\W_]+")


class Model:
    def __init__(self, scores: dict[str, float], background: float, k: float, prior: float) -> None:
        self.scores, self.background, self.k, self.prior = scores, background, k, prior


def tokens(text: str) -> list[str]:
    return _WORD.findall(text.lower())


def _contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    from zlib import crc32

    for batch in batches:
        for toxic, text in zip(batch.column("toxic").to_pylist(), batch.column("text").to_pylist(), strict=True):
            words = ["", *tokens(text or ""), ""]
            seen = {(w, crc32(f"{a} {b}".encode())) for a, w, b in zip(words, words[1:], words[2:], strict=False)}
            seen |= {(w[:STEM] + "*", c) for w, c in seen if len(w) > STEM}
            rows = list(seen)
            yield pa.RecordBatch.from_arrays([pa.array([toxic] * len(rows), pa.int32()), pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.int64())], names=["toxic", "token", "context"])


def segments(positions: np.ndarray, gains: list[float], background: float, n: int) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (first, last, score) of n tokens that score ``background`` but at ``positions``.

    Candidates are kept with the running totals at their ends, and each with the nearest earlier one that begins at a
    lower total; a new one swallows earlier candidates as long as one begins at a lower and ends at a lower total. It
    follows these links past all that begin higher, so the work is linear in the tokens.
    """
    found: list[tuple[int, int, float, float]] = []  # first, last, total before, total after
    lower: list[int] = []
    total, at = 0.0, 0
    for p, gain in zip(positions, gains, strict=True):
        total += background * (p - at)
        first, last, left, right = int(p), int(p), total, total + gain
        total, at = right, p + 1
        j = len(found) - 1
        while True:
            while j >= 0 and found[j][2] >= left:
                j = lower[j]
            if j < 0 or found[j][3] >= right:
                break
            first, left = found[j][0], found[j][2]
            before = lower[j]
            del found[j:], lower[j:]
            j = before
        found.append((first, last, left, right))
        lower.append(j)
    return [(a, b, r - left) for a, b, left, r in found]


def text_segments(text: str | None, model: Model) -> tuple[int, list[tuple[int, int, float]]]:
    """Number of tokens, and the maximal segments."""
    words = tokens(text or "")
    get = model.scores.get
    hits = [(i, s) for i, w in enumerate(words) if (s := get(w) or (get(w[:STEM] + "*") if len(w) > STEM else None))]
    return len(words), segments(np.array([i for i, _ in hits], int), [s for _, s in hits], model.background, len(words))


def evidence(n: int, found: list[tuple[int, int, float]], k: float) -> float:
    """What the significant segments' scores exceed the extreme-value law's expectation by, in nats."""
    chance = math.log(k * max(n, 1))
    return sum(s - chance for _, _, s in found if s - chance > -math.log(SIGNIFICANT))


def score(n: int, found: list[tuple[int, int, float]], model: Model) -> float:
    best = max((s for _, _, s in found), default=0.0)
    # without significant segments the best one still ranks documents, below the prior
    weak = -1.0 - 1.0 / (1.0 + best)
    v = evidence(n, found, model.k) or weak
    return 1 / (1 + math.exp(-min(40.0, math.log(model.prior / (1 - model.prior)) + v)))


def learn(documents: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Model:
    """The model from a bounded sample of the labelled documents (those whose id hashes lowest)."""
    known = labels.where(col(label_col).isin(0, 1) & col(id_col).isNotNull()).select(col(id_col).alias("id"), col(label_col).cast("int").alias("toxic"))
    sizes = {r.toxic: r["n"] for r in known.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    n1, n0 = sizes.get(1, 0), sizes.get(0, 0)
    prior = (n1 + 0.5) / (n1 + n0 + 1)
    if not n1 or not n0:
        return Model({}, -0.01, 1e-3, prior)
    pick = lambda y, most: known.where(F.col("toxic") == y).orderBy(F.xxhash64(F.col("id").cast("string"))).limit(most)
    sample = durable(pick(1, TOXIC_DOCS).unionByName(pick(0, OTHER_DOCS)))  # at most TOXIC_DOCS + OTHER_DOCS rows
    taught = durable(documents.select(col(id_col).alias("id"), col(text_col).cast("string").alias("text")).join(F.broadcast(sample), "id").select("toxic", "text"))
    counts = taught.mapInArrow(_contexts, "toxic int, token string, context bigint").distinct().groupBy("token").agg(F.sum("toxic").alias("y1"), F.sum(1 - F.col("toxic")).alias("y0"))
    counts = durable(counts)
    t1, t0 = counts.where("token not like '%*'").agg(F.coalesce(F.sum("y1"), F.lit(0)), F.coalesce(F.sum("y0"), F.lit(0))).first()
    odds = lambda y, t: F.log((F.col(y) + PRIOR) / (F.lit(float(t) + 1) - F.col(y)))
    delta, sigma = odds("y1", t1) - odds("y0", t0), F.sqrt(1 / (F.col("y1") + PRIOR) + 1 / (F.col("y0") + PRIOR))
    # the deviance of a token's split between the two kinds has to exceed what the largest of all tested tokens has by chance
    tested = counts.where("y1 >= 3").select("token", "y1", "y0", delta.alias("d"), sigma.alias("e"))
    least, share = math.log(max(2, tested.count())), t1 / max(1, t1 + t0)
    part = lambda y, p: F.when(F.col(y) > 0, F.col(y) * F.log(F.col(y) / ((F.col("y1") + F.col("y0")) * F.lit(p)))).otherwise(0.0)
    told = tested.where((F.col("d") - SHRINK * F.col("e") >= LEAST_SCORE) & (part("y1", share) + part("y0", 1 - share) >= least))
    top = told.collect()  # telling tokens of the sample's documents
    table = {r.token: s for r in top if (s := r.d - SHRINK * r.e) >= LEAST_SCORE}
    share = sum(r.y1 for r in top if r.token in table and not r.token.endswith("*")) / max(1, t1)
    model = Model(table, math.log1p(-min(0.2, max(0.005, share))), 1e-3, prior)
    # K: the least with which the law covers what the documents that aren't toxic hold at every level of scores
    levels = range(1, 7)
    seen = scan(taught.where("toxic = 0").select(F.lit(0).alias("id"), "text"), model, "id", "text")
    row = seen.agg(F.coalesce(F.sum("n_tokens"), F.lit(0)).alias("n"), *[F.coalesce(F.sum(F.expr(f"size(filter(segments, x -> x.score >= {x}))")), F.lit(0)).alias(f"m{x}") for x in levels]).first()
    model.k = max((row[f"m{x}"] + 0.5) * math.exp(x) / max(1, row["n"]) for x in levels)
    return model


def _scan(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("first", pa.int32()), ("last", pa.int32()), ("score", pa.float64())]))
        for batch in batches:
            counts, all_found, values = [], [], []
            for text in batch.column("text").to_pylist():
                n, found = text_segments(text, model)
                counts.append(n)
                all_found.append([{"first": a, "last": b, "score": s} for a, b, s in found])
                values.append(score(n, found, model))
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(counts, pa.int64()), pa.array(all_found, kind), pa.array(values, pa.float64())], names=["id", "n_tokens", "segments", "score"])

    return run


def scan(df: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, n_tokens, segments (first and last token, score; all maximal ones) and score of the whole text."""
    rows = df.select(col(id_col).alias("id"), col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(_scan(model), f"id {rows.schema['id'].dataType.simpleString()}, n_tokens bigint, segments array<struct<first:int,last:int,score:double>>, score double")


def _third(c: str):
    return F.pmod(F.crc32(F.coalesce(F.col(c).cast("string"), F.lit("")).cast("binary")), F.lit(3))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents, labels = read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels")
    model = learn(documents, labels.where(_third("doc_id") != 1))
    found = scan(documents, model)
    return found.select(
        F.col("id").alias("doc_id"), (_third("id") == 1).alias("held_out"), "score", (F.col("score") >= PREDICTED_AT).cast("int").alias("predicted"), F.expr("size(segments)").alias("n_segments")
    )
