"""Temperature mixing of sources.

Source token shares p are raised to an exponent a in [0, 1] and normalised to weights. The exponent is bisected
(28 halvings; four are settled a round by evaluating 15 points at once) to the largest that reaches the target
entropy, and raised where the flattest source would repeat more often than the limit. Each source's token
quota is then realised as block permutations: a pass over a source orders its documents by a hash of seed, pass
and id, passes follow one another until the quota is full, and the running token count deals each copy to an
output block that holds every source in proportion.

Running counts are distributed: bucket sums of the hash order, a prefix over the buckets, and a window inside
each bucket, so a source with any share of all rows is spread over many tasks.

Defined results: a null source is the source ''; a null or blank text has no tokens and its document, if its
place in the order is before the quota's end, is taken at no cost; a source without tokens has weight 0 and
gives no rows; ties of the hash order go by id; repeated rows each count; an empty table gives no rows.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import col, durable, read

#: Halvings of the exponent's interval, and how many of them a round settles.
HALVINGS, A_ROUND = 28, 4
#: Sources (about 60 bytes each) that are broadcast; beyond it the weights go to salted copies of their key.
BROADCAST_SOURCES, SALT = 50_000, 64
#: Passes over a document that are listed at once.
RUN = 10_000


def n_tokens(text: Column) -> Column:
    """Words between blanks, tabs and line ends."""
    return F.size(F.array_remove(F.split(F.coalesce(text, F.lit("")), "[ \\t\\n\\r]+"), "")).cast("long")


def _exponent(stats: DataFrame, n: int, total: int, least: int, target: float | None, limit: float | None, budget: int) -> float:
    """stats: one row per source with its tokens > 0. Each round is one small aggregation; sources are never collected."""

    def bisect(holds, lo: float) -> tuple[float, float]:
        """The last point of the dyadic grid where ``holds`` and the next one."""
        width = 1.0
        for _ in range(HALVINGS // A_ROUND):
            width /= 1 << A_ROUND
            points = [lo + width * i for i in range(1, 1 << A_ROUND)]
            lo += width * sum(1 for x in values(points) if holds(*x))
        return lo, lo + width

    def values(points: list[float]) -> list[tuple[float, float]]:
        """Entropy and the largest repetition at each exponent."""
        p = F.col("tokens") / F.lit(float(total))
        sums = stats.agg(*[F.sum(F.pow(p, F.lit(a))).alias(f"z{i}") for i, a in enumerate(points)], *[F.sum(F.pow(p, F.lit(a)) * F.log(p)).alias(f"s{i}") for i, a in enumerate(points)]).first()
        out = []
        for i, a in enumerate(points):
            z, s = sums[f"z{i}"], sums[f"s{i}"]
            out.append((math.log(z) - a * s / z, budget / total * (least / total) ** (a - 1) / z))
        return out

    (h0, r0), (h1, r1) = values([0.0, 1.0])
    best = 0.0
    if target is not None:
        best = 1.0 if h1 >= target else 0.0 if h0 < target else bisect(lambda h, r: h >= target, 0.0)[0]
    if limit is not None:
        best = max(best, 0.0 if r0 <= limit else 1.0 if r1 > limit else bisect(lambda h, r: r > limit, 0.0)[1])
    return best


def source_quotas(
    base: DataFrame, budget: int | None = None, entropy: float | None = 0.95, repetition: float | None = 4.0
) -> tuple[DataFrame, float, int, int]:
    """base: (source, tokens) rows. (source, tokens, docs, weight, quota) per source with tokens; exponent; budget; documents of the largest source.

    ``entropy`` is a share of the largest possible entropy, log(number of sources).
    """
    stats = durable(base.groupBy("source").agg(F.sum("tokens").alias("tokens"), F.count("*").alias("docs")).where("tokens > 0"))
    n, total, least, most = stats.agg(F.count("*"), F.sum("tokens"), F.min("tokens"), F.max("docs")).first()
    if not n:
        return stats.withColumns({"weight": F.lit(0.0), "quota": F.lit(0).cast("long")}), 1.0, 0, 0
    budget = total if budget is None else budget
    a = _exponent(stats, n, total, least, None if entropy is None else entropy * math.log(n), repetition, budget)
    raised = F.pow(F.col("tokens") / F.lit(float(total)), F.lit(a))
    z = stats.agg(F.sum(raised)).first()[0]
    quota = F.floor(F.col("weight") * F.lit(float(budget)) + 0.5).cast("long")
    if repetition is not None:
        quota = F.least(quota, F.floor(F.col("tokens") * F.lit(float(repetition))).cast("long"))
    return durable(stats.withColumn("weight", raised / F.lit(z)).withColumn("quota", quota)), a, budget, most


def mix_sources(
    df: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", budget: int | None = None, entropy: float | None = 0.95, repetition: float | None = 4.0, block_tokens: int = 1_000_000, seed: int = 42
) -> DataFrame:
    """One row per taken copy: id, source, pass, block, order_key, n_tokens, weight.

    The mixture is read by (block, order_key). Quotas are rounded to whole tokens, so they add up to ``budget`` (all tokens of
    ``df`` if None) but for half a token a source; each is filled as far as whole documents fit in their order.
    """
    base = durable(df.select(col(id_col).alias("id"), F.coalesce(col(source_col).cast("string"), F.lit("")).alias("source"), n_tokens(col(text_col)).alias("tokens")))
    quotas, _, budget, most = source_quotas(base.select("source", "tokens"), budget, entropy, repetition)
    blocks = max(1, -(-budget // block_tokens))
    plan = quotas.where("quota > 0").select("source", "weight", "quota", F.col("tokens").alias("whole"), F.expr("(quota + tokens - 1) div tokens").alias("passes"))
    n = plan.limit(BROADCAST_SOURCES + 1).count()
    if n <= BROADCAST_SOURCES:
        rows = base.join(F.broadcast(plan), "source")
    else:
        salted = plan.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))))
        rows = base.withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(SALT)).cast("int")).join(salted, ["source", "salt"]).drop("salt")
    # as many buckets of the largest source as a bucket has documents: both windows grow as the root of its size
    bits = math.ceil(math.log2(max(1, most)) / 2)
    key = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("pass").cast("string"), F.coalesce(F.col("id").cast("string"), F.lit(""))).cast("binary")), 1, 15), 16, 10).cast("long")
    # in two steps: a tiny source without a repetition limit may have very many passes
    runs = rows.withColumn("run", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(passes - 1) div {RUN}"))))
    copies = runs.withColumn("pass", F.explode(F.sequence(F.col("run") * RUN, F.least(F.col("run") * RUN + RUN, F.col("passes")) - 1))).drop("run").withColumn("key", key).withColumn("bucket", F.shiftright("key", 60 - bits))
    bucket = ["source", "pass", "bucket"]
    sums = copies.groupBy(*bucket).agg(F.sum("tokens").alias("held"))
    before = W.partitionBy("source", "pass").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)
    offsets = sums.select(*bucket, F.coalesce(F.sum("held").over(before), F.lit(0)).alias("offset"))
    within = W.partitionBy(*bucket).orderBy("key", "id", "tokens").rowsBetween(W.unboundedPreceding, W.currentRow)
    placed = copies.join(offsets, bucket).withColumn("end", F.col("pass") * F.col("whole") + F.col("offset") + F.sum("tokens").over(within))
    a_block = F.expr(f"(quota + {blocks} - 1) div {blocks}")
    return placed.where("end <= quota").select(
        F.col("id").alias(id_col),
        F.col("source").alias(source_col),
        F.col("pass"),
        F.least(F.expr("end - tokens").cast("long"), F.col("quota") - 1).alias("at"),
        F.col("quota"),
        a_block.alias("a_block"),
        F.col("key").alias("order_key"),
        F.col("tokens").alias("n_tokens"),
        F.round("weight", 9).alias("weight"),
    ).select(id_col if id_col.isidentifier() else col(id_col), col(source_col), "pass", F.expr("at div a_block").alias("block"), "order_key", "n_tokens", "weight")


def op3_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(read(spark, sf_dir, "documents"))


def mix_sql(documents: str) -> str:
    """DuckDB SQL of :func:`mix_sources` with its defaults over ``documents``."""
    return f"""
with recursive base as (
  select doc_id, coalesce(source, '') as source, len(regexp_extract_all(coalesce(text, ''), '[^ \\t\\n\\r]+'))::bigint as tokens from {documents}
), stats as (
  select source, sum(tokens)::bigint as tokens from base group by source having sum(tokens) > 0
), tot as (
  select sum(tokens)::bigint as total, count(*) as n, min(tokens) as least, 0.95 * ln(count(*)) as target from stats
), ends as (
  select a, ln(z) - a * s / z as h, pow(least::double / total, a - 1) / z as r, target
  from (select a, sum(pow(tokens::double / total, a)) as z, sum(pow(tokens::double / total, a) * ln(tokens::double / total)) as s, any_value(total) as total, any_value(least) as least, any_value(target) as target
        from stats, tot, (values (0.0::double), (1.0::double)) v(a) group by a)
), halves as (
  select 1 as i, 0.0::double as lo, 0.5::double as w, 0.0::double as lo2
  union all
  select i + 1,
    case when (select ln(sum(pow(tokens::double / total, lo + w))) - (lo + w) * sum(pow(tokens::double / total, lo + w) * ln(tokens::double / total)) / sum(pow(tokens::double / total, lo + w)) from stats, tot) >= (select target from tot) then lo + w else lo end,
    w / 2,
    case when (select max(pow(least::double / total, lo2 + w - 1)) / sum(pow(tokens::double / total, lo2 + w)) from stats, tot) > 4.0 then lo2 + w else lo2 end
  from halves where i <= {HALVINGS}
), a as (
  select greatest(
    case when (select h from ends where a = 1) >= (select target from tot) then 1.0 when (select h from ends where a = 0) < (select target from tot) then 0.0 else lo end,
    case when (select r from ends where a = 0) <= 4.0 then 0.0 when (select r from ends where a = 1) > 4.0 then 1.0 else lo2 + pow(2, -{HALVINGS}) end) as a
  from halves where i = {HALVINGS} + 1
), z as (
  select sum(pow(tokens::double / total, a)) as z from stats, tot, a
), q as (
  select source, tokens as whole, pow(tokens::double / total, a) / z as weight, least(floor(pow(tokens::double / total, a) / z * total + 0.5)::bigint, tokens * 4) as quota, greatest(1, (total + 999999) // 1000000) as blocks
  from stats, tot, a, z
), copies as (
  select doc_id, source, tokens, whole, weight, quota, blocks, pass, ('0x' || substr(md5('42:' || pass || ':' || coalesce(doc_id::varchar, '')), 1, 15))::bigint as key
  from (select base.*, whole, weight, quota, blocks, unnest(generate_series(0, (quota + whole - 1) // whole - 1)) as pass from base join q using (source) where quota > 0)
), placed as (
  select *, pass * whole + sum(tokens) over (partition by source, pass order by key, doc_id, tokens rows unbounded preceding) as e from copies
)
select doc_id, source, pass, least(e - tokens, quota - 1)::bigint // ((quota + blocks - 1) // blocks) as block, key as order_key, tokens as n_tokens, round(weight, 9) as weight
from placed where e <= quota
"""


OP3_SQL = mix_sql("documents")
