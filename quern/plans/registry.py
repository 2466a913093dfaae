"""The engine's queries over the driver's tables, each over whole tables, with DuckDB SQL where that can say the same.

Searches take as queries every vector whose id is divisible by 20, against all vectors.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import normalize_ws, preview, words
from ..functions.vectors import norm, normalize
from ..operators import assembly, evaluation, near_duplicates, recall, retrieval, tiles
from ..operators.cells import CellIndex
from ..operators.chunking import chunk_by_sentences, chunk_by_words, ingest_stats
from ..operators.embedding import HashEmbedder, ModelEmbedder
from ..operators.embedding_cache import CachedEmbedder
from ..operators.inference import Inference, error_class, judged
from ..operators.ledger import AnswerLedger
from ..operators.memory import Memory
from ..sources.config import Config
from ..sources.files import ingestable, with_file_metadata
from ..sources.large_text import chunk_files
from ..sources.memory_source import register as register_memory_source
from ..sources.synthetic import fact_document, facts, questions
from ..storage import create_text, delete, durable, shared_dir
from ..streaming import ingest as streaming
from ..system import MemorySystem

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """A table in fewer pieces than there are cores (one small file, say) dealt to all of them; larger ones stay as they are."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


_WORDS = r"list_filter(string_split_regex(text, '\s+'), lambda w: w <> '')"
_SET = r"list_sort(list_distinct(list_filter(string_split_regex(regexp_replace(lower(text), '[^\p{L}\p{N}_\s]', '', 'g'), '\s+'), lambda w: w <> '')))"


def _chunks_sql(size: int, stride: int, columns: str) -> str:
    return f"""
with d as (select doc_id, {_WORDS} as w from documents
), c as (select doc_id, w, unnest(generate_series(0, greatest(0, ceil((len(w) - {size}) / {stride}.0))::int)) as position from d where len(w) > 0
), t as (select doc_id, position::int as position, array_to_string(w[position * {stride} + 1:position * {stride} + {size}], ' ') as text from c where position * {stride} < len(w))
select {columns} from t"""


# chunking


@query(f"select doc_id, len({_WORDS})::int as word_count, length(text)::int as char_count from documents")
def word_stats(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", F.size(words(F.col("text"))).alias("word_count"), F.length("text").alias("char_count"))


@query(f"select doc_id, array_to_string({_WORDS}, ' ') as text from documents")
def normalize_whitespace(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", normalize_ws(F.col("text")).alias("text"))


def _word_chunks(spark: SparkSession, d: str, size: int, overlap: int) -> DataFrame:
    return chunk_by_words(table(spark, d, "documents").select("doc_id", "text"), size, overlap).select("doc_id", "position", "text")


@query(_chunks_sql(200, 150, "doc_id, position, text"))
def chunk_words(spark: SparkSession, d: str) -> DataFrame:
    return _word_chunks(spark, d, 200, 50)


@query(_chunks_sql(300, 250, "doc_id, position, text"))
def chunk_words_default(spark: SparkSession, d: str) -> DataFrame:
    return _word_chunks(spark, d, 300, 50)


@query(_chunks_sql(100, 100, "doc_id, position, text"))
def chunk_words_no_overlap(spark: SparkSession, d: str) -> DataFrame:
    return _word_chunks(spark, d, 100, 0)


@query(_chunks_sql(200, 150, f"doc_id, position, sha256(doc_id || '|' || position) as chunk_id, len({_WORDS})::int as word_count, length(text)::int as char_count, 'text' as file_type, 'txt' as extension"))
def chunk_metadata(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", "text", F.lit("text").alias("file_type"), F.lit("txt").alias("extension"))
    return chunk_by_words(docs, 200, 50).select("doc_id", "position", "chunk_id", "word_count", "char_count", "file_type", "extension")


@query(rf"""
with recursive d as (
  select doc_id, string_split(regexp_replace(regexp_replace(text, '^\s+|\s+$', '', 'g'), '([.!?])\s+', '\1' || chr(30), 'g'), chr(30)) as s from documents where regexp_matches(text, '\S')
), s as (
  select doc_id, unnest(s) as text, generate_subscripts(s, 1) as i from d
), n as (select doc_id, i, text, len({_WORDS}) as n from s
), r as (
  select doc_id, i, 0 as position, n as cur from n where i = 1
  union all
  select n.doc_id, n.i, case when r.cur + n.n > 300 then r.position + 1 else r.position end, case when r.cur + n.n > 300 then n.n else r.cur + n.n end from r join n on n.doc_id = r.doc_id and n.i = r.i + 1
)
select doc_id, position::int as position, string_agg(text, ' ' order by i) as text from r join n using (doc_id, i) group by doc_id, position""")
def chunk_sentences(spark: SparkSession, d: str) -> DataFrame:
    return chunk_by_sentences(table(spark, d, "documents").select("doc_id", "text")).select("doc_id", "position", "text")


@query(f"""
with d as (select doc_id, len({_WORDS}) as n from documents
), c as (select doc_id, case when n = 0 then 0 else (1 + greatest(0, ceil((n - 200) / 150.0)))::bigint end as c from d)
select doc_id, c as chunks_created, c as embeddings_stored, case when c = 0 then 'No text content found to ingest' end as message from c""")
def ingest_statistics(spark: SparkSession, d: str) -> DataFrame:
    return ingest_stats(table(spark, d, "documents"), 200, 50)


@query("select doc_id, substring(text, 1, 200) || '...' as preview from documents")
def text_preview(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", preview(F.col("text")).alias("preview"))


_SUFFIXES = [".md", ".py", ".tsx", ".PDF", "", ".tar.gz", ".yml", ".unknown", ".hpp", ".csv", ".env"]


@query(f"""
with p as (select page_id, 'file' || page_id || ({_SUFFIXES!r})[page_id % {len(_SUFFIXES)} + 1] as name from pages
), e as (select page_id, name, case when regexp_extract(name, '[^/]\\.([^./]+)$', 1) = '' then 'txt' else regexp_extract(name, '[^/]\\.([^./]+)$', 1) end as extension from p)
select page_id, name, extension, case extension when 'md' then 'markdown' when 'py' then 'python' when 'tsx' then 'react-typescript' when 'yml' then 'config' when 'env' then 'config' when 'hpp' then 'header' when 'csv' then 'data' else 'text' end as file_type from e""")
def file_type_map(spark: SparkSession, d: str) -> DataFrame:
    suffix = F.element_at(F.array(*map(F.lit, _SUFFIXES)), (F.col("page_id") % len(_SUFFIXES) + 1).cast("int"))
    return with_file_metadata(table(spark, d, "pages").select("page_id", F.concat(F.lit("file"), F.col("page_id").cast("string"), suffix).alias("name")), "name").select("page_id", "name", "extension", "file_type")


# vectors


@query("select vec_id, round(sqrt(list_sum(list_transform(embedding, lambda x: x::double * x::double))), 6) as norm from embeddings")
def embedding_norms(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings").select("vec_id", F.round(norm(F.col("embedding")), 6).alias("norm"))


@query("""
with e as (select vec_id, embedding::double[] as v, sqrt(list_sum(list_transform(embedding, lambda x: x::double * x::double))) as n from embeddings)
select vec_id, (generate_subscripts(v, 1) - 1)::int as at, round(unnest(v) / case when n = 0 then 1 else n end, 6) + 0.0 as value from e""")
def normalize_embeddings(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings").select("vec_id", F.posexplode(normalize(F.col("embedding"))).alias("at", "value")).select("vec_id", "at", (F.round("value", 6) + 0.0).alias("value"))


@query(r"""
with w as (select doc_id, unnest(list_filter(string_split_regex(lower(text), '\s+'), lambda w: w <> '')) as w from documents
), b as (select doc_id, (('0x' || substr(md5(w), 1, 8))::bigint % 64)::int as "at", count(*)::double as n from w group by 1, 2)
select doc_id, "at", round((n / sqrt(sum(n * n) over (partition by doc_id)))::float::double, 5) as value from b""")
def hash_embed(spark: SparkSession, d: str) -> DataFrame:
    vectors = HashEmbedder(64).embed(spread(table(spark, d, "documents").select("doc_id", "text")))
    return vectors.select("doc_id", F.posexplode_outer("embedding").alias("at", "value")).where("value <> 0").select("doc_id", "at", F.round(F.col("value").cast("double"), 5).alias("value"))


@query("""
with t as (select 'd' || doc_id as id, text from documents union all select 'b' || item_id, text from benchmark)
select id, case when regexp_matches(text, '\\S') then length(text) else 0 end::double as letters, case when regexp_matches(text, '\\S') then length(text) - length(replace(text, 'e', '')) else 0 end::double as es,
  case when regexp_matches(text, '\\S') then 1 else 0 end::bigint as times_embedded from t""")
def embed_cached(spark: SparkSession, d: str) -> DataFrame:
    """Two ingests, documents and then documents and benchmark texts, by a model behind one cache: each text is embedded once over both."""
    documents = table(spark, d, "documents").select(F.concat(F.lit("d"), "doc_id").alias("id"), "text")
    texts = documents.unionByName(table(spark, d, "benchmark").select(F.concat(F.lit("b"), "item_id").alias("id"), "text"))
    model = ModelEmbedder("letters", 2, lambda: lambda batch: [[len(t), t.count("e")] for t in batch])
    path = f"{shared_dir(spark)}/quern-vectors-{uuid.uuid4().hex}"
    cache = CachedEmbedder(spark, model, path, buckets=8)
    cache.embed(documents)
    found = cache.embed(texts.withColumn("key", cache.key(F.col("text"))))  # before the texts are left behind
    times = cache.rows().groupBy("key").agg(F.count("*").alias("times_embedded"))
    vector = lambda i: F.col("embedding")[i].cast("double")
    out = durable(found.join(times, "key", "left").select("id", vector(0).alias("letters"), vector(1).alias("es"), F.coalesce("times_embedded", F.lit(0)).cast("long").alias("times_embedded")))
    cache.forget()
    delete(spark, path)
    return out


def _vectors(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """All vectors (idx, embedding, source) and the stated query set (query_id, qvec)."""
    e = table(spark, d, "embeddings")
    return e.select(F.col("vec_id").alias("idx"), "embedding", F.col("label").cast("string").alias("source")), e.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("qvec"))


_COSINE = """
n as (select vec_id, label, embedding::double[] as e, sqrt(list_inner_product(embedding::double[], embedding::double[])) as n from embeddings
), v as (select vec_id, label, list_transform(e, lambda x: x / case when n = 0 then 1 else n end) as v from n
), s as (select q.vec_id as query_id, v.vec_id as idx, v.label, list_inner_product(q.v, v.v) as score from v q, v where q.vec_id % 20 = 0
), r as (select *, row_number() over (partition by query_id order by round(score, 12) desc, idx) - 1 as rank from s)"""


def _rounded(found: DataFrame) -> DataFrame:
    return found.withColumn("score", F.round("score", 6) + 0.0)


@query("""
with q as (select vec_id as query_id, embedding::double[] as q from embeddings where vec_id % 20 = 0
), s as (select query_id, vec_id as idx, list_sum(list_transform(list_zip(q, embedding::double[]), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) as score from q, embeddings
), r as (select *, row_number() over (partition by query_id order by round(score, 12), idx) - 1 as rank from s)
select query_id, rank::int as rank, idx, round(score, 6) + 0.0 as score from r where rank < 5""")
def search_l2_topk(spark: SparkSession, d: str) -> DataFrame:
    vectors, queries = _vectors(spark, d)
    return _rounded(retrieval.search(vectors, queries, 5, "L2"))


@query(f"with {_COSINE} select query_id, rank::int as rank, idx, round(score, 6) + 0.0 as score from r where rank < 5")
def search_cosine_topk(spark: SparkSession, d: str) -> DataFrame:
    vectors, queries = _vectors(spark, d)
    return _rounded(retrieval.search(vectors, queries, 5, "cosine"))


@query(SQL["search_l2_topk"])
def search_l2_tiled(spark: SparkSession, d: str) -> DataFrame:
    """Queries and vectors both dealt to tiles, several a side at any scale."""
    vectors, queries = _vectors(spark, d)
    return _rounded(tiles.search_tiled(vectors, queries, 5, "L2", query_rows=50, vector_rows=400_000))


def _in_cells(spark: SparkSession, d: str, metric: str) -> DataFrame:
    vectors, queries = _vectors(spark, d)
    path = f"{shared_dir(spark)}/quern-cells-{uuid.uuid4().hex}"
    found = CellIndex.build(vectors, path, metric, cells=16).search(queries, 5)
    delete(spark, path)
    return _rounded(found)


@query(SQL["search_cosine_topk"])
def search_cosine_cells(spark: SparkSession, d: str) -> DataFrame:
    """Vectors written in cells, of which those are read that can hold one of the five best."""
    return _in_cells(spark, d, "cosine")


@query(SQL["search_l2_topk"])
def search_l2_cells(spark: SparkSession, d: str) -> DataFrame:
    return _in_cells(spark, d, "L2")


@query("""
with s as (select vec_id as idx, list_inner_product(embedding::double[], (select embedding::double[] from embeddings order by vec_id limit 1)) / sqrt(list_inner_product(embedding::double[], embedding::double[])) / (select sqrt(list_inner_product(embedding::double[], embedding::double[])) from embeddings order by vec_id limit 1) as score from embeddings)
select idx, round(score, 6) + 0.0 as score from s order by s.score desc, idx limit 5""")
def search_single(spark: SparkSession, d: str) -> DataFrame:
    vectors, _ = _vectors(spark, d)
    first = vectors.orderBy("idx").select("embedding").first()
    return retrieval.search_one(vectors, first[0], 5).select("idx", (F.round("score", 6) + 0.0).alias("score"))


@query(f"with {_COSINE} select query_id, rank::int as rank, idx, round(score, 6) + 0.0 as score, label::varchar as source from r where rank < 10 and score >= 0.3")
def retrieve_threshold(spark: SparkSession, d: str) -> DataFrame:
    vectors, queries = _vectors(spark, d)
    return _rounded(retrieval.retrieve(vectors, queries, 10, 0.3, payload=["source"]))


@query(f"with {_COSINE} select query_id, rank::int as rank, idx, round(score, 6) + 0.0 as score from r where score >= 0.5 and rank < 100000")
def retrieve_k_over_n(spark: SparkSession, d: str) -> DataFrame:
    vectors, queries = _vectors(spark, d)
    return _rounded(retrieval.search(vectors, queries, 100_000, "cosine", threshold=0.5))


@query(f"""
with {_COSINE}, f as (select (query_id // 20) % 7 as group_id, (query_id // 140)::bigint as qpos, rank, idx, score, label::varchar as text from r where rank < 5
), u as (select *, row_number() over (partition by group_id, text order by round(score, 12) desc, qpos, rank) as n from f
), m as (select *, row_number() over (partition by group_id order by round(score, 12) desc, qpos, rank) - 1 as merged_rank from u where n = 1)
select group_id, merged_rank::int as merged_rank, qpos, rank::int as rank, idx, round(score, 6) + 0.0 as score, text from m where merged_rank < 5""")
def multi_query_merge(spark: SparkSession, d: str) -> DataFrame:
    vectors, queries = _vectors(spark, d)
    found = retrieval.retrieve(vectors, queries, 5, -2.0, payload=["source"]).withColumn("score", F.round("score", 12))
    placed = found.select(F.expr("(query_id div 20) % 7").alias("group_id"), F.expr("query_id div 140").alias("qpos"), "rank", "idx", "score", F.col("source").alias("text"))
    return _rounded(retrieval.merge_queries(placed, 5)).select("group_id", "merged_rank", "qpos", "rank", "idx", "score", "text")


@query(f"""
with {_COSINE}
select q.vec_id as query_id, round(q.n, 6) as embedding_norm, coalesce(string_agg(idx::varchar, ',' order by rank), '') as retrieved
from n q left join (select * from r where rank < 5 and score >= 0.3) f on f.query_id = q.vec_id where q.vec_id % 20 = 0 group by 1, 2""")
def explain_retrieval(spark: SparkSession, d: str) -> DataFrame:
    vectors, queries = _vectors(spark, d)
    found = retrieval.explain_retrieval(vectors, queries, 5, 0.3)
    return found.select("query_id", F.round("embedding_norm", 6).alias("embedding_norm"), F.array_join(F.transform("retrieved", lambda x: x["idx"].cast("string")), ",").alias("retrieved"))


@query(f"with {_COSINE} select query_id, count(*) as raw_count, count(*) filter (where score >= 0.3) as kept_count from r where rank < 5 group by query_id")
def raw_against_threshold(spark: SparkSession, d: str) -> DataFrame:
    vectors, queries = _vectors(spark, d)
    return retrieval.raw_against_threshold(vectors, queries, 5, 0.3)


@query("select count(*) as total_chunks, 64 as dimension, 'cosine' as index_type from embeddings")
def memory_stats(spark: SparkSession, d: str) -> DataFrame:
    chunks = table(spark, d, "embeddings").select(F.col("vec_id").alias("doc_id"), "embedding", F.col("label").cast("string").alias("text"))
    return Memory(spark, 64, "cosine").add(chunks).statistics()


# duplicates


@query(rf"""
with recursive t as (select conv_id, turn, row_number() over (partition by conv_id order by turn) as i, {_SET} as w from conversations
), r as (
  select conv_id, turn, i, true as kept, [w] as k from t where i = 1
  union all
  select t.conv_id, t.turn, t.i, not coalesce(list_bool_or(list_transform(r.k, lambda y: len(list_intersect(y, t.w)) > 0.8 * (len(y) + len(t.w) - len(list_intersect(y, t.w))))), false),
    case when coalesce(list_bool_or(list_transform(r.k, lambda y: len(list_intersect(y, t.w)) > 0.8 * (len(y) + len(t.w) - len(list_intersect(y, t.w))))), false) then r.k else list_append(r.k, t.w) end
  from r join t on t.conv_id = r.conv_id and t.i = r.i + 1
)
select conv_id, turn, role, text from r join conversations using (conv_id, turn) where kept""")
def dedupe_greedy_group(spark: SparkSession, d: str) -> DataFrame:
    return retrieval.deduplicate(table(spark, d, "conversations"), 0.8, "conv_id", "turn").select("conv_id", "turn", "role", "text")


_SIMILAR = rf"""
v as (select doc_id, {_SET} as w from documents
), s as (select min(doc_id) as doc_id, w from v where len(w) > 0 group by w
), u as (select doc_id, len(w) as n, unnest(w) as w from s
), c as (select a.doc_id as a, b.doc_id as b, a.n as na, b.n as nb, count(*) as c from u a join u b on a.w = b.w and a.doc_id < b.doc_id group by 1, 2, 3, 4
), similar_pairs as (select a, b, round(c / (na + nb - c)::double, 9) as similarity from c where c / (na + nb - c)::double > 0.8)"""


@query(f"with {_SIMILAR} select * from similar_pairs")
def near_dup_pairs(spark: SparkSession, d: str) -> DataFrame:
    return near_duplicates.similar_pairs(table(spark, d, "documents"), 0.8, "doc_id").withColumn("similarity", F.round("similarity", 9))


@query(f"""
with recursive {_SIMILAR}, e as (select b as id, list(a) as earlier, row_number() over (order by b) as i from similar_pairs group by b
), r as (
  select 0::bigint as i, []::bigint[] as dropped
  union all
  select e.i, case when len(list_filter(e.earlier, lambda x: not list_contains(r.dropped, x))) > 0 then list_append(r.dropped, e.id) else r.dropped end from r join e on e.i = r.i + 1
), last as (select dropped from r order by i desc limit 1)
select v.doc_id, len(v.w) = 0 or (v.doc_id = s.doc_id and not list_contains((select dropped from last), v.doc_id)) as kept from v left join s on v.w = s.w""")
def dedupe_greedy_corpus(spark: SparkSession, d: str) -> DataFrame:
    return near_duplicates.deduplicate_table(table(spark, d, "documents"), 0.8, "doc_id").withColumnRenamed("pos", "doc_id")


# prompts


def _results(spark: SparkSession, d: str) -> DataFrame:
    """The ten documents nearest to each query vector, by the vectors of the same ids."""
    vectors, queries = _vectors(spark, d)
    found = retrieval.search(vectors, queries, 10, "cosine")
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("idx"), "text", F.when(F.col("doc_id") % 3 != 0, F.col("source")).alias("source"))
    return found.withColumn("score", F.round("score", 6) + 0.0).join(docs, "idx")


_RESULTS = f"""
{_COSINE}, f as (select query_id, rank, idx, round(r.score, 6) + 0.0 as score, text, case when idx % 3 != 0 then source end as source from r join documents on doc_id = idx where rank < 10)"""
_PACKED = f"""
{_RESULTS}, c as (select *, sum(length(text)) over w as upto, row_number() over w - 1 as packed from f window w as (partition by query_id order by score desc, rank rows unbounded preceding)
), p as (select query_id, packed, idx, score, source, case when upto > 4000 then substring(text, 1, 4000) else text end as text from c where upto <= 4000 or upto = length(text))"""
_CONTEXT = f"""
{_PACKED}, x as (select query_id, string_agg('[Source: ' || coalesce(source, 'Document ' || (packed + 1)) || ' (.txt) - Score: ' || round_even(score::decimal(38, 18), 3)::decimal(38, 3) || ']' || chr(10) || text, chr(10) || chr(10) order by packed) as context from p group by query_id
), q as (select vec_id as query_id, 'What is near ' || vec_id || '?' as text from embeddings where vec_id % 20 = 0)"""


@query(f"with {_PACKED} select query_id, packed::int as packed, idx, score, text from p")
def truncate_to_fit(spark: SparkSession, d: str) -> DataFrame:
    return assembly.truncate_to_fit(_results(spark, d)).select("query_id", "packed", "idx", "score", "text")


def _prompts(spark: SparkSession, d: str, template: str) -> DataFrame:
    _, queries = _vectors(spark, d)
    asked = queries.select("query_id", F.concat(F.lit("What is near "), F.col("query_id").cast("string"), F.lit("?")).alias("text"))
    return assembly.assemble_prompts(asked, _results(spark, d).withColumn("extension", F.lit("txt")), template)


def _filled(template: str) -> str:
    head, middle, tail = ("'" + x.replace("'", "''").replace("\n", "' || chr(10) || '") + "'" for x in assembly.TEMPLATES[template])
    return f"with {_CONTEXT} select query_id, {head} || coalesce(context, '') || {middle} || text || {tail} as prompt from q left join x using (query_id)"


@query(_filled("default"))
def assemble_prompt(spark: SparkSession, d: str) -> DataFrame:
    return _prompts(spark, d, "default")


@query(_filled("instructional"))
def assemble_prompt_instructional(spark: SparkSession, d: str) -> DataFrame:
    return _prompts(spark, d, "instructional")


@query(f"with {_RESULTS} select query_id, string_agg(text, chr(10) order by rank) as context from f group by query_id")
def joined_context(spark: SparkSession, d: str) -> DataFrame:
    return assembly.joined_context(_results(spark, d))


@query(f"with {_RESULTS}, m as (select *, row_number() over (partition by query_id order by rank) as i from f) select query_id, string_agg('[' || i || '] ' || coalesce(source, 'Chunk ' || i), chr(10) order by i) as citations from m group by query_id")
def citations(spark: SparkSession, d: str) -> DataFrame:
    return assembly.citations(_results(spark, d)).withColumn("citations", F.array_join("citations", "\n"))


@query("""
select conv_id, 'CONVERSATION HISTORY:' || chr(10) || string_agg(upper(coalesce(role, 'user')) || ': ' || coalesce(text, '') || chr(10), '' order by turn) || chr(10) || 'CURRENT TASK:' || chr(10) || 'Summarise conversation ' || conv_id as prompt
from conversations group by conv_id""")
def conversational_prompt(spark: SparkSession, d: str) -> DataFrame:
    turns = table(spark, d, "conversations")
    asked = turns.select("conv_id").distinct().withColumn("prompt", F.concat(F.lit("Summarise conversation "), F.col("conv_id").cast("string")))
    return assembly.conversational_prompts(asked, turns)


# generation and scores


@query(f"with {_COSINE}, h as (select query_id, max((label = (query_id % 10))::int) as hit from r where rank < 3 group by query_id) select sum(hit)::bigint as hits, count(*) as total, sum(hit) / count(*)::double as hit_rate from h")
def hit_rate_at_3(spark: SparkSession, d: str) -> DataFrame:
    vectors, queries = _vectors(spark, d)
    truth = queries.select("query_id", (F.col("query_id") % 10).cast("string").alias("expected"))
    return evaluation.hit_rate(queries, retrieval.retrieve(vectors, queries, 3, -2.0, payload=["source"]), truth)


@query(r"""
with a as (select a.text as response, string_split_regex(u.text, '\s+')[1] as expected from conversations u join conversations a on a.conv_id = u.conv_id and a.turn = u.turn + 1 where u.role = 'user' and a.role = 'assistant')
select coalesce(sum(contains(lower(response), lower(expected))::int) / count(*)::double, 0) as accuracy, coalesce(sum(contains(lower(response), lower(expected))::bigint), 0)::bigint as correct, count(*) as total from a""")
def answer_accuracy(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "conversations")
    asked = c.where("role = 'user'").select("conv_id", (F.col("turn") + 1).alias("turn"), F.split("text", r"\s+")[0].alias("expected"))
    return evaluation.accuracy(asked.join(c.where("role = 'assistant'").select("conv_id", "turn", F.col("text").alias("response")), ["conv_id", "turn"]))


_ERRORS = ["HTTP 429: slow down", "Rate limit reached", "read Timeout", "Connection reset", "invalid key", ""]


@query(f"""
with e as (select event_id, ({_ERRORS!r})[event_id % {len(_ERRORS)} + 1] || ' ' || event_type as message, event_id % 4 as retries from events
), c as (select *, contains(lower(message), 'rate limit') or contains(lower(message), '429') as limited, contains(lower(message), 'timeout') or contains(lower(message), 'connection') as lost from e)
select event_id, limited or lost as should_retry, (case when limited then (retries + 1) * 2 when lost then 1 else 0 end)::int as wait_time, message from c""")
def error_classification(spark: SparkSession, d: str) -> DataFrame:
    text = F.element_at(F.array(*map(F.lit, _ERRORS)), (F.col("event_id") % len(_ERRORS) + 1).cast("int"))
    classed = error_class(F.concat(text, F.lit(" "), F.col("event_type")), F.col("event_id") % 4)
    return table(spark, d, "events").select("event_id", classed.alias("e")).select("event_id", "e.*")


_VERDICTS = [
    ('```json\n{"score": 0.4, "reason": "because"}\n```', 0.4, "because"),
    ('{"score": 0.75}', 0.75, ""),
    ('{"reason": "because"}', 0.0, "because"),
    ("not json", 0.0, "Error calculating score: Expecting value: line 1 column 1 (char 0)"),
    ('{"score": "0.8", "reason": "as text"}', 0.8, "as text"),
    ('{"score": 1.0} and more', 0.0, "Error calculating score: Extra data: line 1 column 16 (char 15)"),
    ('{"score": "high"}', 0.0, "Error calculating score: could not convert string to float: 'high'"),
]
_SCORES, _REASONS = [v[1] for v in _VERDICTS], ", ".join("'" + v[2].replace("'", "''") + "'" for v in _VERDICTS)


@query(f"select event_id, ({_SCORES!r})[event_id % {len(_VERDICTS)} + 1]::double as score, ([{_REASONS}])[event_id % {len(_VERDICTS)} + 1] as reason from events")
def judge_parse(spark: SparkSession, d: str) -> DataFrame:
    answer = F.element_at(F.array(*[F.lit(v[0]) for v in _VERDICTS]), (F.col("event_id") % len(_VERDICTS) + 1).cast("int"))
    return table(spark, d, "events").select("event_id", judged(answer).alias("j")).select("event_id", "j.score", "j.reason")


@query("""
select conv_id, turn, case when text = '' then 0.0 when turn % 2 = 0 then 0.5 else 0.0 end::double as score, 0.0::double as bare_score, case when text = '' then 0.0 when turn % 2 = 0 then 0.5 else 0.0 end::double as improvement
from conversations""")
def grounding_improvement(spark: SparkSession, d: str) -> DataFrame:
    """A judge that trusts answers from even turns by half and answers without context not at all; many rows ask the same question."""

    def judge(prompt: str, max_tokens: int, temperature: float) -> tuple[str, int, int]:
        if prompt.startswith("Question:"):
            return "no idea", 1, 1
        return ('{"score": "0.5", "reason": "half"}' if "ANSWER: even" in prompt else '{"score": 0}'), 1, 1

    rows = table(spark, d, "conversations").select(F.lit("What was said?").alias("question"), "text", F.concat(F.when(F.col("turn") % 2 == 0, "even ").otherwise("odd "), "conv_id", F.lit("|"), "turn").alias("answer"))
    told = evaluation.compare_grounding(rows.withColumnRenamed("text", "context"), Inference("judge", client=judge))
    at = F.split(F.split("answer", " ")[1], "[|]")
    return told.select(at[0].cast("long").alias("conv_id"), at[1].cast("long").alias("turn"), "score", "bare_score", "improvement")


@query("""
select i::bigint as pos, 'What is the secret color of ' || (['Xylon', 'Zarcon', 'Quilp', 'Moxie', 'Vortex', 'Blinker', 'Jolt', 'Flux', 'Glint', 'Snark'])[i % 10 + 1] || '?' as question,
  (['Crimson', 'Azure', 'Emerald', 'Amber', 'Indigo', 'Teal', 'Violet', 'Ochre', 'Cyan', 'Magenta'])[i % 10 + 1] as expected from range(25) t(i)""")
def synthetic_questions(spark: SparkSession, d: str) -> DataFrame:
    return questions(facts(spark, 25))


@query("""
select string_agg(repeat('filler ', 50) || 'The secret color of ' || (['Xylon', 'Zarcon', 'Quilp', 'Moxie', 'Vortex', 'Blinker', 'Jolt', 'Flux', 'Glint', 'Snark'])[i % 10 + 1] || ' is ' || (['Crimson', 'Azure', 'Emerald', 'Amber', 'Indigo', 'Teal', 'Violet', 'Ochre', 'Cyan', 'Magenta'])[i % 10 + 1] || '.' || repeat(' filler', 50), ' ' order by i) as text
from range(10) t(i)""")
def synthetic_document(spark: SparkSession, d: str) -> DataFrame:
    return fact_document(facts(spark, 10))


def _document_stream(spark: SparkSession, d: str) -> DataFrame:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{d}/documents.parquet")
    folder = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(path).isDirectory()
    return streaming.read_documents(spark, f"{d}/documents.parquet" if folder else d, "doc_id long, text string", None if folder else "documents.parquet")


@query(_chunks_sql(200, 150, "doc_id, position, text"))
def stream_ingest(spark: SparkSession, d: str) -> DataFrame:
    out = f"{shared_dir(spark)}/quern-{uuid.uuid4().hex}"
    streaming.ingest(streaming.chunk_stream(_document_stream(spark, d), 200, 50), f"{out}/chunks", f"{out}/log").awaitTermination()
    return spark.read.schema("doc_id long, text string, position int, chunk_id string, word_count int, char_count int").parquet(f"{out}/chunks").select("doc_id", "position", "text")


@query(_chunks_sql(200, 150, "doc_id, position, text"))
def stream_into_memory(spark: SparkSession, d: str) -> DataFrame:
    """Documents streamed into a memory; an epoch that comes again changes nothing, nor does compaction."""
    out = f"{shared_dir(spark)}/quern-{uuid.uuid4().hex}"
    embedder = HashEmbedder(8)
    Memory(spark, 8, "cosine").save(f"{out}/memory")
    streaming.ingest_into(_document_stream(spark, d), f"{out}/memory", "documents", embedder, f"{out}/log").awaitTermination()
    again = embedder.embed(chunk_by_words(table(spark, d, "documents").select("doc_id", "text"), 200, 50))
    Memory.load(spark, f"{out}/memory").append(f"{out}/memory", again, once=("documents", 0))
    Memory.compact(spark, f"{out}/memory")
    found = durable(Memory.load(spark, f"{out}/memory").table.select("doc_id", "position", "text"))
    delete(spark, out)
    return found


@query(f"""
with f as (select doc_id // 100 as part, string_agg(text, chr(10) order by doc_id) as text from documents group by all
), d as (select part, {_WORDS} as w from f
), c as (select part, w, unnest(generate_series(0, greatest(0, ceil((len(w) - 200) / 150.0))::int)) as position from d where len(w) > 0)
select part::bigint as part, position::int as position, array_to_string(w[position * 150 + 1:position * 150 + 200], ' ') as text, len(w[position * 150 + 1:position * 150 + 200])::int as word_count from c""")
def chunk_large_files(spark: SparkSession, d: str) -> DataFrame:
    """Text files of a hundred documents each, written by Spark, then read by splits and chunked across their borders."""
    folder = f"{shared_dir(spark)}/quern-files-{uuid.uuid4().hex}"
    docs = table(spark, d, "documents").select(F.floor(F.col("doc_id") / 100).alias("part"), "doc_id", F.coalesce("text", F.lit("")).alias("text"))
    docs.repartition("part").sortWithinPartitions("part", "doc_id").select("part", "text").write.partitionBy("part").text(folder)
    part = F.regexp_extract("source", r"/part=(-?\d+)/", 1).cast("long").alias("part")
    found = durable(chunk_files(spark, f"{folder}/*/*.txt", 200, 50).select(part, "position", "text", "word_count"))
    delete(spark, folder)
    return found


def _answered(prompts: str, key: str) -> str:
    """SQL of the offline generator's answers: the first line below the first header, or the last line."""
    ws, cut = r"\s+", "chr(10) || '[Source: '"
    split = lambda x: f"list_filter(string_split_regex({x}, '{ws}'), lambda w: w <> '')"
    return f"""
a as (select {key}, prompt, {split(f"case when contains(prompt, {cut}) then string_split(substring(prompt, strpos(prompt, {cut}) + 10), chr(10))[2] else string_split(prompt, chr(10))[-1] end")} as w, len({split("prompt")}) as n from {prompts}
), answered as (select {key}, prompt, array_to_string(w[1:1000], ' ') as response, n::int as prompt_tokens, least(len(w), 1000)::int as completion from a)"""


@query(f"with p as ({_filled('default')}), {_answered('p', 'query_id')} select query_id, response, 'first-context-line' as model, prompt_tokens as prompt, completion, prompt_tokens + completion as total, 'extractive' as provider from answered")
def generate_extractive(spark: SparkSession, d: str) -> DataFrame:
    return Inference().generate(_prompts(spark, d, "default")).select("query_id", "response", "model", "tokens_used.prompt", "tokens_used.completion", "tokens_used.total", "provider")


@query("""
select conv_id, turn, 're: ' || coalesce(text, '') as response, 'm' as model, length(coalesce(text, ''))::int as prompt, 1 as completion, (length(coalesce(text, '')) + 3)::int as total, 'mocked' as provider from conversations""")
def generate_mocked(spark: SparkSession, d: str) -> DataFrame:
    """A client that counts its tokens in all itself, as some providers do."""
    llm = Inference("Mocked", "m", client=lambda prompt, max_tokens, temperature: (f"re: {prompt}", len(prompt), 1, len(prompt) + 3))
    asked = table(spark, d, "conversations").select("conv_id", "turn", F.coalesce("text", F.lit("")).alias("prompt"))
    return llm.generate(asked.withColumnRenamed("prompt", "asked"), "asked").select("conv_id", "turn", "response", "model", "tokens_used.prompt", "tokens_used.completion", "tokens_used.total", "provider")


@query("select conv_id, turn, 'try 3: ' || coalesce(text, '') as response from conversations")
def generate_with_retry(spark: SparkSession, d: str) -> DataFrame:
    """A client that fails twice at every prompt."""

    class Failing:
        def __init__(self) -> None:
            self.tries: dict[str, int] = {}

        def __call__(self, prompt: str, max_tokens: int, temperature: float) -> tuple[str, int, int]:
            self.tries[prompt] = self.tries.get(prompt, 0) + 1
            if self.tries[prompt] < 3:
                raise OSError("timeout")
            return f"try {self.tries.pop(prompt)}: {prompt}", 1, 1

    asked = table(spark, d, "conversations").select("conv_id", "turn", F.coalesce("text", F.lit("")).alias("prompt"))
    return Inference("failing", client=Failing()).generate(asked, max_retries=3, backoff=0.0).select("conv_id", "turn", "response")


class _Stops:
    """A client that refuses every seventh document for good, and takes its worker down at the others whose id says so."""

    def __init__(self, stops_at: int | None) -> None:
        self.stops_at = stops_at

    def __call__(self, prompt: str, max_tokens: int, temperature: float) -> tuple[str, int, int]:
        number = int(prompt.partition(":")[0])
        if number % 7 == 0:
            raise ValueError(f"invalid document {number}")
        if self.stops_at is not None and number % 100 == self.stops_at:
            raise SystemExit(f"stopped at {number}")
        return f"{number} has {len(prompt)}", len(prompt), 1


@query("""
with p as (select distinct doc_id, doc_id || ':' || text as prompt from documents where text is not null)
select doc_id, case when doc_id % 7 <> 0 then doc_id || ' has ' || length(prompt) end as response, case when doc_id % 7 <> 0 then length(prompt) + 1 end::int as total,
  case when doc_id % 7 = 0 then 'invalid document ' || doc_id end as error, 1::bigint as times_asked from p""")
def generate_with_ledger(spark: SparkSession, d: str) -> DataFrame:
    """A job over all documents that is stopped, and one that goes on from its ledger: every prompt is answered or refused once over both."""
    asked = table(spark, d, "documents").where("text is not null").select("doc_id", F.concat_ws(":", "doc_id", "text").alias("prompt")).distinct()
    ledger = AnswerLedger(spark, f"{shared_dir(spark)}/quern-ledger-{uuid.uuid4().hex}", buckets=8)
    for stops_at in (50, None):
        try:
            found = ledger.generate(Inference("stops", client=_Stops(stops_at)), asked, batch=16)
        except PySparkException:
            if stops_at is None:
                raise
    times = ledger.rows().groupBy(F.col("key").alias("_key")).agg(F.count("*").alias("times_asked"))
    key = AnswerLedger.key(Inference("stops", client=_Stops(None)), F.col("prompt"), 1000, 0.7)
    out = durable(found.withColumn("_key", key).join(times, "_key").select("doc_id", "response", F.col("tokens_used.total").alias("total"), "error", "times_asked"))
    delete(spark, ledger.path)
    return out


@query("select n_name || chr(10) as text, 'md' as extension, 'markdown' as file_type, 'nation' || n_nationkey || '.md' as source from nation")
def text_source(spark: SparkSession, d: str) -> DataFrame:
    """A file per nation, read whole."""
    folder = f"{shared_dir(spark)}/quern-files-{uuid.uuid4().hex}"
    for r in table(spark, d, "nation").select("n_nationkey", "n_name").toLocalIterator():  # 25 rows at any scale
        create_text(spark, f"{folder}/nation{r.n_nationkey}.md", f"{r.n_name}\n")
    found = durable(ingestable(spark, f"{folder}/*.md").select("text", "extension", "file_type", "source"))
    delete(spark, folder)
    return found


def _hashed(rows: str, key: str) -> str:
    """SQL of the parts (key, at, n) and lengths of hashed vectors of the texts of ``rows``."""
    return f"""
{rows}_b as (select {key}, (('0x' || substr(md5(w), 1, 8))::bigint % 64)::int as "at", count(*)::double as n from (select {key}, unnest(list_filter(string_split_regex(lower(text), '\\s+'), lambda w: w <> '')) as w from {rows}) group by all
), {rows}_n as (select {key}, sqrt(sum(n * n)) as len from {rows}_b group by all)"""


def _found(least: float, k: int) -> str:
    """SQL of ``found``: (query_id, idx, rank, score) of questions q (query_id, text) among chunks ch (idx, text)."""
    return f"""
{_hashed("ch", "idx")}, {_hashed("q", "query_id")}, s as (
  select query_id, idx, sum(q_b.n * ch_b.n) / any_value(q_n.len) / any_value(ch_n.len) as score from q_b join ch_b on q_b."at" = ch_b."at" join q_n using (query_id) join ch_n using (idx) group by 1, 2
), found as (select * from (select *, row_number() over (partition by query_id order by round(score, 6) desc, idx) - 1 as rank from s) where rank < {k} and score >= {least})"""


_CHUNKED = _chunks_sql(200, 150, "doc_id, position, text").strip().removeprefix("with ")
_CHUNKED = _CHUNKED[: _CHUNKED.rindex("select ")]


def _prompted(least: float, k: int, packed: str = "") -> str:
    """SQL of the prompts p (query_id, prompt) from ``found`` and the chunks' texts and sources."""
    head, middle, tail = ("'" + x.replace("'", "''").replace("\n", "' || chr(10) || '") + "'" for x in assembly.TEMPLATES["default"])
    return f"""
{_found(least, k)}, f as (select found.*, text, source from found join ch using (idx)
), g as (select *, sum(length(text)) over w as upto, row_number() over w - 1 as packed from f window w as (partition by query_id order by round(score, 6) desc, rank rows unbounded preceding)
), k as (select query_id, packed, score, source, case when upto > 4000 then substring(text, 1, 4000) else text end as text from g where upto <= 4000 or upto = length(text)
), x as (select query_id, string_agg('[Source: ' || coalesce(source, 'Document ' || (packed + 1)) || ' (.txt) - Score: ' || round_even(score::decimal(38, 18), 3)::decimal(38, 3) || ']' || chr(10) || text, chr(10) || chr(10) order by packed) as context from k group by query_id
), p as (select query_id, {head} || coalesce(context, '') || {middle} || text || {tail} as prompt from q left join x using (query_id))"""


_ENDED = f"""
with {_CHUNKED}, ch as (select lpad(t.doc_id::varchar, 20, '0') || '|' || lpad(position::varchar, 9, '0') as idx, t.text, source from t join documents using (doc_id)
), q as (select item_id as query_id, text from benchmark), {_prompted(0.1, 5)}, {_answered("p", "query_id")}
select query_id, prompt, response, 'extractive' as provider from answered"""


@query(_ENDED)
def query_end_to_end(spark: SparkSession, d: str) -> DataFrame:
    """Documents to chunks to vectors, saved as a memory; every benchmark text as a question: its five nearest chunks, a packed prompt, an answer."""
    embedder, folder = HashEmbedder(64), f"{shared_dir(spark)}/quern-memory-{uuid.uuid4().hex}"
    docs = spread(table(spark, d, "documents").select("doc_id", "text", "source")).withColumns({"file_type": F.lit("text"), "extension": F.lit("txt")})
    Memory(spark, 64, "cosine").add(embedder.embed(chunk_by_words(docs, 200, 50))).save(folder)
    asked = table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), "text")
    found = retrieval.Retriever(Memory.load(spark, folder), embedder, 5, 0.1, ["text", "source", "extension"]).retrieve(asked)
    answers = durable(Inference().generate(assembly.assemble_prompts(asked, found)).select("query_id", "prompt", "response", "provider"))
    delete(spark, folder)
    return answers


@query(_ENDED)
def system_ask(spark: SparkSession, d: str) -> DataFrame:
    """The same through the facade: one system ingests the documents, another finds its memory at the path and answers."""
    config = Config(chunk_size=200, overlap=50, dimension=64, top_k=5, similarity_threshold=0.1, index_path=f"{shared_dir(spark)}/quern-memory-{uuid.uuid4().hex}")
    docs = spread(table(spark, d, "documents").select("doc_id", "text", "source")).withColumns({"file_type": F.lit("text"), "extension": F.lit("txt")})
    MemorySystem(spark, config).ingest(docs)
    asked = table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), "text")
    answers = durable(MemorySystem(spark, config).ask(asked).select("query_id", "prompt", "response", "provider"))
    delete(spark, config.index_path)
    return answers


_DEMO = f"""
with facts as (
  select i as query_id, (['Xylon', 'Zarcon', 'Quilp', 'Moxie', 'Vortex', 'Blinker', 'Jolt', 'Flux', 'Glint', 'Snark'])[i % 10 + 1] as name, (['Crimson', 'Azure', 'Emerald', 'Amber', 'Indigo', 'Teal', 'Violet', 'Ochre', 'Cyan', 'Magenta'])[i % 10 + 1] as color from range(10) t(i)
), documents as (
  select 0 as doc_id, string_agg(repeat('filler ', 50) || 'The secret color of ' || name || ' is ' || color || '.' || repeat(' filler', 50), ' ' order by query_id) as text from facts
), {_CHUNKED}, ch as (select lpad(position::varchar, 9, '0') as idx, text, 'test_doc' as source from t
), q as (select query_id, 'What is the secret color of ' || name || '?' as text from facts), {_prompted(0.1, 2)}, {_answered("p", "query_id")}
, r as (select count(*) filter (where contains(lower(response), lower(color))) as correct, count(*) as total from answered join facts using (query_id))
select 'direct' as flow, 0.0::double as accuracy, 0::bigint as correct, 10::bigint as total, 0.0::double as improvement
union all select 'retrieval', correct / total::double, correct, total, round(correct / total::double, 9) from r"""


@query(_DEMO)  # the offline generator finds no context in the direct prompt and repeats its last line, which names no color
def recall_demo(spark: SparkSession, d: str) -> DataFrame:
    return recall.recall_demo(spark, HashEmbedder(64), Inference())


@query(_chunks_sql(200, 150, "doc_id, position, text"))
def memory_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """Saved, appended to twice and loaded again."""
    docs = table(spark, d, "documents").select("doc_id", "text")
    part = lambda i: chunk_by_words(docs.where(F.pmod("doc_id", F.lit(3)) == i), 200, 50).withColumn("embedding", F.array(F.lit(1.0), F.lit(2.0)))
    folder = f"{shared_dir(spark)}/quern-memory-{uuid.uuid4().hex}"
    Memory(spark, 2, "L2").add(part(0)).save(folder)
    Memory.load(spark, folder).append(folder, part(1))
    grown = durable(Memory.load(spark, folder).append(folder, part(2)).table.select("doc_id", "position", "text"))
    delete(spark, folder)
    return grown


@query(f"""
with ch as (select conv_id * 1000 + turn as idx, text, conv_id, turn from conversations where text <> ''
), asked as (select item_id % 5 as group_id, item_id as qpos, text from benchmark
), q as (select qpos as query_id, text from asked), {_found(0.0, 3)}, f as (select group_id, qpos, found.rank, round(found.score, 6) as score, ch.text from found join asked on qpos = query_id join ch using (idx)
), u as (select *, row_number() over (partition by group_id, text order by score desc, qpos, rank) as n from f
), m as (select *, row_number() over (partition by group_id order by score desc, qpos, rank) - 1 as merged_rank from u where n = 1)
select group_id, merged_rank::int as merged_rank, score + 0.0 as score, text from m where merged_rank < 3""")
def retriever_multi_query(spark: SparkSession, d: str) -> DataFrame:
    """Groups of benchmark texts as queries over the turns of conversations, with the retriever's defaults."""
    embedder = HashEmbedder(64)
    turns = table(spark, d, "conversations").where("text <> ''").select((F.col("conv_id") * 1000 + F.col("turn")).alias("doc_id"), F.lit(0).alias("position"), "text", F.col("turn").cast("string").alias("chunk_id"))
    memory = Memory(spark, 64, "cosine").add(embedder.embed(turns))
    asked = table(spark, d, "benchmark").select((F.col("item_id") % 5).alias("group_id"), F.col("item_id").alias("qpos"), "text")
    return _rounded(retrieval.Retriever(memory, embedder).retrieve_multi_query(asked)).select("group_id", "merged_rank", "score", "text")


@query(f"select doc_id, count(*) as n_chunks, sum(length(text))::bigint as n_chars from ({_chunks_sql(200, 150, 'doc_id, position, text')}) t group by doc_id")
def memory_source(spark: SparkSession, d: str) -> DataFrame:
    """A memory of two appends, read as a data source from SQL."""
    docs = table(spark, d, "documents").select("doc_id", "text")
    part = lambda i: chunk_by_words(docs.where(F.pmod("doc_id", F.lit(2)) == i), 200, 50).withColumn("embedding", F.array(F.lit(1.0), F.lit(2.0)))
    folder = f"{shared_dir(spark)}/quern-memory-{uuid.uuid4().hex}"
    Memory(spark, 2, "L2").add(part(0)).save(folder)
    Memory.load(spark, folder).append(folder, part(1))
    register_memory_source(spark)
    rows = spark.read.format("quern_memory").schema("doc_id long, text string").load(folder)
    counted = durable(spark.sql("select doc_id, count(*) as n_chunks, sum(length(text)) as n_chars from {rows} group by doc_id", rows=rows))
    delete(spark, folder)
    return counted
