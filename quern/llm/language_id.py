"""Language identification by compression.

Each language is a zstandard raw-content dictionary: pieces from all over a bounded, documented sample of labelled
documents. A text is cut into blocks; each block is compressed with every language's dictionary, in front of a passage
of it whose own size is taken off, so that a block of any length is encoded alike. The language with the smallest total
wins; whole texts are encoded, long ones block by block. Languages may be any number: their coders are held ``AT_ONCE`` at a
time (64 KB of dictionary each go to every worker).

Defined results: null texts and texts without a letter are ``und`` with score 0; documents with a null
language or a blank text teach nothing; rows that repeat id and text teach once; equal sizes go to the language that
sorts first and are rejected; without any labelled document everything is ``und``; an empty table gives no rows; other
columns are never looked at and may have any names.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import col, durable, packed, read, small_enough, unpacked

#: The bounded sample: documents of a language, and the bytes that all of them give to its dictionary.
SAMPLE_DOCS, DICTIONARY_BYTES = 256, 65_536
#: A document's pieces, evenly spaced over its cleaned text: how many at most, and bytes of each.
PIECES, PIECE = 16, 256
#: Bytes of a block, and of the passage behind it: short enough that the dictionary and not the text's own start decides.
BLOCK, PAD = 1_024, 600
#: Lazy matching: of the levels tried the one that is right at every length (greedy ones lose long texts, optimal ones short ones).
LEVEL = 9
#: Languages whose coders are held at once, and samples and languages (some 50 bytes each) that are broadcast.
AT_ONCE, BROADCAST_ROWS = 64, 500_000
#: Relative distance of the two smallest sizes below which a text is rejected.
MARGIN = 0.005

_NOT_LETTERS = re.compile(r"[\W\d_]+")
SCHEMA = [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("margin", T.DoubleType()), T.StructField("rejected", T.BooleanType())]


def clean(text: str) -> str:
    """Lower-cased letters; everything between them is one space."""
    return _NOT_LETTERS.sub(" ", text.lower()).strip()


def pieces(text: str) -> list[bytes]:
    """Up to ``PIECES`` pieces of the cleaned text from its beginning to its end, in an order in which the first few are far apart."""
    data = clean(text).encode()
    n = min(PIECES, -(-len(data) // PIECE))
    at = [(len(data) - PIECE) * i // (n - 1) if n > 1 else 0 for i in range(n)]
    return [data[max(0, at[k]) : max(0, at[k]) + PIECE] for k in sorted(range(n), key=lambda i: (i * 7 + n // 2) % max(1, n))]


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = pa.array([pieces(t) for t in batch.column("text").to_pylist()], pa.list_(pa.binary()))
        yield pa.RecordBatch.from_arrays([batch.column("lang"), batch.column("h"), found], names=["lang", "h", "pieces"])


def learn(labelled: DataFrame, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id") -> dict[str, bytes]:
    """A dictionary per language from the ``SAMPLE_DOCS`` different documents whose hash is lowest (a bounded sample; its size doesn't follow the input).

    Hashes are of id and text. Different ones are counted per language, and only those in the lowest share of about
    four samples are ranked, so what moves is bounded too; a language with fewer is ranked whole.
    """
    kept = labelled.where(col(lang_col).isNotNull() & (F.length(F.trim(col(text_col))) > 0))
    rows = kept.select(col(lang_col).cast("string").alias("lang"), col(text_col).cast("string").alias("text"), F.xxhash64(col(id_col).cast("string"), col(text_col).cast("string")).alias("h"))
    few = lambda df: F.broadcast(df) if small_enough(df, BROADCAST_ROWS) else df
    counts = rows.groupBy("lang").agg(F.approx_count_distinct("h").alias("n"))
    cuts = durable(counts.select("lang", (F.lit(-float(1 << 63)) + F.least(F.lit(1.0), 4 * SAMPLE_DOCS / F.col("n")) * F.lit(float((1 << 64) - 4096))).cast("bigint").alias("cut")))
    low = rows.select("lang", "h").join(few(cuts), "lang").where("h <= cut").groupBy("lang", "h").agg(F.count("*").alias("n"))
    ranked = low.withColumn("rn", F.row_number().over(W.partitionBy("lang").orderBy("h"))).where(F.col("rn") <= SAMPLE_DOCS)
    sample = durable(ranked.select("lang", "h"))
    taught = rows.join(few(sample), ["lang", "h"]).mapInArrow(_pieces, "lang string, h bigint, pieces array<binary>").dropDuplicates(["lang", "h"])
    texts: dict[str, list[tuple[int, list[bytes]]]] = {}
    for r in taught.toLocalIterator():  # SAMPLE_DOCS x PIECES x PIECE bytes a language
        texts.setdefault(r.lang, []).append((r.h, r.pieces))
    out = {}
    for lang in sorted(texts):
        documents = [p for _, p in sorted(texts[lang], key=lambda x: x[0])]
        joined = b" ".join(p[i] for i in range(PIECES) for p in documents if i < len(p) and p[i])
        if joined:
            out[lang] = bytes(joined[:DICTIONARY_BYTES])
    return out


def scores(sizes: dict[str, int], n_bytes: int) -> tuple[str, float, float]:
    """Language, score in (0, 1) and relative margin of a text's sizes."""
    ranked = sorted(sizes.items(), key=lambda x: (x[1], x[0]))
    best, size = ranked[0]
    margin = 1.0 if len(ranked) == 1 else (ranked[1][1] - size) / max(1, ranked[1][1])
    # bits a byte of text, sharpened: the softmax of the compressed lengths of a fixed amount of text
    total = sum(math.exp(-40 * (s - size) / max(8, n_bytes)) for _, s in ranked)
    return best, 1 / total, margin


class Coders:
    """Sizes of texts under each language's dictionary."""

    def __init__(self, dictionaries: dict[str, bytes]) -> None:
        import zstandard as zstd

        params = zstd.ZstdCompressionParameters.from_level(LEVEL, write_content_size=0, write_checksum=0, write_dict_id=0)
        self.of = []
        for content in dictionaries.values():
            d = zstd.ZstdCompressionDict(content, dict_type=zstd.DICT_TYPE_RAWCONTENT)
            d.precompute_compress(compression_params=params)
            coder = zstd.ZstdCompressor(dict_data=d, compression_params=params)
            pad = b" " + content[len(content) // 2 :][:PAD]
            self.of.append((coder.compress, pad, len(coder.compress(pad))))

    def sizes(self, data: bytes) -> list[int]:
        blocks = [data[i : i + BLOCK] for i in range(0, len(data), BLOCK)]
        return [sum(max(0, len(compress(b + pad)) - alone) for b in blocks) for compress, pad, alone in self.of]


def _classify(dictionaries: dict[str, bytes], margin: float, text_col: str, apart: bool):
    languages = sorted(dictionaries)
    groups = [{x: dictionaries[x] for x in languages[i : i + AT_ONCE]} for i in range(0, len(languages), AT_ONCE)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [Coders(groups[0])] if len(groups) == 1 else []
        for batch in batches:
            texts = batch.column(1) if apart else batch.column(0).field(text_col)
            letters = [clean(text).encode() if text else b"" for text in texts.cast(pa.string()).to_pylist()]
            told = [i for i, data in enumerate(letters) if any(map(str.isalpha, data.decode()))]
            sizes: list[list[int]] = [[] for _ in letters]
            for coders in held or map(Coders, groups):
                for i in told:
                    sizes[i] += coders.sizes(letters[i])
            found = [("und", 0.0, 0.0, True)] * len(letters)
            for i in told if languages else ():
                best, score, distance = scores(dict(zip(languages, sizes[i], strict=True)), len(letters[i]))
                found[i] = (best, score, distance, distance < margin)
            columns = [pa.array([x[i] for x in found], kind) for i, kind in enumerate((pa.string(), pa.float64(), pa.float64(), pa.bool_()))]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names=["row", "lang_pred", "score", "margin", "rejected"])

    return run


def identify(df: DataFrame, dictionaries: dict[str, bytes], text_col: str = "text", margin: float = MARGIN, keep: list[str] | None = None) -> DataFrame:
    """(row, lang_pred, score, margin, rejected): the columns ``keep`` of ``df`` (all if None) as the struct ``row``, and the verdict on the whole text."""
    keep = df.columns if keep is None else keep
    apart = text_col not in keep
    rows = df.select(packed(df.select(*map(col, keep))), *([col(text_col).alias("whole_text")] if apart else []))
    kind = T.StructType([rows.schema["row"], *SCHEMA])
    return rows.mapInArrow(_classify(dictionaries, margin, text_col, apart), kind)


def keep_identified(df: DataFrame, dictionaries: dict[str, bytes], text_col: str = "text", margin: float = MARGIN) -> DataFrame:
    """The rows whose language is told clearly, with all their columns."""
    return unpacked(identify(df, dictionaries, text_col, margin).where("not rejected"), df.columns)


def training_rows(documents: DataFrame) -> DataFrame:
    """Documents whose crc32 of the id as text isn't 2 modulo 4; only these teach."""
    return documents.where(F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")), F.lit(4)) != 2)


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    found = identify(docs, learn(training_rows(docs)), keep=["doc_id"])
    held_out = F.pmod(F.crc32(F.coalesce(F.col("row.doc_id").cast("string"), F.lit("")).cast("binary")), F.lit(4)) == 2
    return found.select("row.doc_id", held_out.alias("held_out"), "lang_pred", "score", "margin", "rejected")
