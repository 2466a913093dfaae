"""Document sources: text files, PDF files, DataFrames."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: File types by extension (fixed values).
FILE_TYPES = {
    "md": "markdown", "py": "python", "js": "javascript", "ts": "typescript", "tsx": "react-typescript", "jsx": "react-javascript", "html": "html", "css": "css", "scss": "sass", "txt": "text", "yaml": "config", "yml": "config", "json": "data", "csv": "data",
    "sql": "database", "sh": "shell", "bash": "shell", "go": "go", "rs": "rust", "c": "c", "cpp": "cpp", "h": "header", "hpp": "header", "java": "java", "rb": "ruby", "php": "php", "env": "config", "pdf": "pdf",
}
DOCUMENT = "doc_id long, text string, source string, file_type string, extension string"


def extension(name: Column) -> Column:
    """The suffix of a file name without its dot, case kept; txt if it has none (a leading dot begins no suffix)."""
    found = F.regexp_extract(name, r"[^/]\.([^./]+)$", 1)
    return F.when(found == "", F.lit("txt")).otherwise(found)


def file_type(ext: Column) -> Column:
    table = F.create_map(*[F.lit(x) for pair in FILE_TYPES.items() for x in pair])
    return F.coalesce(F.try_element_at(table, ext), F.lit("text"))


def with_file_metadata(df: DataFrame, name: str) -> DataFrame:
    """Adds extension and file_type by the column ``name`` of file names."""
    ext = extension(F.col(name))
    return df.withColumn("extension", ext).withColumn("file_type", file_type(ext))


def documents(df: DataFrame, text: str = "text", source: str | None = None, doc_id: str | None = None, kind: str = "text", ext: str = "txt") -> DataFrame:
    """Any table with a text column as documents; an empty source is none."""
    return df.select(
        (F.col(doc_id).cast("long") if doc_id else F.monotonically_increasing_id()).alias("doc_id"),
        F.col(text).alias("text"),
        (F.nullif(F.col(source).cast("string"), F.lit("")) if source else F.lit(None).cast("string")).alias("source"),
        F.lit(kind).alias("file_type"),
        F.lit(ext).alias("extension"),
    )


def _base_name(path: Column) -> Column:
    return F.url_decode(F.replace(F.element_at(F.split(path, "/"), -1), F.lit("+"), F.lit("%2B")))


def _as_documents(df: DataFrame) -> DataFrame:
    name = _base_name(F.col("path"))
    named = with_file_metadata(df.withColumn("source", name), "source")
    return named.select(F.xxhash64("path").alias("doc_id"), "text", "source", "file_type", "extension")


def text_files(spark: SparkSession, path: str) -> DataFrame:
    """One document per file, whole; source is the file's name."""
    whole = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))
    return _as_documents(whole)


def _pdf_pages(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    from io import BytesIO

    from pypdf import PdfReader

    for batch in batches:
        texts = ["".join(f"{page.extract_text()}\n" for page in PdfReader(BytesIO(content)).pages) for content in batch["content"]]
        yield pd.DataFrame({"path": batch["path"], "text": texts})


def pdf_files(spark: SparkSession, path: str) -> DataFrame:
    """One document per PDF file: the text of each page and a line end. Needs pypdf."""
    try:
        import pypdf  # noqa: F401
    except ImportError as e:
        raise RuntimeError("Install pypdf to ingest PDF files: pip install pypdf") from e
    return _as_documents(spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(_pdf_pages, "path string, text string"))


def ingestable(spark: SparkSession, path: str) -> DataFrame:
    """The documents of a file, by its extension (case-sensitive: .PDF is read as text)."""
    return pdf_files(spark, path) if path.endswith(".pdf") else text_files(spark, path)
