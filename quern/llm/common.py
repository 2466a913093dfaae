"""Helpers shared by the training-data operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import delete, durable, scratch, shared_dir

__all__ = ["WORD_GAP", "col", "delete", "durable", "lower_ascii", "packed", "read", "scratch", "shared_dir", "small_enough", "unpacked", "words"]

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Separators of the benchmark word rule, as a Java and an RE2 class: every ASCII character but digits and a-z.
WORD_GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def lower_ascii(text: Column) -> Column:
    """Lower-cases A-Z and nothing else; pure ASCII takes the JVM's short way."""
    return F.when(F.length(text) == F.octet_length(text), F.lower(text)).otherwise(F.translate(text, _UPPER, _UPPER.lower()))


def words(text: Column) -> Column:
    """Words of the benchmark rule in order; none for null."""
    return F.array_remove(F.split(lower_ascii(F.coalesce(text, F.lit(""))), WORD_GAP), "")


def col(name: str) -> Column:
    """A column by its exact name, whatever characters that has."""
    return F.col("`" + name.replace("`", "``") + "`")


def packed(df: DataFrame, alias: str = "row") -> Column:
    """All columns as one struct, so that helper columns can't clash with them."""
    return F.struct(*[col(c) for c in df.columns]).alias(alias)


def unpacked(df: DataFrame, columns: list[str], alias: str = "row") -> DataFrame:
    return df.select(*[F.col(alias).getField(c).alias(c) for c in columns])


def small_enough(df: DataFrame, limit: int) -> bool:
    """Whether a (computed) table has at most ``limit`` rows, without counting past it."""
    return df.limit(limit + 1).count() <= limit
