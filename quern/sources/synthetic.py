"""Generated recall documents: facts between filler words, and questions about them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Names, colors and filler.
NAMES = ["Xylon", "Zarcon", "Quilp", "Moxie", "Vortex", "Blinker", "Jolt", "Flux", "Glint", "Snark"]
COLORS = ["Crimson", "Azure", "Emerald", "Amber", "Indigo", "Teal", "Violet", "Ochre", "Cyan", "Magenta"]
FILLER, FILLERS = "filler", 50


def facts(spark: SparkSession, n: int = 10) -> DataFrame:
    """(pos, id, color, text) of n facts; names and colors repeat after ten."""
    at = lambda xs: F.element_at(F.array(*map(F.lit, xs)), (F.col("pos") % len(xs) + 1).cast("int"))
    rows = spark.range(n).withColumnRenamed("id", "pos").select("pos", at(NAMES).alias("id"), at(COLORS).alias("color"))
    return rows.withColumn("text", F.concat(F.lit("The secret color of "), "id", F.lit(" is "), "color", F.lit(".")))


def fact_document(facts_df: DataFrame) -> DataFrame:
    """One row: every fact between fillers, in order. A document has to be one value, so the facts are gathered."""
    filler = F.array_join(F.array_repeat(F.lit(FILLER), FILLERS), " ")
    part = F.struct("pos", F.concat_ws(" ", filler, "text", filler).alias("part"))
    return facts_df.agg(F.array_join(F.transform(F.sort_array(F.collect_list(part)), lambda x: x["part"]), " ").alias("text"))


def questions(facts_df: DataFrame) -> DataFrame:
    return facts_df.select("pos", F.concat(F.lit("What is the secret color of "), "id", F.lit("?")).alias("question"), F.col("color").alias("expected"))
