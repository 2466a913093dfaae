"""Packing results into prompts under a budget of characters: window sums and ordered gathering."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import fmt3

MAX_CONTEXT = 4000
#: Prompt templates as (before the context, between context and query, after the query); fixed values.
TEMPLATES = {
    "default": (
        "You are a helpful assistant. Use the following context to answer the question.\n\nCONTEXT:\n",
        "\n\nQUESTION:\n",
        "\n\nProvide a concise and accurate answer based on the context above.",
    ),
    "instructional": (
        "Answer the user's question by following these steps:\n1. Read the provided context carefully.\n2. Identify the key facts.\n3. Formulate a structured response.\n\nCONTEXT:\n",
        "\n\nQUESTION:\n",
        "",
    ),
}


def _best_first(group: str, pos: str, lowest_first: bool):
    score = F.coalesce("score", F.lit(0.0))
    return W.partitionBy(group).orderBy(score.asc() if lowest_first else score.desc(), pos)


def truncate_to_fit(results: DataFrame, max_length: int = MAX_CONTEXT, group: str = "query_id", pos: str = "rank", lowest_first: bool = False) -> DataFrame:
    """Each group's results by score (highest first; missing counts as 0) up to the first whose text would overflow.

    That one is dropped, unless nothing before it has any text: then it is cut. Nothing after it is taken, however
    short. ``lowest_first`` orders distances best first. Adds ``packed``, the place from 0.
    """
    w = _best_first(group, pos, lowest_first)
    length = F.length("text").cast("long")
    summed = results.withColumn("_to", F.sum(length).over(w.rowsBetween(W.unboundedPreceding, 0))).withColumn("packed", F.row_number().over(w) - 1)
    fits = (F.col("_to") <= max_length) | (F.col("_to") == length)
    cut = F.when(F.col("_to") > max_length, F.substring("text", 1, max_length)).otherwise(F.col("text"))
    return summed.where(fits).withColumn("text", cut).drop("_to")


def _joined(df: DataFrame, group: str, order: str, part: Column, between: str, to: str) -> DataFrame:
    items = F.sort_array(F.collect_list(F.struct(F.col(order).alias("i"), part.alias("part"))))
    return df.groupBy(group).agg(F.array_join(F.transform(items, lambda x: x["part"]), between).alias(to))


def contexts(packed: DataFrame, group: str = "query_id") -> DataFrame:
    """(group, context): the packed results under their headers; source defaults to the place's number, extension to txt."""
    source = F.coalesce("source", F.concat(F.lit("Document "), (F.col("packed") + 1).cast("string")))
    header = F.concat(F.lit("[Source: "), source, F.lit(" (."), F.coalesce("extension", F.lit("txt")), F.lit(") - Score: "), fmt3(F.coalesce("score", F.lit(0.0))), F.lit("]\n"), F.col("text"))
    return _joined(packed, group, "packed", header, "\n\n", "context")


def fill(template: str, context: Column, query: Column) -> Column:
    """The template around them; an unknown name is the default one. Pieces are joined, so braces in texts stay."""
    head, middle, tail = TEMPLATES.get(template, TEMPLATES["default"])
    return F.concat(F.lit(head), context, F.lit(middle), query, F.lit(tail))


def assemble_prompts(queries: DataFrame, results: DataFrame, template: str = "default", max_length: int = MAX_CONTEXT, group: str = "query_id", pos: str = "rank", lowest_first: bool = False) -> DataFrame:
    """(query_id, prompt) of every query (query_id, text), also of those without results."""
    found = contexts(truncate_to_fit(results, max_length, group, pos, lowest_first), group)
    return queries.join(found, group, "left").select(group, fill(template, F.coalesce("context", F.lit("")), F.col("text")).alias("prompt"))


def histories(turns: DataFrame, group: str = "conv_id", turn: str = "turn") -> DataFrame:
    """(conv_id, history): a line per turn, the role in capitals (user if missing)."""
    line = F.concat(F.upper(F.coalesce("role", F.lit("user"))), F.lit(": "), F.coalesce("text", F.lit("")), F.lit("\n"))
    return _joined(turns, group, turn, line, "", "history")


def conversational_prompts(prompts: DataFrame, turns: DataFrame, group: str = "conv_id", turn: str = "turn") -> DataFrame:
    """Prompts (conv_id, prompt) behind their conversation's history; plain where there is none."""
    met = prompts.join(histories(turns, group, turn), group, "left")
    full = F.concat(F.lit("CONVERSATION HISTORY:\n"), "history", F.lit("\nCURRENT TASK:\n"), "prompt")
    return met.select(group, F.when(F.coalesce(F.length("history"), F.lit(0)) > 0, full).otherwise(F.col("prompt")).alias("prompt"))


def citations(results: DataFrame, group: str = "query_id", pos: str = "rank") -> DataFrame:
    """(group, citations): "[1] source" lines in input order."""
    n = F.row_number().over(W.partitionBy(group).orderBy(pos)).cast("string")
    numbered = results.withColumn("_n", n.cast("int")).withColumn("_c", F.concat(F.lit("["), n, F.lit("] "), F.coalesce("source", F.concat(F.lit("Chunk "), n))))
    items = F.sort_array(F.collect_list(F.struct("_n", "_c")))
    return numbered.groupBy(group).agg(F.transform(items, lambda x: x["_c"]).alias("citations"))


def joined_context(results: DataFrame, group: str = "query_id", pos: str = "rank") -> DataFrame:
    """(group, context): the texts alone, a line each."""
    return _joined(results, group, pos, F.col("text"), "\n", "context")


#: Pieces of the prompts without context and with a whole document; fixed values.
ZERO_SHOT = ("Question: ", "\nAnswer based on your general knowledge:")
DIRECT = ("Use the following document to answer the question.\n\nDOCUMENT:\n", "\n\nQUESTION: ", "\nAnswer only the color name.")


def zero_shot_prompt(question: Column) -> Column:
    return F.concat(F.lit(ZERO_SHOT[0]), question, F.lit(ZERO_SHOT[1]))


def direct_prompt(document: Column, question: Column) -> Column:
    return F.concat(F.lit(DIRECT[0]), document, F.lit(DIRECT[1]), question, F.lit(DIRECT[2]))


def judge_prompt(question: Column, context: Column, answer: Column) -> Column:
    """Asks how well the answer rests on the context, as JSON with score and reason."""
    return F.concat(
        F.lit("Judge whether the ANSWER below rests on the CONTEXT alone. Knowledge from elsewhere doesn't count as support, even if it is true.\n\nQUESTION: "), question, F.lit("\nCONTEXT: "), context, F.lit("\nANSWER: "), answer,
        F.lit("\n\nGo through the claims of the answer. The score is the share of them that the context states: 1.0 if it states all, less for each that it doesn't, 0.0 as soon as it contradicts one.\n"),
        F.lit('Reply with one JSON object and nothing else, its keys "score" (a number from 0 to 1) and "reason" (one sentence).'),
    )
