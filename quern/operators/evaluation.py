"""Scores of retrieval and of answers."""

from __future__ import annotations

import json
import time

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..storage import durable
from .assembly import judge_prompt, zero_shot_prompt
from .inference import Inference, judged


def hit_rate(queries: DataFrame, results: DataFrame, truth: DataFrame) -> DataFrame:
    """One row (hits, total, hit_rate): queries with a result of their expected source; queries without truth never hit."""
    met = results.join(truth, "query_id").where(F.col("source") == F.col("expected")).select("query_id").distinct()
    marked = queries.select("query_id").join(met.withColumn("hit", F.lit(1)), "query_id", "left")
    hits, total = F.coalesce(F.sum("hit"), F.lit(0)).cast("long"), F.count("*")
    return marked.agg(hits.alias("hits"), total.alias("total"), F.when(total > 0, hits / total).otherwise(0.0).alias("hit_rate"))


def contains_answer(answer: Column, expected: Column) -> Column:
    return F.contains(F.lower(answer), F.lower(expected))


def accuracy(answers: DataFrame, answer: str = "response", expected: str = "expected") -> DataFrame:
    """One row (accuracy, correct, total); a missing answer is wrong, no rows score 0."""
    right, total = F.coalesce(F.sum(F.coalesce(contains_answer(F.col(answer), F.col(expected)), F.lit(False)).cast("long")), F.lit(0)), F.count("*")
    return answers.agg(F.when(total > 0, right / total).otherwise(0.0).alias("accuracy"), right.alias("correct"), total.alias("total"))


def grounding(answers: DataFrame, llm: Inference, question: str = "question", context: str = "context", answer: str = "answer") -> DataFrame:
    """``answers``, computed once, with score and reason by a judge; without context the score is 0 and nobody is asked."""
    rows = durable(answers.withColumn("_judge", F.when(F.coalesce(F.length(context), F.lit(0)) > 0, judge_prompt(F.col(question), F.col(context), F.col(answer)))))
    asked = llm.generate(rows.where("_judge is not null").select("_judge").distinct(), "_judge").select(F.col("_judge").alias("_asked"), judged(F.col("response")).alias("_verdict"))
    met = rows.join(asked, F.col("_judge") == F.col("_asked"), "left")
    return met.select(*answers.columns, F.coalesce("_verdict.score", F.lit(0.0)).alias("score"), F.coalesce("_verdict.reason", F.lit("")).alias("reason"))


def compare_grounding(questions: DataFrame, llm: Inference) -> DataFrame:
    """questions: (question, context, answer). Each row with the scores of its answer and of one without context, and their difference; equal questions stay rows of their own."""
    bare = llm.generate(questions.select("question", "context", "answer", zero_shot_prompt(F.col("question")).alias("_prompt")), "_prompt")
    told = grounding(bare.select("question", "context", "answer", F.col("response").alias("bare_answer")), llm)
    both = grounding(told.withColumnsRenamed({"score": "_score", "reason": "_reason"}), llm, answer="bare_answer")
    return both.select("question", "context", "answer", F.col("_score").alias("score"), F.col("_reason").alias("reason"), "bare_answer", F.col("score").alias("bare_score")).withColumn("improvement", F.col("score") - F.col("bare_score"))


def latency(retrieve, ask, n: int = 5) -> dict:
    """Mean milliseconds of ``retrieve()`` and of what ``ask()`` reports, over n calls."""
    if n < 1:
        raise ValueError("at least one query is needed")
    spent = asked = 0.0
    for _ in range(n):
        began = time.perf_counter()
        retrieve()
        spent += (time.perf_counter() - began) * 1000
        asked += ask().get("latency_ms", 0)
    return {"avg_retrieval_ms": spent / n, "avg_llm_ms": asked / n, "total_latency_ms": (spent + asked) / n}


class Report:
    """Sections of results, written as JSON."""

    def __init__(self) -> None:
        self.results: dict[str, dict] = {"retrieval_metrics": {}, "answer_quality": {}, "efficiency": {}}

    def write(self, path: str = "evaluation_report.json") -> None:
        with open(path, "w") as f:
            json.dump(self.results, f, indent=4)
