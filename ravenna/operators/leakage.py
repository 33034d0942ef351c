"""Evaluation-only text must not reach a retriever."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ravenna.functions.text import stripped


def retrieval_queries(questions: DataFrame) -> DataFrame:
    """(question_id, text): all that a retriever may see of a question."""
    return questions.select("question_id", stripped(F.col("text")).alias("text"))


def leaks(queries: DataFrame, questions: DataFrame) -> DataFrame:
    """(question_id, leaked): 'expected_answer' or 'origin_doc_id' of `questions` contained in a query's text, whatever the case."""
    rows = queries.select("question_id", F.lower("text").alias("query")).join(questions.select("question_id", "expected_answer", "origin_doc_id"), "question_id")
    secret = lambda c: F.lower(stripped(F.coalesce(F.col(c).cast("string"), F.lit(""))))
    found = F.filter(F.array(*(F.when((secret(c) != "") & F.contains(F.col("query"), secret(c)), F.lit(c)) for c in ("expected_answer", "origin_doc_id"))), lambda x: x.isNotNull())
    return rows.select("question_id", F.explode(found).alias("leaked"))


def require_no_leaks(queries: DataFrame, questions: DataFrame) -> DataFrame:
    """`queries`, failing when it is run if one leaks."""
    bad = leaks(queries, questions).groupBy("question_id").agg(F.sort_array(F.collect_set("leaked")).alias("leaked"))
    rows = queries.join(bad, "question_id", "left")
    return rows.withColumn("text", F.when(F.col("leaked").isNotNull(), F.raise_error(F.concat(F.lit("leak in "), F.col("question_id")))).otherwise(F.col("text"))).drop("leaked")
