"""Rows for blind human judgement: shuffled, without method names, and the key that tells them."""

from __future__ import annotations

import random

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

SHEET = ("blind_id", "question", "generated_answer", "evidence_context", "context_included_ids", "correctness", "support", "citations_ok", "notes")
SEED = 7
#: Rows that people can judge; more are refused rather than shuffled on the driver.
MOST_ROWS = 100_000


def blind_rows(generations: DataFrame, questions: DataFrame, seed: int = SEED) -> tuple[DataFrame, DataFrame]:
    """(sheet, key): the rows to judge, and (blind_id, question_id, config_id).

    `generations` has (question_id, config_id, response, context_text, context_included), in the order of (question_id, config_id)
    before it is shuffled. The permutation is Python's seeded shuffle, made on the driver from the number of rows alone. An
    unknown question shows its id.
    """
    spark = generations.sparkSession
    n = generations.count()
    if n > MOST_ROWS:
        raise ValueError(f"{n} rows are too many for a sheet")
    order = list(range(n))
    random.Random(seed).shuffle(order)
    places = spark.createDataFrame([(at, f"item-{i:03d}") for i, at in enumerate(order, 1)] or [(-1, "")], "at int, blind_id string")
    at = F.row_number().over(Window.orderBy("question_id", "config_id")) - 1  # at most MOST_ROWS rows
    rows = generations.withColumn("at", at).join(F.broadcast(places), "at").join(questions.select("question_id", F.col("text").alias("question")), "question_id", "left")
    empty = [F.lit("").alias(c) for c in ("correctness", "support", "citations_ok", "notes")]
    sheet = rows.select("blind_id", F.coalesce("question", "question_id").alias("question"), F.col("response").alias("generated_answer"), F.coalesce("context_text", F.lit("")).alias("evidence_context"), F.coalesce(F.array_join("context_included", ", "), F.lit("")).alias("context_included_ids"), *empty)
    return sheet.select(*SHEET), rows.select("blind_id", "question_id", "config_id")
