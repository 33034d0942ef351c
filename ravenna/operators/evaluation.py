"""Roll-ups of question metrics: means, means by article, timings, coverage and paired differences."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ravenna.operators.metrics import K_VALUES, metric_columns


def _means(k_values) -> list:
    return [F.avg(F.col(f"`{m}`")).alias(m) for m in metric_columns(k_values)]


def config_means(metrics: DataFrame, k_values=K_VALUES) -> DataFrame:
    """(config_id, n_questions_evaluated, n_blocked, means...): blocked questions are in no mean; without others it is null."""
    return metrics.groupBy("config_id").agg(F.sum(F.when(~F.col("blocked"), 1).otherwise(0)).alias("n_questions_evaluated"), F.sum(F.when(F.col("blocked"), 1).otherwise(0)).alias("n_blocked"), *_means(k_values))


def article_means(metrics: DataFrame, questions: DataFrame, k_values=K_VALUES) -> DataFrame:
    """(config_id, origin_doc_id, n, means...) by the questions' origin article; '?' where it is unknown."""
    origin = questions.select("question_id", "origin_doc_id").dropDuplicates(["question_id"])
    rows = metrics.where(~F.col("blocked")).join(origin, "question_id", "left").withColumn("origin_doc_id", F.coalesce("origin_doc_id", F.lit("?")))
    return rows.groupBy("config_id", "origin_doc_id").agg(F.count("*").alias("n"), *_means(k_values))


def coverage_summary(coverage: DataFrame, metrics: DataFrame) -> DataFrame:
    """(config_id, mean_fraction, questions_with_groups, questions_all_covered) over unblocked questions with required groups."""
    open_ = metrics.where(~F.col("blocked")).select("config_id", "question_id")
    rows = coverage.join(open_, ["config_id", "question_id"], "left_semi").where("total > 0")
    return rows.groupBy("config_id").agg(F.avg("fraction").alias("mean_fraction"), F.count("*").alias("questions_with_groups"), F.sum(F.col("all_covered").cast("long")).alias("questions_all_covered"))


def mean_timings(timings: DataFrame) -> DataFrame:
    """(config_id, stage, mean_seconds) a query; blocked questions count, nulls don't.

    `timings` has (config_id, stage, seconds), one row a query, or with `queries` one row for so many queries together.
    """
    n = F.col("queries") if "queries" in timings.columns else F.lit(1)
    return timings.where("seconds is not null").groupBy("config_id", "stage").agg((F.sum("seconds") / F.nullif(F.sum(n), F.lit(0))).alias("mean_seconds"))


def paired_deltas(metrics: DataFrame, comparisons: DataFrame, metric: str) -> DataFrame:
    """(label, a, b, n, mean_delta, deltas): a minus b over questions that both sides evaluated.

    deltas has (question_id, delta) in the order of the ids. A comparison whose configurations were not run, or a metric that was
    not computed, has n 0 and a null mean.
    """
    if metric not in metrics.columns:
        return comparisons.select("label", "a", "b", F.lit(0).cast("long").alias("n"), F.lit(None).cast("double").alias("mean_delta"), F.expr("cast(array() as array<struct<question_id: string, delta: double>>)").alias("deltas"))
    open_ = metrics.where(~F.col("blocked") & F.col(f"`{metric}`").isNotNull()).select("config_id", "question_id", F.col(f"`{metric}`").alias("value"))
    side = lambda s: open_.select(F.col("config_id").alias(s), "question_id", F.col("value").alias(f"value_{s}"))
    pairs = F.broadcast(comparisons.select("label", "a", "b"))  # a handful of configurations
    rows = side("a").join(pairs, "a").join(side("b"), ["b", "question_id"]).withColumn("delta", F.col("value_a") - F.col("value_b"))
    summed = rows.groupBy("label", "a", "b").agg(F.count("*").alias("n"), F.avg("delta").alias("mean_delta"), F.sort_array(F.collect_list(F.struct("question_id", "delta"))).alias("deltas"))
    return comparisons.select("label", "a", "b").join(summed, ["label", "a", "b"], "left").withColumn("n", F.coalesce("n", F.lit(0).cast("long")))


def encoding_times(times: DataFrame) -> DataFrame:
    """(embedding, n, mean_seconds, total_seconds) of (embedding, seconds), one row a query, or with `queries` one for so many together."""
    n = F.sum(F.col("queries") if "queries" in times.columns else F.lit(1))
    return times.groupBy("embedding").agg(n.alias("n"), (F.sum("seconds") / F.nullif(n, F.lit(0))).alias("mean_seconds"), F.sum("seconds").alias("total_seconds"))
