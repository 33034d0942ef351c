"""Ranking and coverage metrics of long-form rankings (keys..., question_id, rank, chunk_id).

qrels has (question_id, chunk_id, relevance). A question without relevant chunks is blocked: its metrics are null, never
zero. Questions that a ranking doesn't mention have empty lists and score zero.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

K_VALUES = (1, 5, 10)
#: MRR is always taken at ten.
MRR_K = 10


def relevant(qrels: DataFrame) -> DataFrame:
    """Distinct (question_id, chunk_id) with a positive relevance."""
    return qrels.where("relevance >= 1").select("question_id", "chunk_id").distinct()


def qrel_index(qrels: DataFrame) -> DataFrame:
    """(question_id, n_relevant, chunk_ids): the relevant chunks of each question that has any, sorted."""
    return relevant(qrels).groupBy("question_id").agg(F.count("*").alias("n_relevant"), F.sort_array(F.collect_set("chunk_id")).alias("chunk_ids"))


def relevance_map(qrels: DataFrame, position: str) -> DataFrame:
    """(question_id, relevance): a map from chunk to relevance; of a pair that repeats, the row with the greatest `position` counts."""
    last = qrels.groupBy("question_id", "chunk_id").agg(F.max_by("relevance", position).alias("relevance"))
    return last.groupBy("question_id").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("chunk_id", "relevance")))).alias("relevance"))


def _gain(rank: Column) -> Column:
    return F.lit(1.0) / F.log2(rank + F.lit(1.0))


def ideal_dcg(n_relevant: Column, k: int) -> Column:
    """The DCG of a list that has all relevant chunks first. sequence(1, 0) would count down, so 0 is set apart."""
    best = F.aggregate(F.sequence(F.lit(1), F.greatest(F.least(F.lit(k), n_relevant.cast("int")), F.lit(1))), F.lit(0.0), lambda a, i: a + _gain(i))
    return F.when(n_relevant > 0, best).otherwise(F.lit(0.0))


def with_relevance(rankings: DataFrame, qrels: DataFrame) -> DataFrame:
    hits = relevant(qrels).withColumn("rel", F.lit(1))
    return rankings.join(hits, ["question_id", "chunk_id"], "left").withColumn("rel", F.coalesce("rel", F.lit(0)))


def metric_columns(k_values=K_VALUES) -> list[str]:
    return [f"{m}@{k}" for k in k_values for m in ("recall", "hit", "precision", "ndcg")] + [f"mrr@{MRR_K}"]


def question_metrics(rankings: DataFrame, qrels: DataFrame, questions: DataFrame, k_values=K_VALUES, keys: tuple[str, ...] = ()) -> DataFrame:
    """One row for each question (and each combination of `keys` in `rankings`): blocked, n_relevant and a column for each metric.

    recall@k: hits among the first k over all annotated relevant chunks. hit@k: whether there is one. precision@k: hits over
    min(k, results), 0 without results. ndcg@k: binary gains, ideal over all annotated. mrr@10: the first hit's
    reciprocal rank, 0 beyond ten.
    """
    keys = list(keys)
    marked = with_relevance(rankings, qrels)
    on = lambda k: (F.col("rel") == 1) & (F.col("rank") <= k)
    sums = [F.count("*").alias("n_results"), F.min(F.when(on(MRR_K), F.col("rank"))).alias("first_hit")]
    for k in k_values:
        sums += [F.sum(F.when(on(k), 1).otherwise(0)).alias(f"hits_{k}"), F.sum(F.when(on(k), _gain(F.col("rank"))).otherwise(0.0)).alias(f"dcg_{k}")]
    got = marked.groupBy(*keys, "question_id").agg(*sums)
    asked = questions.select("question_id").distinct()
    if keys:
        asked = asked.crossJoin(F.broadcast(rankings.select(*keys).distinct()))  # configurations are a handful
    rows = asked.join(got, [*keys, "question_id"], "left").join(qrel_index(qrels).select("question_id", "n_relevant"), "question_id", "left")
    rows = rows.withColumn("n_relevant", F.coalesce("n_relevant", F.lit(0))).withColumn("blocked", F.col("n_relevant") == 0)
    n, out = F.coalesce("n_results", F.lit(0)), []
    for k in k_values:
        hits, dcg = F.coalesce(f"hits_{k}", F.lit(0)), F.coalesce(f"dcg_{k}", F.lit(0.0))
        out += [
            (f"recall@{k}", hits / F.col("n_relevant")),
            (f"hit@{k}", F.when(hits > 0, 1.0).otherwise(0.0)),
            (f"precision@{k}", F.when(n == 0, 0.0).otherwise(hits / F.least(F.lit(k), F.greatest(n, F.lit(1))))),
            (f"ndcg@{k}", dcg / F.when(F.col("n_relevant") > 0, ideal_dcg(F.col("n_relevant"), k))),
        ]
    out.append((f"mrr@{MRR_K}", F.coalesce(F.lit(1.0) / F.col("first_hit"), F.lit(0.0))))
    return rows.select(*keys, "question_id", "blocked", "n_relevant", *(F.when(~F.col("blocked"), x).alias(name) for name, x in out))


def stage_recall(rankings: DataFrame, qrels: DataFrame, keys: tuple[str, ...] = ("stage",)) -> DataFrame:
    """(keys..., question_id, recall): distinct relevant chunks in a stage's list over all relevant. Empty stages and blocked questions have no row."""
    found = with_relevance(rankings, qrels).groupBy(*keys, "question_id").agg(F.count_distinct(F.when(F.col("rel") == 1, F.col("chunk_id"))).alias("found"))
    return found.join(qrel_index(qrels).select("question_id", "n_relevant"), "question_id").select(*keys, "question_id", (F.col("found") / F.col("n_relevant")).alias("recall"))


def group_coverage(rankings: DataFrame, groups: DataFrame, questions: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """(keys..., question_id, covered, total, fraction, covered_ids, all_covered) over the whole ranked list.

    `groups` has (group_id, question_id, required, chunk_ids); only required groups count, and any of its chunks covers one. Without
    required groups: 0, 0, 0.0, none, true.
    """
    keys = list(keys)
    needed = groups.where("required").select("question_id", "group_id", "chunk_ids").dropDuplicates(["question_id", "group_id"])
    members = needed.select("question_id", "group_id", F.explode(F.array_distinct("chunk_ids")).alias("chunk_id"))
    covered = rankings.join(members, ["question_id", "chunk_id"]).select(*keys, "question_id", "group_id").distinct()
    covered = covered.groupBy(*keys, "question_id").agg(F.count("*").alias("covered"), F.sort_array(F.collect_list("group_id")).alias("covered_ids"))
    asked = questions.select("question_id").distinct()
    if keys:
        asked = asked.crossJoin(F.broadcast(rankings.select(*keys).distinct()))
    rows = asked.join(needed.groupBy("question_id").agg(F.count("*").alias("total")), "question_id", "left").join(covered, [*keys, "question_id"], "left")
    total, n = F.coalesce("total", F.lit(0)), F.coalesce("covered", F.lit(0))
    return rows.select(
        *keys,
        "question_id",
        n.alias("covered"),
        total.alias("total"),
        F.when(total > 0, n / F.greatest(total, F.lit(1))).otherwise(0.0).alias("fraction"),
        F.coalesce("covered_ids", F.expr("cast(array() as array<string>)")).alias("covered_ids"),
        (n == total).alias("all_covered"),
    )
