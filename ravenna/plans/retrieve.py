"""All configurations' rankings from shared base searches, in long form."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ravenna.artifacts import Timer
from ravenna.config import Retrieval
from ravenna.operators.dense import dense_search
from ravenna.operators.fusion import overlap_score, rerank, rrf_union
from ravenna.operators.lexical import LexicalIndex, bm25_search, index_for, top_ranked
from ravenna.plans.matrix import Config
from ravenna.session import materialize

SCHEMA = "config_id string, question_id string, stage string, rank int, chunk_id string, score double, bm25_rank int, dense_rank int, rrf_score double, rerank_score double"
TIMINGS = "config_id string, stage string, seconds double, queries long"


def _stage(df: DataFrame, config_id: str, stage: str) -> DataFrame:
    kinds = {"bm25_rank": "int", "dense_rank": "int", "rrf_score": "double", "rerank_score": "double"}
    carried = [F.col(c).cast(t) if c in df.columns else F.lit(None).cast(t).alias(c) for c, t in kinds.items()]
    return df.select(F.lit(config_id).alias("config_id"), "question_id", F.lit(stage).alias("stage"), F.col("rank").cast("int"), "chunk_id", "score", *carried)


def run_matrix(
    chunks: DataFrame,
    queries: DataFrame,
    configs: list[Config],
    vectors: dict[str, DataFrame] | None = None,
    query_vectors: dict[str, DataFrame] | None = None,
    settings: Retrieval | None = None,
    reranker=overlap_score,
    index: LexicalIndex | None = None,
    timings: list[tuple] | None = None,
) -> DataFrame:
    """(SCHEMA) of every configuration and stage, under `settings`: k1, b, normalisation, c, weights and top_n.

    Each base search runs once and is written to the shared folder; configurations are projections of it. Stages: bm25,
    dense, rrf_union (all candidates), rrf_topn, to_rerank and final. Only the searches that `configs` need are run. A row's
    ranks and scores of earlier stages stay beside it; score is what its own list is ranked by. `queries` has (question_id, text),
    `chunks` (chunk_id, text), `vectors` and `query_vectors` one table for each embedding. `index` is a stored lexical index;
    without one, the part that the queries ask for is built. `timings` gets (TIMINGS) of each stage that ran, its seconds for all queries.
    """
    settings, spark = settings or Retrieval(), chunks.sparkSession
    if not configs:
        return spark.createDataFrame([], SCHEMA)
    n_queries, timer, took = queries.count(), Timer(), {}

    def done(df: DataFrame, stage: str, key: str = "") -> DataFrame:
        timer.reset()
        out = materialize(df, f"retrieve-{stage}-{key}")
        took[stage, key] = timer.stop()
        return out

    lexical, how, top_n = None, settings.lexical.how(), settings.top_n
    if any(c.initial_retrieval != "dense" for c in configs):
        searched = index or index_for(chunks, queries, **how)
        lexical = done(bm25_search(searched, queries, top_n, settings.bm25.k1, settings.bm25.b, **how), "bm25").withColumn("bm25_rank", F.col("rank"))
    dense, union, top = {}, {}, {}
    for e in sorted({c.embedding for c in configs if c.embedding}):
        dense[e] = done(dense_search(vectors[e], query_vectors[e], top_n), "dense", e).withColumn("dense_rank", F.col("rank"))
        if any(c.initial_retrieval == "hybrid" and c.embedding == e for c in configs):
            fused = rrf_union(lexical, dense[e], settings.rrf.c, settings.rrf.weight_bm25, settings.rrf.weight_dense)
            union[e] = done(top_ranked(fused, 2**31 - 1, ["question_id"]), "rrf", e).withColumn("rrf_score", F.col("score"))
            top[e] = union[e].where(F.col("rank") <= top_n)
    out = None
    for c in configs:
        stages, ran = [], []
        if c.initial_retrieval != "dense":
            stages.append(_stage(lexical, c.config_id, "bm25"))
            ran.append(("bm25", ""))
        if c.initial_retrieval != "bm25":
            stages.append(_stage(dense[c.embedding], c.config_id, "dense"))
            ran.append(("dense", c.embedding))
        if c.initial_retrieval == "hybrid":
            stages += [_stage(union[c.embedding], c.config_id, "rrf_union"), _stage(top[c.embedding], c.config_id, "rrf_topn")]
            ran.append(("rrf", c.embedding))
        base = {"bm25": lexical, "dense": dense.get(c.embedding), "hybrid": top.get(c.embedding)}[c.initial_retrieval]
        if c.rerank:
            again = done(rerank(base, queries, chunks, reranker), "rerank", c.config_id).withColumn("rerank_score", F.col("score"))
            stages += [_stage(base, c.config_id, "to_rerank"), _stage(again, c.config_id, "final")]
            ran.append(("rerank", c.config_id))
        else:
            stages.append(_stage(base, c.config_id, "final"))
        if timings is not None:
            timings += [(c.config_id, stage, took[stage, key], n_queries) for stage, key in ran]
        for s in stages:
            out = s if out is None else out.unionByName(s)
    return out


def stage_list(rankings: DataFrame, stage: str) -> DataFrame:
    """One stage's rows; an unknown stage has none."""
    return rankings.where(F.col("stage") == stage)


def available(rankings: DataFrame, queries: DataFrame, configs: list[Config]) -> DataFrame:
    """(config_id, question_id, n_available): the candidates that each configuration's base search gave each query, 0 included."""
    spark = rankings.sparkSession
    asked = queries.select("question_id").crossJoin(F.broadcast(spark.createDataFrame([(c.config_id,) for c in configs], "config_id string")))  # a handful of configurations
    counts = stage_list(rankings, "final").groupBy("config_id", "question_id").agg(F.count("*").alias("n"))
    return asked.join(counts, ["config_id", "question_id"], "left").select("config_id", "question_id", F.coalesce("n", F.lit(0)).alias("n_available"))
