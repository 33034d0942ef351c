"""Reciprocal rank fusion of two ranked lists, and reranking of the fused candidates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ravenna.operators.lexical import RANKED_DECIMALS, TOP_N, top_ranked

RRF_C = 60.0


def rrf_union(bm25: DataFrame, dense: DataFrame, c: float = RRF_C, weight_bm25: float = 1.0, weight_dense: float = 1.0) -> DataFrame:
    """(question_id, chunk_id, bm25_rank, dense_rank, score): all candidates of both lists (question_id, chunk_id, rank).

    A chunk's score is the sum of weight / (c + rank) over the lists that have it.
    """
    none = F.lit(None).cast("int")
    both = bm25.select("question_id", "chunk_id", F.col("rank").cast("int").alias("bm25_rank"), none.alias("dense_rank")).unionByName(
        dense.select("question_id", "chunk_id", none.alias("bm25_rank"), F.col("rank").cast("int").alias("dense_rank"))
    )
    merged = both.groupBy("question_id", "chunk_id").agg(F.min("bm25_rank").alias("bm25_rank"), F.min("dense_rank").alias("dense_rank"))
    part = lambda w, r: F.coalesce(F.lit(float(w)) / (F.lit(float(c)) + F.col(r)), F.lit(0.0))
    return merged.withColumn("score", F.round(part(weight_bm25, "bm25_rank") + part(weight_dense, "dense_rank"), RANKED_DECIMALS))


def rrf_fuse(bm25: DataFrame, dense: DataFrame, top_n: int = TOP_N, **how: float) -> DataFrame:
    """The union's `top_n` best of each question with their rank."""
    return top_ranked(rrf_union(bm25, dense, **how), top_n, ["question_id"])


def overlap_score(query: Column, text: Column) -> Column:
    """A deterministic stand-in for a reranking model: the share of the query's distinct words that the text has.

    It makes the reranking stage runnable without models; it says nothing about their quality.
    """
    from ravenna.functions.text import lexical_tokens

    words = F.array_distinct(lexical_tokens(query))
    return F.when(F.size(words) == 0, F.lit(0.0)).otherwise(F.size(F.array_intersect(words, lexical_tokens(text))) / F.size(words))


def rerank(candidates: DataFrame, queries: DataFrame, chunks: DataFrame, score=overlap_score) -> DataFrame:
    """The same candidates (question_id, chunk_id, rank, ...) in a new order by `score(query text, chunk text)`.

    `score` is a function of two columns that gives a column, for instance a pandas UDF around a model. Their former rank
    stays as base_rank. Nothing is added or lost: candidates whose text is missing are scored by an empty text.
    """
    joined = candidates.withColumnRenamed("rank", "base_rank").drop("score")
    joined = joined.join(chunks.select("chunk_id", F.col("text").alias("__text")), "chunk_id", "left").join(queries.select("question_id", F.col("text").alias("__query")), "question_id", "left")
    scored = joined.withColumn("score", F.round(score(F.trim(F.coalesce("__query", F.lit(""))), F.coalesce("__text", F.lit(""))), RANKED_DECIMALS)).drop("__text", "__query")
    return top_ranked(scored, 2**31 - 1, ["question_id"])
