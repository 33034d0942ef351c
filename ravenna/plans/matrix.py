"""The configurations of an experiment and the comparisons between them."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

RERANKED = "_rerank"
#: The comparisons' labels.
PIPELINE_TOTAL, HYBRID, RERANK_DENSE, RERANK_HYBRID, HYBRID_RERANKED = "pipeline_total", "hibridizacao", "rerank_dense", "rerank_hybrid", "hibridizacao_com_rerank"
MATRIX_SCHEMA = "position int, config_id string, initial_retrieval string, embedding string, rerank boolean"


@dataclass(frozen=True)
class Config:
    config_id: str
    initial_retrieval: str  # bm25, dense or hybrid
    embedding: str | None
    rerank: bool


def build_matrix(embeddings: list[str]) -> list[Config]:
    """BM25, then a dense and a hybrid configuration for each embedding, each without and with reranking: 2 + 4 E."""
    bases = [("bm25", "bm25", None)]
    for e in embeddings:
        bases += [(f"dense_{e}", "dense", e), (f"hybrid_{e}", "hybrid", e)]
    return [Config(name + RERANKED * again, kind, e, again) for name, kind, e in bases for again in (False, True)]


def matrix_frame(spark: SparkSession, embeddings: list[str]) -> DataFrame:
    return spark.createDataFrame([(i, c.config_id, c.initial_retrieval, c.embedding, c.rerank) for i, c in enumerate(build_matrix(embeddings))], MATRIX_SCHEMA)


def select_matrix(matrix: DataFrame, select: list[str] | None = None, include_reranker: bool = True) -> DataFrame:
    """Configurations whose id contains one of the patterns; None, 'all' and '*' stand for all. Their order stays."""
    out = matrix
    if select is not None and not {"all", "*"} & set(select):
        hit = F.lit(False)
        for pattern in select:
            hit = hit | F.col("config_id").contains(pattern)
        out = out.where(hit)
    return out if include_reranker else out.where(~F.col("rerank"))


def base_config_id(config_id: Column) -> Column:
    """The configuration that a reranking one starts from."""
    return F.regexp_replace(config_id, RERANKED + "$", "")


def comparisons(spark: SparkSession, embeddings: list[str]) -> DataFrame:
    """Five paired comparisons (label, a, b) for each embedding: the whole chain, fusion and reranking, each alone."""
    rows = []
    for e in embeddings:
        dense, hybrid = f"dense_{e}", f"hybrid_{e}"
        rows += [
            (PIPELINE_TOTAL, hybrid + RERANKED, dense),
            (HYBRID, hybrid, dense),
            (RERANK_DENSE, dense + RERANKED, dense),
            (RERANK_HYBRID, hybrid + RERANKED, hybrid),
            (HYBRID_RERANKED, hybrid + RERANKED, dense + RERANKED),
        ]
    return spark.createDataFrame(rows, "label string, a string, b string")
