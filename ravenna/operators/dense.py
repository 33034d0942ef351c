"""Exact cosine search over vectors in a table, and the checks that a vector index must pass."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ravenna.errors import ConfigError
from ravenna.operators._best import Best, candidates
from ravenna.operators.lexical import TOP_N, top_ranked
from ravenna.session import ship_package

#: Numbers in a block of broadcast query vectors, and how far blocked products may lie from those of single pairs.
BLOCK_NUMBERS = 4_000_000
SLACK = 1e-9


def _query_blocks(queries: DataFrame, id_col: str, vector_col: str):
    """The query vectors in blocks of bounded size: a stated set, matched block by block."""
    rows = queries.select(F.col(id_col).alias("i"), F.col(vector_col).alias("v"))
    shape = rows.agg(F.count("*").alias("n"), F.max(F.size("v")).alias("d")).first()
    n = shape["n"] * max(shape["d"] or 1, 1)
    blocks = max(1, -(-n // BLOCK_NUMBERS))
    for k in range(blocks):
        part = rows.where(F.pmod(F.xxhash64("i"), F.lit(blocks)) == k).collect()
        if part:
            q = np.array([r["v"] for r in part], np.float64)
            yield [r["i"] for r in part], q / (np.linalg.norm(q, axis=1, keepdims=True) + 1e-12)


def dense_search(vectors: DataFrame, queries: DataFrame, top_n: int = TOP_N, id_col: str = "chunk_id", vector_col: str = "vector", query_id_col: str = "question_id") -> DataFrame:
    """(question_id, chunk_id, score, rank): the min(top_n, corpus) vectors of greatest inner product with the unit query.

    Stored vectors are taken as they are (they should have unit length). Every batch of vectors is multiplied with a
    block of queries, and a task keeps only its own best of each query, ties included, so little reaches the shuffle. Ranked are
    the products of single pairs, unrounded and summed in one order, so equal vectors tie wherever they stand. Null vectors
    are left out. Reading the queries runs a job for each of their blocks.
    """
    spark = vectors.sparkSession
    ship_package(spark)
    ids = vectors.schema[id_col].dataType.simpleString()
    qids = queries.schema[query_id_col].dataType.simpleString()
    rows = vectors.where(F.col(vector_col).isNotNull()).select(F.col(id_col).alias("chunk_id"), F.col(vector_col).alias("v"))
    out = spark.createDataFrame([], f"question_id {qids}, chunk_id {ids}, score double")
    for names, block in _query_blocks(queries, query_id_col, vector_col):
        shared = spark.sparkContext.broadcast((names, block))

        def best(batches, shared=shared):
            names, q = shared.value
            kept = Best(top_n)
            for batch in batches:
                if batch.num_rows:
                    x = batch.column("v").flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(batch.num_rows, -1)
                    row, query = candidates(x @ q.T, top_n, SLACK)
                    kept.add(query, batch.column("chunk_id").take(pa.array(row)), np.einsum("ij,ij->i", x[row], q[query]))
            yield from kept.rows(names)

        out = out.unionByName(rows.mapInArrow(best, f"question_id {qids}, chunk_id {ids}, score double"))
    return top_ranked(out, top_n, ["question_id"])


def vector_problems(vectors: DataFrame, dimension: int, id_col: str = "chunk_id", vector_col: str = "vector", tolerance: float = 1e-3) -> DataFrame:
    """(chunk_id, problem): null, wrong dimension, not finite, not of unit length, and repeated ids."""
    v = F.col(vector_col)
    norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))
    finite = F.forall(v, lambda x: ~F.isnan(x) & (F.abs(x) < float("inf")))
    problem = (
        F.when(v.isNull(), "null")
        .when(F.size(v) != dimension, "dimension")
        .when(F.exists(v, lambda x: x.isNull()), "null")
        .when(~finite, "not finite")
        .when(F.abs(norm - 1) > tolerance, "not of unit length")
    )
    rows = vectors.select(F.col(id_col).alias("chunk_id"), problem.alias("problem"))
    repeated = rows.groupBy("chunk_id").count().where("count > 1").select("chunk_id", F.lit("repeated id").alias("problem"))
    return rows.where("problem is not null").unionByName(repeated)


def normalised(vectors: DataFrame, vector_col: str = "vector") -> DataFrame:
    """`vectors` scaled to unit length, in doubles; zero vectors stay zero."""
    norm = F.sqrt(F.aggregate(vector_col, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))
    return vectors.withColumn("__norm", norm).withColumn(vector_col, F.transform(vector_col, lambda x: F.when(F.col("__norm") == 0, F.lit(0.0)).otherwise(x.cast("double") / F.col("__norm")))).drop("__norm")


def require_cosine(cosine: bool, unit_length: bool) -> None:
    """Dense search is defined for cosine similarity of unit vectors only."""
    if not (cosine and unit_length):
        raise ConfigError("cosine similarity and normalised embeddings are mandatory")
