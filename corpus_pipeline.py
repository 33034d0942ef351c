"""The training-text pipeline: quality, exact copies, near copies, benchmark leaks, tokens.

Each stage is a function of (spark, docs, sf_dir) whose result is written as Parquet and read again as the next one's docs.
All stages but the last return the columns of documents.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ravenna.llm.bpe import bpe_encode
from ravenna.llm.decontaminate import drop_leaks
from ravenna.llm.exact_dedup import drop_copies
from ravenna.llm.near_dedup import drop_near_copies
from ravenna.llm.quality import quality_scores
from ravenna.session import materialize

#: Documents below this probability of good quality go.
LEAST_QUALITY = 0.5
#: Matches that an encoding task remembers here, where executors still hold what earlier stages touched.
CACHE_ENTRIES = 100_000


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality votes do not reject."""
    own = [f"__own_{k}" if c.lower() in ("held_out", "score") else c for k, c in enumerate(docs.columns)]
    scored = quality_scores(docs.toDF(*own), _table(spark, sf_dir, "labels"))
    return scored.where(F.col("score") >= LEAST_QUALITY).drop("held_out", "score").toDF(*docs.columns)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each text."""
    return drop_copies(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: five-word shingles, similarity of 0.8 or more."""
    return drop_near_copies(docs, shingle_words=5, percent=80)


def leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without passages of the benchmark."""
    return drop_leaks(docs, _table(spark, sf_dir, "benchmark"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document's ids, and whether they decode to its text."""
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    return bpe_encode(docs, path, public_tokenizers.PATTERN, decode=True, cache_entries=CACHE_ENTRIES).select("doc_id", "n_tokens", "ids", F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [("quality", quality), ("exact", exact), ("near", near), ("leaks", leaks), ("tokens", tokens)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each result written and read again."""
    docs = _table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}", None)
    return STAGES[-1][1](spark, docs, sf_dir)


#: The stages are models and searches that SQL doesn't express; tests hold run() against brute force.
ORACLE_SQL = None
