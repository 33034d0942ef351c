"""BM25 over an inverted index kept as tables: postings, document lengths, term frequencies and corpus statistics."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ravenna.functions.text import lexical_tokens
from ravenna.operators._best import Best, candidates
from ravenna.session import materialize, ship_package

K1, B, TOP_N = 1.2, 0.75, 50
#: Decimals at which scores are compared. Sums of doubles depend on their order, and equal texts must tie.
RANKED_DECIMALS = 9
BROADCAST_ROWS = 200_000
#: Query terms and queries of a block, and numbers of the matrix that a batch of chunks is turned into.
BLOCK_ROWS, BLOCK_QUERIES, BLOCK_NUMBERS = 8192, 512, 4_000_000


@dataclass
class LexicalIndex:
    postings: DataFrame  # chunk_id, term, tf
    lengths: DataFrame  # chunk_id, doc_len: every chunk, also those without tokens
    terms: DataFrame  # term, df
    stats: DataFrame  # n_docs, avgdl, total_tokens: one row


def _corpus(lengths: DataFrame) -> DataFrame:
    return lengths.agg(F.count("*").alias("n_docs"), F.coalesce(F.avg("doc_len"), F.lit(0.0)).alias("avgdl"), F.coalesce(F.sum("doc_len"), F.lit(0)).alias("total_tokens"))


def build_index(chunks: DataFrame, id_col: str = "chunk_id", text_col: str = "text", **how: bool) -> LexicalIndex:
    """Index `chunks`. Null texts have no tokens; chunks without tokens count in n_docs and avgdl (0 without chunks).

    `how` is lexical_normalise's: lowercase, compatibility (NFKC first). Queries must be normalised alike.
    """
    tokens = chunks.select(F.col(id_col).alias("chunk_id"), lexical_tokens(F.col(text_col), **how).alias("tokens"))
    postings = tokens.select("chunk_id", F.explode("tokens").alias("term")).groupBy("chunk_id", "term").agg(F.count("*").alias("tf"))
    lengths = tokens.select("chunk_id", F.size("tokens").cast("long").alias("doc_len"))
    return LexicalIndex(postings, lengths, postings.groupBy("term").agg(F.count("*").alias("df")), _corpus(lengths))


def index_for(chunks: DataFrame, queries: DataFrame, id_col: str = "chunk_id", text_col: str = "text", **how: bool) -> LexicalIndex:
    """The part of build_index's tables that `queries` (question_id, text) ask for; stats and lengths are the whole corpus's.

    The corpus is scanned and its texts are tokenised once. Terms that no query has are dropped before anything is shuffled, and a
    chunk's length travels beside its terms. The result is written to the shared folder.
    """
    wanted = query_terms(queries, **how).select("term").distinct()
    few = wanted.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    rows = chunks.select(F.col(id_col).alias("chunk_id"), F.coalesce(lexical_tokens(F.col(text_col), **how), F.expr("cast(array() as array<string>)")).alias("tokens"))
    # Every chunk has one row without term, by which it is counted.
    rows = rows.select("chunk_id", F.size("tokens").cast("long").alias("doc_len"), F.explode(F.array_append("tokens", F.lit(None).cast("string"))).alias("term"))
    asked = (F.broadcast if few else (lambda df: df))(wanted.select(F.col("term").alias("asked")))
    kept = rows.join(asked, rows["term"] == asked["asked"], "left").where("term is null or asked is not null")
    table = materialize(kept.groupBy("chunk_id", "doc_len", "term").agg(F.count("*").alias("tf")), "lexical-asked")
    postings, lengths = table.where("term is not null"), table.where("term is null").select("chunk_id", "doc_len")
    return LexicalIndex(postings.select("chunk_id", "term", "tf", "doc_len"), lengths, postings.groupBy("term").agg(F.count("*").alias("df")), _corpus(lengths))


def idf(n_docs: Column, df: Column) -> Column:
    return F.log((n_docs - df + F.lit(0.5)) / (df + F.lit(0.5)) + F.lit(1.0))


def top_ranked(scored: DataFrame, n: int, by: list[str], score: str = "score", tie: str = "chunk_id") -> DataFrame:
    """`scored` cut to the n best of each group of `by`, with their rank from 1; equal scores by ascending id."""
    order = Window.partitionBy(*by).orderBy(F.desc(score), F.asc(tie))
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n)


def query_terms(queries: DataFrame, id_col: str = "question_id", text_col: str = "text", **how: bool) -> DataFrame:
    """(question_id, term, times): repeated query terms count repeatedly."""
    terms = queries.select(F.col(id_col).alias("question_id"), F.explode(lexical_tokens(F.trim(text_col), **how)).alias("term"))
    return terms.groupBy("question_id", "term").agg(F.count("*").alias("times"))


def _weighted(index: LexicalIndex, queries: DataFrame, **how: bool) -> DataFrame:
    """(question_id, term, weight) of the query terms that the index has: times and idf, the one-row statistics broadcast."""
    wanted = query_terms(queries, **how)
    few = wanted.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    small = F.broadcast if few else (lambda df: df)
    known = index.terms.join(small(wanted.select("term").distinct()), "term", "left_semi")
    return wanted.join(known, "term").crossJoin(F.broadcast(index.stats)).select("question_id", "term", (idf(F.col("n_docs"), F.col("df")) * F.col("times")).alias("weight"))


def _query_blocks(weighted: DataFrame):
    """(terms, question_ids, matrix of weights) of blocks of queries, a stated set matched block by block; only one is on the driver at a time."""
    size = weighted.agg(F.count("*").alias("rows"), F.count_distinct("question_id").alias("queries")).first()
    blocks = max(-(-size["rows"] // BLOCK_ROWS), -(-size["queries"] // BLOCK_QUERIES))
    for k in range(blocks):
        rows = weighted.where(F.pmod(F.xxhash64("question_id"), F.lit(blocks)) == k).collect()
        terms, ids = ({x: i for i, x in enumerate(sorted({r[c] for r in rows}))} for c in ("term", "question_id"))
        matrix = np.zeros((len(terms), len(ids)))
        for r in rows:
            matrix[terms[r["term"]], ids[r["question_id"]]] = r["weight"]
        if rows:
            yield list(terms), list(ids), matrix


def bm25_search(index: LexicalIndex, queries: DataFrame, top_n: int = TOP_N, k1: float = K1, b: float = B, **how: bool) -> DataFrame:
    """(question_id, chunk_id, score, rank): at most `top_n` chunks of each query, only chunks with a match.

    The postings of the query terms are gathered by chunk, and a batch of chunks is multiplied with a block of queries at once, so
    the pairs of postings and queries that share a term are never rows; a task keeps only its own best of each query. `how`
    normalises the queries as the index was normalised. Reading the query terms runs jobs.
    """
    spark = queries.sparkSession
    ship_package(spark)
    weighted = materialize(_weighted(index, queries, **how), "lexical-weights")
    ids, qids = index.postings.schema["chunk_id"].dataType.simpleString(), weighted.schema["question_id"].dataType.simpleString()
    schema = f"question_id {qids}, chunk_id {ids}, score double"
    avgdl = index.stats.first()["avgdl"] or 1.0
    out = spark.createDataFrame([], schema)
    for terms, names, matrix in _query_blocks(weighted):
        shared = spark.sparkContext.broadcast((terms, names, matrix))
        asked = F.broadcast(spark.createDataFrame([(t,) for t in terms], "term string"))  # at most BLOCK_ROWS terms, or one query's
        rows = index.postings.join(asked, "term")
        if "doc_len" not in rows.columns:
            rows = rows.join(index.lengths, "chunk_id")
        rows = rows.groupBy("chunk_id").agg(F.first("doc_len").alias("doc_len"), F.collect_list(F.struct("term", "tf")).alias("own"))

        def best(batches, shared=shared):
            terms, names, matrix = shared.value
            known, kept, some = pa.array(terms), Best(top_n), max(1, BLOCK_NUMBERS // len(terms))
            for whole in batches:
                for start in range(0, whole.num_rows, some):
                    batch = whole.slice(start, some)
                    own = batch.column("own").flatten()
                    row = np.repeat(np.arange(batch.num_rows), pc.list_value_length(batch.column("own")).to_numpy(zero_copy_only=False))
                    place = pc.index_in(own.field("term"), value_set=known).to_numpy(zero_copy_only=False)
                    tf, length = own.field("tf").to_numpy(zero_copy_only=False), batch.column("doc_len").to_numpy(zero_copy_only=False)
                    parts = np.zeros((batch.num_rows, len(terms)))
                    parts[row, place] = tf * (k1 + 1) / (tf + k1 * (1 - b + b * length[row] / avgdl))
                    score = np.round(parts @ matrix, RANKED_DECIMALS)
                    at, query = candidates(score, top_n)
                    hit = score[at, query] != 0
                    kept.add(query[hit], batch.column("chunk_id").take(pa.array(at[hit])), score[at[hit], query[hit]])
            yield from kept.rows(names)

        out = out.unionByName(rows.mapInArrow(best, schema))
    return top_ranked(out, top_n, ["question_id"])


def index_differences(stored: LexicalIndex, fresh: LexicalIndex) -> DataFrame:
    """(table, side, n) of rows that only one of two indexes has; empty when they agree."""
    out = None
    for name in ("postings", "lengths", "terms", "stats"):
        a, b = getattr(stored, name), getattr(fresh, name)
        for side, x, y in (("stored", a, b), ("fresh", b, a)):
            n = x.exceptAll(y.select(*x.columns)).agg(F.count("*").alias("n")).select(F.lit(name).alias("table"), F.lit(side).alias("side"), "n")
            out = n if out is None else out.unionByName(n)
    return out.where("n > 0")
