"""The registered queries over the provided tables, and their SQL.

`documents` is the corpus (a document is one chunk unless a query splits it), `benchmark` has the questions, and a document is relevant
to a question that it contains word for word. A question's dense vector is the one of `embeddings` with its number. Ids are
strings, so ties are broken in the order of their characters.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ravenna.config import Retrieval
from ravenna.functions.text import heading, lexical_tokens, sha256, token_count
from ravenna.operators import blocks as blocks_op
from ravenna.operators.chunking import chunk_blocks, corpus_version
from ravenna.operators.containment import containing
from ravenna.operators.context import assemble_context, context_entry
from ravenna.operators.dense import dense_search, normalised, vector_problems
from ravenna.operators.evaluation import article_means, config_means, coverage_summary, paired_deltas
from ravenna.operators.fusion import rerank, rrf_fuse, rrf_union
from ravenna.operators.leakage import leaks, retrieval_queries
from ravenna.operators.lexical import LexicalIndex, bm25_search, build_index, index_for
from ravenna.operators.metrics import group_coverage, metric_columns, qrel_index, question_metrics, relevance_map, stage_recall
from ravenna.operators.validation import READY, audit, gold_inventory, mapped_chunks, pending_drafts, review_counts, violations, warning_counts
from ravenna.plans.matrix import base_config_id, build_matrix, comparisons, matrix_frame, select_matrix
from ravenna.plans.retrieve import available, run_matrix
from ravenna.session import materialize

Query = Callable[[SparkSession, str], DataFrame]
STRUCTURE = [f"V{k}" for k in (*range(1, 13), 24)]
EMBEDDINGS = ["colibri", "qwen_embedding", "e5"]
#: Settings that differ from the defaults in everything that a ranking depends on.
OTHER_SETTINGS = Retrieval(top_n=20, bm25={"k1": 2.0, "b": 0.5}, rrf={"c": 10.0, "weight_bm25": 2.0, "weight_dense": 0.5})


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("chunk_id"), "text", F.col("source").alias("doc_id"), F.lit(None).cast("int").alias("page"))


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Questions with an origin article; every fifth names one that isn't there."""
    b = table(spark, sf_dir, "benchmark")
    n = F.col("item_id")
    return b.select(n.cast("string").alias("question_id"), "text", F.concat(F.lit("src"), F.pmod(n, F.lit(25)).cast("string")).alias("origin_doc_id"), F.substring("text", 1, 20).alias("expected_answer"))


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return normalised(table(spark, sf_dir, "embeddings").select(F.col("vec_id").cast("string").alias("chunk_id"), F.col("embedding").alias("vector")))


def question_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = questions(spark, sf_dir).select("question_id")
    return vectors(spark, sf_dir).withColumnRenamed("chunk_id", "question_id").join(ids, "question_id", "left_semi")


def qrels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(question_id, chunk_id, relevance): which questions stand in which documents. Written once, as its callers read it often."""
    found = containing(chunks(spark, sf_dir), questions(spark, sf_dir).withColumnRenamed("text", "needle"))
    return materialize(found.distinct().withColumn("relevance", F.lit(1)), "query-qrels")


def index(spark: SparkSession, sf_dir: str) -> LexicalIndex:
    return build_index(chunks(spark, sf_dir))


def _bm25(spark: SparkSession, sf_dir: str, **how: float) -> DataFrame:
    asked = questions(spark, sf_dir)
    return bm25_search(index_for(chunks(spark, sf_dir), asked), asked, **how)


def _dense(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dense_search(vectors(spark, sf_dir), question_vectors(spark, sf_dir))


def _scored(df: DataFrame, *columns: str) -> DataFrame:
    return df.select("question_id", "chunk_id", F.col("rank").cast("long").alias("rank"), F.round("score", 6).alias("score"), *columns)


def lex_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    tokens = lexical_tokens(F.col("text"))
    return chunks(spark, sf_dir).select("chunk_id", F.size(tokens).alias("n_tokens"), F.size(F.array_distinct(tokens)).alias("n_distinct"), token_count(F.col("text")).alias("n_reference"))


def lex_postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index(spark, sf_dir).postings


def lex_term_df(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index(spark, sf_dir).terms


def lex_corpus_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index(spark, sf_dir).stats.select("n_docs", F.round("avgdl", 6).alias("avgdl"), "total_tokens")


def bm25_topn(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scored(_bm25(spark, sf_dir))


def bm25_params_b0(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Without length normalisation, and with little saturation."""
    return _scored(_bm25(spark, sf_dir, k1=2.0, b=0.0))


def dense_topn(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All vectors against those whose number 50 divides."""
    asked = vectors(spark, sf_dir).where(F.pmod(F.col("chunk_id").cast("long"), F.lit(50)) == 0).withColumnRenamed("chunk_id", "question_id")
    return _scored(dense_search(vectors(spark, sf_dir), asked))


def dense_vector_problems(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of vectors with defects by the last digit of their number: not finite, too short, missing, zero, not of unit length, repeated."""
    sound = vectors(spark, sf_dir)
    n, v = F.pmod(F.col("chunk_id").cast("long"), F.lit(10)), F.col("vector")
    bad = F.when(n == 0, F.concat(F.array(F.lit(float("nan"))), F.slice(v, 2, 63))).when(n == 1, F.slice(v, 1, 63)).when(n == 2, F.lit(None)).when(n == 3, F.transform(v, lambda x: x * 0)).when(n == 4, F.transform(v, lambda x: x * 2)).otherwise(v)
    rows = sound.withColumn("vector", bad)
    return vector_problems(rows.unionByName(rows.where(n == 5)), 64)


def rrf_union_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = rrf_union(_bm25(spark, sf_dir), _dense(spark, sf_dir))
    return out.select("question_id", "chunk_id", "bm25_rank", "dense_rank", F.round("score", 6).alias("score"))


def rrf_topn(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scored(rrf_fuse(_bm25(spark, sf_dir), _dense(spark, sf_dir)), "bm25_rank", "dense_rank")


def rrf_weighted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scored(rrf_fuse(_bm25(spark, sf_dir), _dense(spark, sf_dir), weight_bm25=2.0, weight_dense=0.5), "bm25_rank", "dense_rank")


def bm25_nfkc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts whose vowels are full-width letters, which NFKC makes plain again, against plain questions."""
    asked, wide = questions(spark, sf_dir), chunks(spark, sf_dir).withColumn("text", F.translate("text", "aeiou", "ａｅｉｏｕ"))
    return _scored(bm25_search(index_for(wide, asked, compatibility=True), asked, compatibility=True))


def bm25_stored_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From the whole index, its tables written and read again."""
    whole = index(spark, sf_dir)
    stored = LexicalIndex(*(materialize(getattr(whole, t), f"query-{t}") for t in ("postings", "lengths", "terms", "stats")))
    return _scored(bm25_search(stored, questions(spark, sf_dir), top_n=10))


def _matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    v, q = vectors(spark, sf_dir), question_vectors(spark, sf_dir)
    return materialize(run_matrix(chunks(spark, sf_dir), questions(spark, sf_dir), build_matrix(["e5"]), {"e5": v}, {"e5": q}, OTHER_SETTINGS), "query-matrix")


def matrix_stages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages of the six configurations of one embedding, under settings of their own."""
    scores = [F.round(c, 6).alias(c) for c in ("score", "rrf_score", "rerank_score")]
    return _matrix(spark, sf_dir).select("config_id", "question_id", "stage", "rank", "chunk_id", "bm25_rank", "dense_rank", *scores)


def matrix_available(spark: SparkSession, sf_dir: str) -> DataFrame:
    return available(_matrix(spark, sf_dir), questions(spark, sf_dir), build_matrix(["e5"]))


def rerank_permutation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """BM25's candidates in the order of the stand-in's scores."""
    out = rerank(_bm25(spark, sf_dir), questions(spark, sf_dir), chunks(spark, sf_dir))
    return _scored(out, F.col("base_rank").cast("long").alias("base_rank"))


def _document_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.col("text")
    return table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("doc_id"), F.format_string("%d-b0000", "doc_id").alias("block_id"), F.lit(None).cast("int").alias("page"), F.lit(None).cast("string").alias("section"), F.lit("text").alias("modality"), "text", sha256(text).alias("source_block_hash"))


def chunk_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows of 350 tokens, each 300 after the one before, of every document."""
    return chunk_blocks(_document_blocks(spark, sf_dir)).select("chunk_id", "doc_id", "block_id", "token_count_ref", "char_count", sha256(F.col("text")).alias("text_hash"), "source_block_hash")


def chunk_token_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = chunk_blocks(_document_blocks(spark, sf_dir), target=100, overlap=20).groupBy("doc_id")
    return out.agg(F.count("*").alias("n_chunks"), F.sum("token_count_ref").alias("n_tokens"), F.max("token_count_ref").alias("most"))


def heading_detect(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = blocks_op.lines_of(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return lines.select("doc_id", "n", heading(F.col("line")).alias("heading")).where("heading is not null")


def blocks_paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("doc_id"), "text")
    return blocks_op.parse_blocks(docs).select("block_id", "doc_id", "section", "modality", F.length("text").alias("n_chars"), "source_block_hash")


def blocks_marked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as pages with a heading, two paragraphs and a table; of every third the table has no caption, of every third no blank line parts the pages."""
    n, text = F.col("doc_id"), F.concat(F.lit("alpha "), F.regexp_replace(F.lower(F.substring("text", 1, 90)), "[^a-z]+", " "), F.lit(" omega"))
    page, kind = F.pmod(n, F.lit(5)) + 1, F.pmod(n, F.lit(3))
    caption = F.when(kind == 2, "").otherwise(F.concat(F.lit("**Tabela (página 1):** cap "), n, F.lit("\n")))
    gap = F.when(kind == 1, "\n").otherwise("\n\n")
    parts = [F.lit("# d"), n, F.lit("\n<!-- note -->\n\n<!-- PAGE "), page, F.lit(" -->\n\n1. Intro\n\n"), text, F.lit("\n<!-- TABLE t1 page="), page + 3, F.lit(" -->\n"), caption, F.lit("| a | b |\n| "), n, F.lit(" | x |\n<!-- /TABLE -->\nbefore "), n, gap, F.lit("<!-- PAGE "), page + 1, F.lit(" -->"), gap, F.lit("after "), n, F.lit("\n")]
    docs = table(spark, sf_dir, "documents").select(F.concat(F.lit("d"), n).alias("doc_id"), F.concat(*parts).alias("text"))
    return blocks_op.parse_blocks(docs).select("block_id", "doc_id", "page", "section", "modality", "caption", sha256(F.col("text")).alias("text_hash"))


def qrels_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return qrel_index(qrels(spark, sf_dir)).select("question_id", "n_relevant", F.array_join("chunk_ids", ",").alias("chunk_ids"))


def _metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return question_metrics(_bm25(spark, sf_dir), qrels(spark, sf_dir), questions(spark, sf_dir))


def metrics_bundle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _metrics(spark, sf_dir).select("question_id", "blocked", *(F.round(F.col(f"`{m}`"), 6).alias(m) for m in metric_columns()))


def _metric(name: str) -> Query:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        wanted = [m for m in metric_columns() if m.startswith(name)]
        return _metrics(spark, sf_dir).where("not blocked").select("question_id", *(F.round(F.col(f"`{m}`"), 6).alias(m) for m in wanted))

    query.__doc__ = f"{name} of BM25 for each question that isn't blocked."
    return query


def blocked_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _metrics(spark, sf_dir).where("blocked").select("question_id")


def _configs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Final lists of three configurations, each base search written once."""
    lexical, dense = materialize(_bm25(spark, sf_dir), "query-bm25"), materialize(_dense(spark, sf_dir), "query-dense")
    fused = rrf_fuse(lexical, dense)
    pick = lambda df, name: df.select(F.lit(name).alias("config_id"), "question_id", "rank", "chunk_id")
    return pick(lexical, "bm25").unionByName(pick(dense, "dense_e5")).unionByName(pick(fused, "hybrid_e5"))


def _config_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return question_metrics(_configs(spark, sf_dir), qrels(spark, sf_dir), questions(spark, sf_dir), keys=("config_id",))


def _rounded_means(df: DataFrame, *keys: str) -> DataFrame:
    return df.select(*keys, *(F.round(F.col(f"`{m}`"), 6).alias(m) for m in metric_columns()))


def config_mean_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded_means(config_means(_config_metrics(spark, sf_dir)), "config_id", "n_questions_evaluated", "n_blocked")


def article_mean_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded_means(article_means(_config_metrics(spark, sf_dir), questions(spark, sf_dir)), "config_id", "origin_doc_id", "n")


def paired_delta_ndcg(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = comparisons(spark, ["e5"])
    return paired_deltas(_config_metrics(spark, sf_dir), pairs, "ndcg@10").select("label", "a", "b", "n", F.round("mean_delta", 6).alias("mean_delta"))


def stage_recalls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The six stages of the hybrid configuration with reranking."""
    stages = _matrix(spark, sf_dir).where("config_id = 'hybrid_e5_rerank'")
    return stage_recall(stages, qrels(spark, sf_dir)).select("stage", "question_id", F.round("recall", 6).alias("recall"))


def _groups(spark: SparkSession, sf_dir: str, judged: DataFrame) -> DataFrame:
    """Two groups for a question: its relevant documents, and the document of its number; the latter isn't required of every third."""
    n = F.col("question_id").cast("long")
    own = questions(spark, sf_dir).select(F.concat("question_id", F.lit("-own")).alias("group_id"), "question_id", (F.pmod(n, F.lit(3)) != 0).alias("required"), F.array("question_id").alias("chunk_ids"))
    gold = qrel_index(judged).select(F.concat("question_id", F.lit("-gold")).alias("group_id"), "question_id", F.lit(True).alias("required"), "chunk_ids")
    return own.unionByName(gold)


def group_coverages(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = group_coverage(_bm25(spark, sf_dir), _groups(spark, sf_dir, qrels(spark, sf_dir)), questions(spark, sf_dir))
    return out.select("question_id", "covered", "total", F.round("fraction", 6).alias("fraction"), F.array_join("covered_ids", ",").alias("covered_ids"), "all_covered")


def group_coverage_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged, ranked = qrels(spark, sf_dir), materialize(_bm25(spark, sf_dir), "query-bm25").withColumn("config_id", F.lit("bm25"))
    cover = group_coverage(ranked, _groups(spark, sf_dir, judged), questions(spark, sf_dir), keys=("config_id",))
    metrics = question_metrics(ranked, judged, questions(spark, sf_dir), keys=("config_id",))
    return coverage_summary(cover, metrics).select("config_id", F.round("mean_fraction", 6).alias("mean_fraction"), "questions_with_groups", "questions_all_covered")


def leakage_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The questions' texts hold their own beginnings, which stand for the expected answers here."""
    q = questions(spark, sf_dir)
    return leaks(retrieval_queries(q), q)


def _annotations(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """Annotation tables derived from the corpus, with defects of many kinds."""
    n = F.col("question_id").cast("long")
    known, judged = chunks(spark, sf_dir), qrels(spark, sf_dir)
    evidence = F.array(
        F.struct(
            F.concat(F.lit("e"), "question_id").alias("evidence_id"),
            F.col("origin_doc_id").alias("doc_id"),
            F.when(n % 4 != 0, (n % 9).cast("int") + 1).alias("page"),
            F.lit(None).cast("string").alias("section"),
            F.when(n % 6 == 0, F.lit(" ")).otherwise("expected_answer").alias("quote"),
            F.when(n % 7 == 0, F.expr("cast(array() as array<string>)")).when(n % 7 == 1, F.array("question_id", "question_id")).when(n % 7 == 2, F.array(F.lit("missing"))).otherwise(F.array("question_id")).alias("chunk_ids"),
            F.when(n % 5 == 0, F.concat("question_id", F.when(n % 10 == 0, F.lit("-own")).otherwise(F.lit("-none")))).alias("required_group"),
        )
    )
    asked = questions(spark, sf_dir).select("question_id", "text", "expected_answer", "origin_doc_id", evidence.alias("evidence"), F.when(n % 2 == 0, "multi_evidence").otherwise("factual").alias("question_type"), F.lit("text").alias("modality"), F.when(n % 3 == 0, "approved").when(n % 3 == 1, "draft").otherwise("rejected").alias("review_status"), F.when(n % 8 == 1, F.lit(f"Análise automática: {READY}")).when(n % 8 == 2, F.lit("Análise automática: UNSURE x")).alias("notes"))
    articles = known.select("doc_id").distinct().select("doc_id", F.lit(7).alias("pages"))
    return {"articles": articles, "questions": asked, "qrels": judged, "groups": _groups(spark, sf_dir, judged).withColumn("description", F.lit("")), "chunks": known}


def _structure(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """Annotation tables with repeated, orphaned and empty rows, by the remainders of the questions' and the documents' numbers."""
    n, c = F.col("question_id").cast("long"), F.col("chunk_id").cast("long")
    own = chunks(spark, sf_dir).withColumn("page", F.pmod(c, F.lit(9)).cast("int") + 1)
    articles = own.select("doc_id").distinct().select("doc_id", F.lit(7).alias("pages"))
    asked = questions(spark, sf_dir)
    cites = asked.select("question_id").where(n % 3 == 0).join(own.select(F.col("chunk_id").alias("question_id"), "doc_id", "page"), "question_id")
    evidence = cites.select("question_id", F.array(F.struct(F.concat(F.lit("e"), "question_id").alias("evidence_id"), "doc_id", (F.col("page") + F.pmod(n, F.lit(2)).cast("int")).alias("page"), F.lit(None).cast("string").alias("section"), F.lit("x").alias("quote"), F.array("question_id").alias("chunk_ids"), F.lit(None).cast("string").alias("required_group"))).alias("evidence"))
    kinds = [F.when(n % 4 == 0, "multi_evidence").otherwise("factual").alias("question_type"), F.lit("text").alias("modality"), F.when(n % 2 == 0, "approved").otherwise("draft").alias("review_status"), F.when(n % 5 == 0, F.lit("REQUIRED_GROUP_JUSTIFICATION: one source")).alias("notes")]
    asked = asked.join(evidence, "question_id", "left").select("question_id", "text", "expected_answer", "origin_doc_id", F.coalesce("evidence", F.array().cast(evidence.schema["evidence"].dataType)).alias("evidence"), *kinds)
    row = asked.select("question_id")
    is_ = lambda k, r: F.pmod(n, F.lit(k)) == r
    text, named = F.col("question_id"), lambda a, b="": F.concat(F.lit(a), F.col("question_id"), F.lit(b))
    judged = [row.select(text, text.alias("chunk_id")), row.where(is_(7, 0)).select(text, text.alias("chunk_id")), row.where(is_(6, 0)).select(named("none").alias("question_id"), text.alias("chunk_id")), row.where(is_(9, 0)).select(text, named("lost").alias("chunk_id"))]
    none = F.expr("cast(array() as array<string>)")
    group = lambda when, group_id, q, required, ids: row.where(when).select(group_id.alias("group_id"), q.alias("question_id"), F.lit(required).alias("required"), F.lit("").alias("description"), ids.alias("chunk_ids"))
    one = F.array("question_id")
    groups = [
        group(F.lit(True), named("", "-g"), text, True, one), group(is_(8, 0), named("", "-g"), text, True, one), group(is_(10, 0), named("x", "-g"), named("gone"), False, one), group(is_(4, 1), named("", "-e"), text, True, none),
        group(is_(12, 5), named("", "-r"), text, False, F.array("question_id", "question_id")), group(is_(13, 2), named("", "-m"), text, False, F.array(named("no"))),
    ]
    known = own.withColumn("doc_id", F.when(F.pmod(c, F.lit(50)) == 43, "nowhere").otherwise(F.col("doc_id")))
    return {
        "articles": articles.unionByName(articles.where(F.length("doc_id") % 2 == 0)),
        "questions": asked.unionByName(asked.where(is_(11, 0))),
        "qrels": reduce(DataFrame.unionByName, judged).withColumn("relevance", F.lit(1)),
        "groups": reduce(DataFrame.unionByName, groups),
        "chunks": known.unionByName(known.where(F.pmod(c, F.lit(40)) == 21)),
    }


def validate_structure(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Violations of the rules on identity and references, row by row."""
    t = _structure(spark, sf_dir)
    found = violations(t["articles"], t["questions"], t["qrels"], t["groups"], t["chunks"])
    return found.where(F.col("rule").isin(*STRUCTURE)).select("rule", "severity", "category", "question_id", "subject")


def audit_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = _structure(spark, sf_dir)
    return audit(t["questions"], t["qrels"], t["groups"], t["chunks"]).select("rule", "question_id", "subject")


def gold_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = _structure(spark, sf_dir)
    return gold_inventory(t["questions"], t["qrels"], t["groups"])


def gold_pending(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pending_drafts(_annotations(spark, sf_dir)["questions"])


def qrel_relevance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last of several judgements of a pair counts: every third pair is judged again, as irrelevant."""
    first = qrels(spark, sf_dir).withColumn("position", F.lit(1))
    again = first.where(F.pmod(F.col("chunk_id").cast("long"), F.lit(3)) == 0).withColumns({"position": F.lit(2), "relevance": F.lit(0)})
    last = relevance_map(first.unionByName(again), "position")
    return last.select("question_id", F.explode("relevance").alias("chunk_id", "relevance"))


def validate_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = _annotations(spark, sf_dir)
    found = violations(a["articles"], a["questions"], a["qrels"], a["groups"], a["chunks"])
    return found.groupBy("rule", "severity", "category").agg(F.count("*").alias("n"))


def validate_warning_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = _annotations(spark, sf_dir)
    return warning_counts(violations(a["articles"], a["questions"], a["qrels"], a["groups"], a["chunks"]))


def review_status_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return review_counts(_annotations(spark, sf_dir)["questions"])


def mapped_chunk_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = _annotations(spark, sf_dir)
    return mapped_chunks(a["questions"], a["qrels"], a["groups"])


def config_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matrix_frame(spark, EMBEDDINGS).withColumn("base_id", base_config_id(F.col("config_id")))


def config_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    return select_matrix(matrix_frame(spark, EMBEDDINGS), ["dense_", "hybrid_e5"], include_reranker=False).select("position", "config_id")


def config_comparisons(spark: SparkSession, sf_dir: str) -> DataFrame:
    return comparisons(spark, EMBEDDINGS)


def context_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    entry = context_entry(F.col("chunk_id"), F.col("doc_id"), F.col("page"), F.col("text"))
    paged = chunks(spark, sf_dir).withColumn("page", F.when(F.pmod(F.col("chunk_id").cast("int"), F.lit(2)) == 0, F.pmod(F.col("chunk_id").cast("int"), F.lit(11)) + 1))
    return paged.select("chunk_id", sha256(entry).alias("entry_hash"), F.length(entry).alias("n_chars"))


def context_assembly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of the first five of BM25 as many as 900 tokens hold, later ones filling the room that a larger one leaves."""
    prompts = questions(spark, sf_dir).select("question_id", F.col("text").alias("prompt"))
    out = assemble_context(_bm25(spark, sf_dir), chunks(spark, sf_dir), prompts, budget=900)
    return out.select("question_id", F.array_join("included", ",").alias("included"), F.array_join("excluded", ",").alias("excluded"), "context_tokens", "prompt_tokens", "total_tokens")


def doc_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunks(spark, sf_dir).select("chunk_id", sha256(F.col("text")).alias("text_hash"))


def corpus_identity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus_version(chunks(spark, sf_dir))


def queries() -> dict[str, Query]:
    names = """lex_token_counts lex_postings lex_term_df lex_corpus_stats bm25_topn bm25_params_b0 dense_topn dense_vector_problems bm25_nfkc bm25_stored_index rrf_union_all rrf_topn rrf_weighted
        matrix_stages matrix_available rerank_permutation chunk_table chunk_token_stats heading_detect blocks_paragraphs blocks_marked qrels_index qrel_relevance metrics_bundle blocked_questions config_mean_metrics article_mean_metrics
        paired_delta_ndcg stage_recalls group_coverages group_coverage_summary leakage_check validate_rules validate_structure validate_warning_counts audit_rules gold_counts gold_pending review_status_counts mapped_chunk_ids
        config_matrix config_selection config_comparisons context_entries context_assembly doc_hashes corpus_identity""".split()
    found: dict[str, Query] = {n: globals()[n] for n in names}
    return found | {f"metric_{m}": _metric(m) for m in ("recall", "hit", "mrr", "precision", "ndcg")}
