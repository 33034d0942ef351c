"""Cross-table rules of an annotated benchmark as anti-joins and counts: one row for each violation.

Severity is 'error' or 'warning'. Rules of incomplete annotation are errors for approved questions, and counted warnings for
the others.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ravenna.functions.text import is_blank

#: Fixed value: the class of drafts that wait for a person only.
READY = "READY_FOR_HUMAN_REVIEW"
COLUMNS = ("rule", "severity", "category", "question_id", "subject")


def _found(df: DataFrame, rule: str, subject: Column, question: Column | None = None, severity: Column | str = "error", category: str | None = None) -> DataFrame:
    level = F.lit(severity) if isinstance(severity, str) else severity
    name = F.lit(category).cast("string")
    return df.select(F.lit(rule).alias("rule"), level.alias("severity"), F.when(level == "warning", name).alias("category"), (F.lit(None) if question is None else question).cast("string").alias("question_id"), subject.cast("string").alias("subject"))


def _repeated(df: DataFrame, *keys: str) -> DataFrame:
    return df.groupBy(*keys).count().where("count > 1")


def evidence_rows(questions: DataFrame) -> DataFrame:
    """One row for each evidence of each question."""
    return questions.select("question_id", "origin_doc_id", "review_status", F.explode("evidence").alias("e")).select("question_id", "origin_doc_id", "review_status", "e.*")


def violations(articles: DataFrame, questions: DataFrame, qrels: DataFrame, groups: DataFrame, chunks: DataFrame) -> DataFrame:
    """(rule, severity, category, question_id, subject) of rules V1 to V29 on tables of ravenna.schemas."""
    q, g, c = F.col("question_id"), F.col("group_id"), F.col("chunk_id")
    incomplete = F.when(F.col("review_status") == "approved", "error").otherwise("warning")
    status = questions.select("question_id", "review_status").dropDuplicates(["question_id"])
    docs = articles.select(F.col("doc_id"), F.col("pages")).dropDuplicates(["doc_id"])
    known = chunks.select("chunk_id", F.col("doc_id").alias("chunk_doc"), F.col("page").alias("chunk_page")).dropDuplicates(["chunk_id"])
    positive = qrels.where("relevance >= 1").select("question_id", "chunk_id").distinct()
    evidence = evidence_rows(questions)
    cited = evidence.select("question_id", "review_status", "evidence_id", F.col("doc_id").alias("evidence_doc"), F.col("page").alias("evidence_page"), F.explode(F.array_distinct("chunk_ids")).alias("chunk_id"))
    in_group = groups.select("group_id", "question_id", F.explode(F.array_distinct("chunk_ids")).alias("chunk_id"))
    without = lambda df, other, on: df.join(other.select(on).distinct(), on, "left_anti")
    repeats = F.size("chunk_ids") > F.size(F.array_distinct("chunk_ids"))

    placed = cited.join(known, "chunk_id", "left")
    place = F.when(F.col("chunk_doc").isNull(), "V22").when(F.col("chunk_doc") != F.col("evidence_doc"), "V23").when(F.col("evidence_page").isNotNull() & F.col("chunk_page").isNotNull() & (F.col("evidence_page") != F.col("chunk_page")), "V24")
    misplaced = placed.withColumn("rule", place).where("rule is not null")
    own_groups = groups.select("question_id", F.col("group_id").alias("required_group"), F.col("chunk_ids").alias("group_chunks")).dropDuplicates(["question_id", "required_group"])
    grouped = evidence.where("required_group is not null").join(own_groups, ["question_id", "required_group"], "left")
    required = groups.where("required").select("question_id").distinct()

    found = [
        _found(_repeated(articles, "doc_id"), "V1", F.col("doc_id")),
        _found(_repeated(questions, "question_id"), "V2", q, q),
        _found(_repeated(chunks, "chunk_id"), "V3", c),
        _found(without(chunks, docs, "doc_id"), "V4", c),
        _found(without(qrels, questions, "question_id"), "V5", c, q),
        _found(without(qrels, known, "chunk_id"), "V6", c, q),
        _found(_repeated(qrels, "question_id", "chunk_id"), "V7", c, q),
        _found(_repeated(groups, "group_id"), "V8", g),
        _found(without(groups, questions, "question_id"), "V9", g, q),
        _found(groups.where("required and size(chunk_ids) = 0").join(status, "question_id"), "V10", g, q, incomplete, "empty_required_group"),
        _found(groups.where(repeats), "V11", g, q),
        _found(without(in_group, known, "chunk_id"), "V12", F.concat_ws(" ", g, c), q),
        _found(in_group.join(known.select("chunk_id"), "chunk_id", "left_semi").join(positive, ["question_id", "chunk_id"], "left_anti"), "V13", F.concat_ws(" ", g, c), q),
        _found(questions.where("review_status = 'draft'"), "V14", q, q, "warning", "draft"),
        _found(questions.join(docs.select(F.col("doc_id").alias("origin_doc_id")), "origin_doc_id", "left_anti"), "V15", F.col("origin_doc_id"), q),
        _found(without(evidence, docs, "doc_id"), "V16", F.col("evidence_id"), q),
        _found(evidence.where(is_blank(F.col("quote"))), "V17", F.col("evidence_id"), q, incomplete, "missing_quote"),
        _found(evidence.where("page is null"), "V18", F.col("evidence_id"), q, incomplete, "missing_page"),
        _found(evidence.join(docs, "doc_id").where("page > pages"), "V19", F.col("evidence_id"), q),
        _found(evidence.where("chunk_ids is null or size(chunk_ids) = 0"), "V20", F.col("evidence_id"), q, incomplete, "missing_evidence_chunks"),
        _found(evidence.where(repeats), "V21", F.col("evidence_id"), q),
        misplaced.select("rule", F.lit("error").alias("severity"), F.lit(None).cast("string").alias("category"), "question_id", F.concat_ws(" ", "evidence_id", "chunk_id").alias("subject")),
        _found(cited.join(positive, ["question_id", "chunk_id"], "left_anti"), "V25", F.concat_ws(" ", "evidence_id", "chunk_id"), q, incomplete, "evidence_without_qrel"),
        _found(grouped.where("group_chunks is null"), "V26", F.col("evidence_id"), q),
        _found(grouped.where(F.col("group_chunks").isNotNull() & (F.size(F.array_except("chunk_ids", "group_chunks")) > 0)), "V27", F.col("evidence_id"), q),
        _found(without(questions, positive, "question_id"), "V28", q, q, incomplete, "missing_qrels"),
        _found(without(questions.where("question_type = 'multi_evidence'"), required, "question_id"), "V29", q, q, incomplete, "missing_required_groups"),
    ]
    return reduce(DataFrame.unionByName, found)


def audit(questions: DataFrame, qrels: DataFrame, groups: DataFrame, chunks: DataFrame) -> DataFrame:
    """Rules A1 to A3: evidence and relevance outside the origin article; each unjustified required group of a factual question."""
    q = F.col("question_id")
    origin = questions.select("question_id", "origin_doc_id").dropDuplicates(["question_id"])
    positive = qrels.where("relevance >= 1").join(origin, "question_id").join(chunks.select("chunk_id", F.col("doc_id").alias("chunk_doc")).dropDuplicates(["chunk_id"]), "chunk_id")
    justified = F.coalesce(F.col("notes"), F.lit("")).rlike(r"REQUIRED_GROUP_JUSTIFICATION:[ \t]*[^\s\p{Z}]")
    factual = groups.where("required").select("group_id", "question_id").join(questions.where("question_type = 'factual'").where(~justified).select("question_id").distinct(), "question_id", "left_semi")
    found = [
        _found(evidence_rows(questions).where("doc_id <> origin_doc_id"), "A1", F.col("evidence_id"), q),
        _found(positive.where("chunk_doc <> origin_doc_id"), "A2", F.col("chunk_id"), q),
        _found(factual, "A3", F.col("group_id"), q),
    ]
    return reduce(DataFrame.unionByName, found)


def warning_counts(found: DataFrame) -> DataFrame:
    return found.where("severity = 'warning'").groupBy("category").agg(F.count("*").alias("n"))


def is_valid(found: DataFrame) -> bool:
    return found.where("severity = 'error'").isEmpty()


def candidate_status(questions: DataFrame) -> DataFrame:
    """`questions` with `candidate`: the class that an automatic analysis left in the notes, or UNCLASSIFIED."""
    said = F.regexp_extract(F.coalesce("notes", F.lit("")), r"Análise automática:\s*([A-Z_]+)", 1)
    return questions.withColumn("candidate", F.when(said != "", said).otherwise("UNCLASSIFIED"))


def review_counts(questions: DataFrame) -> DataFrame:
    """One row: total, approved, draft_ready, draft_pending, rejected."""
    n = lambda when: F.coalesce(F.sum(F.when(when, 1).otherwise(0)), F.lit(0)).cast("long")
    draft, ready = F.col("review_status") == "draft", F.col("candidate") == READY
    return candidate_status(questions).agg(F.count("*").alias("total"), n(F.col("review_status") == "approved").alias("approved"), n(draft & ready).alias("draft_ready"), n(draft & ~ready).alias("draft_pending"), n(F.col("review_status") == "rejected").alias("rejected"))


def next_draft(questions: DataFrame) -> DataFrame:
    """The first draft that is ready in the order of `position`, else the first draft; no row without drafts."""
    drafts = candidate_status(questions).where("review_status = 'draft'")
    return drafts.orderBy((F.col("candidate") == READY).desc(), "position").limit(1)


def quotes_on_page(questions: DataFrame, pages: DataFrame) -> DataFrame:
    """(question_id, evidence_id, found): whether an evidence's quote stands literally on its page of `pages` (doc_id, page, page_text).

    A document without page marks is one text whose page is null; it is searched whatever page the evidence names.
    """
    whole = pages.where("page is null").select("doc_id", F.col("page_text").alias("whole"))
    rows = evidence_rows(questions).join(pages.where("page is not null"), ["doc_id", "page"], "left").join(whole, "doc_id", "left")
    held = F.contains(F.coalesce("page_text", "whole"), F.col("quote"))
    return rows.select("question_id", "evidence_id", F.coalesce(held, F.lit(False)).alias("found"))


def gold_inventory(questions: DataFrame, qrels: DataFrame, groups: DataFrame) -> DataFrame:
    """One row: review_counts' columns, and how much evidence, relevance and grouping is annotated."""
    n = lambda when: F.coalesce(F.sum(F.when(when, 1).otherwise(0)), F.lit(0)).cast("long")
    quoted = ~is_blank(F.col("quote"))
    evidence = evidence_rows(questions).agg(
        F.count("*").alias("evidence_refs"),
        n(quoted).alias("evidence_with_quote"),
        n(quoted & F.col("page").isNotNull()).alias("evidence_with_quote_and_page"),
        n(F.size("chunk_ids") > 0).alias("evidence_with_chunks"),
    )
    positive = F.col("relevance") == 1
    judged = qrels.agg(F.count("*").alias("qrels"), n(positive).alias("positive_qrels"), F.count_distinct(F.when(positive, F.col("question_id"))).alias("questions_with_positive_qrels"))
    grouped = groups.agg(n(F.col("required")).alias("required_groups"), n(F.col("required") & (F.size("chunk_ids") <= 0)).alias("empty_required_groups"))
    return review_counts(questions).crossJoin(evidence).crossJoin(judged).crossJoin(grouped)  # one row each


def pending_drafts(questions: DataFrame) -> DataFrame:
    """(question_id, classification) of the drafts that aren't ready for a person's review."""
    return candidate_status(questions).where("review_status = 'draft'").where(F.col("candidate") != READY).select("question_id", F.col("candidate").alias("classification"))


def mapped_chunks(questions: DataFrame, qrels: DataFrame, groups: DataFrame) -> DataFrame:
    """Distinct (question_id, chunk_id) that evidence, relevance or groups name."""
    parts = [evidence_rows(questions).select("question_id", F.explode("chunk_ids").alias("chunk_id")), qrels.select("question_id", "chunk_id"), groups.select("question_id", F.explode("chunk_ids").alias("chunk_id"))]
    return reduce(DataFrame.unionByName, parts).distinct()


def decision_problems(question_id: str, reviewer: str, confirmed: bool, questions: DataFrame) -> list[str]:
    """What forbids any decision on a question: it is unknown or no draft, or nobody stands for the decision."""
    row = questions.where(F.col("question_id") == question_id).select("review_status").first()
    if row is None:
        return ["unknown question"]
    wrong = ["not a draft"] if row["review_status"] != "draft" else []
    return wrong + ([] if (reviewer or "").strip() and confirmed else ["reviewer and explicit confirmation are needed"])


def approval_problems(question_id: str, reviewer: str, confirmed: bool, questions: DataFrame, found: DataFrame, quotes: DataFrame) -> list[str]:
    """What forbids approving a question: decision_problems, no evidence, a pending visual check, errors, a quote that its page lacks.

    `found` are the violations with the question taken as approved: errors anywhere forbid it.
    """
    wrong = decision_problems(question_id, reviewer, confirmed, questions)
    row = questions.where(F.col("question_id") == question_id).select(F.size("evidence").alias("n"), "notes").first()
    if row is None:
        return wrong
    if row["n"] <= 0:
        wrong.append("no evidence")
    if "MANUAL_VISUAL_REVIEW_REQUIRED" in (row["notes"] or ""):
        wrong.append("a visual check is pending")
    if not found.where(F.col("severity") == "error").isEmpty():
        wrong.append("validation errors")
    if not quotes.where((F.col("question_id") == question_id) & ~F.col("found")).isEmpty():
        wrong.append("a quote is not on its page")
    return wrong
