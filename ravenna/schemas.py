"""The logical tables' schemas, their field constraints, and checks of them as DataFrames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ravenna.functions.text import is_blank

#: Fixed values of the annotation vocabulary.
REVIEW_STATUS = ("draft", "approved", "rejected")
QUESTION_TYPES = ("factual", "multi_evidence")
MODALITIES = ("text", "table", "visual", "mixed")
TARGETS = ("question", "evidence", "qrel", "group", "chunk", "doc")
ID = r"^[A-Za-z0-9_-]+$"

EVIDENCE = "struct<evidence_id: string, doc_id: string, page: int, section: string, quote: string, chunk_ids: array<string>, required_group: string>"
DDL = {
    "articles": "doc_id string, title string, authors array<string>, year int, venue string, language string, pdf_filename string, pages int, notes string",
    "questions": f"question_id string, text string, expected_answer string, origin_doc_id string, evidence array<{EVIDENCE}>, question_type string, modality string, review_status string, notes string",
    "qrels": "question_id string, chunk_id string, relevance int",
    "evidence_groups": "group_id string, question_id string, required boolean, description string, chunk_ids array<string>",
    "reviews": "review_id string, target_type string, target_id string, status string, reviewer string, comments string, date string",
    "blocks": "block_id string, doc_id string, page int, section string, modality string, text string, caption string, source_block_hash string",
    "chunks": "chunk_id string, doc_id string, block_id string, page int, section string, modality string, text string, token_count_ref int, char_count int, source_block_hash string",
    "rankings": "config_id string, question_id string, stage string, rank int, chunk_id string, score double, bm25_rank int, dense_rank int, rrf_score double, rerank_score double",
    "generations": "question_id string, config_id string, model string, response string, prompt_sent string, context_included array<string>, context_text string, parameters map<string, string>, latency_s double, error string",
}
DEFAULTS = {
    "articles": {"authors": "array()", "language": "'pt-BR'"},
    "questions": {"evidence": "array()", "question_type": "'factual'", "modality": "'text'", "review_status": "'draft'"},
    "evidence_groups": {"required": "true", "description": "''", "chunk_ids": "array()"},
    "reviews": {"reviewer": "''", "comments": "''", "date": "''"},
    "chunks": {"modality": "'text'", "char_count": "0", "source_block_hash": "''"},
}
KEYS = {"articles": "doc_id", "questions": "question_id", "qrels": "question_id", "evidence_groups": "group_id", "reviews": "review_id", "chunks": "chunk_id", "blocks": "block_id"}


def schema(table: str) -> T.StructType:
    return T._parse_datatype_string(DDL[table])


def with_defaults(df: DataFrame, table: str) -> DataFrame:
    """`df` with the table's columns in order: absent and null ones take the table's defaults, other columns are refused."""
    fields = schema(table)
    extra = set(df.columns) - set(fields.names)
    if extra:
        raise ValueError(f"{table} has no columns {sorted(extra)}")
    given = DEFAULTS.get(table, {})
    columns = []
    for f in fields:
        value = F.col(f.name).cast(f.dataType) if f.name in df.columns else F.lit(None).cast(f.dataType)
        if f.name in given:
            value = F.coalesce(value, F.expr(given[f.name]).cast(f.dataType))
        columns.append(value.alias(f.name))
    return df.select(*columns)


def _between(name: str, low: int, high: int | None = None) -> Column:
    bad = F.col(name) < low
    return bad | (F.col(name) > high) if high is not None else bad


def _rules(table: str) -> list[tuple[str, Column]]:
    """(what is wrong, when) of each field constraint; a required field is wrong when null too."""
    bad_id = lambda c: (f"{c} is no id", F.col(c).isNull() | ~F.col(c).rlike(ID))
    empty = lambda c: (f"{c} is empty", F.col(c).isNull() | (F.col(c) == ""))
    of = lambda c, values: (f"{c} is unknown", F.col(c).isNull() | ~F.col(c).isin(*values))
    evidence_id = F.transform("evidence", lambda e: e["evidence_id"])
    return {
        "articles": [bad_id("doc_id"), empty("title"), ("year out of range", _between("year", 1800, 2200)), ("pdf_filename is missing", F.col("pdf_filename").isNull()), ("pages is negative", _between("pages", 0))],
        "questions": [
            bad_id("question_id"), empty("text"), empty("expected_answer"), bad_id("origin_doc_id"), of("question_type", QUESTION_TYPES), of("modality", MODALITIES), of("review_status", REVIEW_STATUS),
            ("evidence_id repeats", F.size(F.array_distinct(evidence_id)) < F.size("evidence")),
            ("evidence has a bad id", F.exists("evidence", lambda e: e["evidence_id"].isNull() | ~e["evidence_id"].rlike(ID) | e["doc_id"].isNull() | ~e["doc_id"].rlike(ID))),
            ("evidence page is below 1", F.exists("evidence", lambda e: F.coalesce(e["page"] < 1, F.lit(False)))),
        ],
        "qrels": [bad_id("question_id"), ("chunk_id is missing", F.col("chunk_id").isNull()), ("relevance is not 0 or 1", F.col("relevance").isNull() | _between("relevance", 0, 1))],
        "evidence_groups": [bad_id("group_id"), bad_id("question_id")],
        "reviews": [bad_id("review_id"), of("target_type", TARGETS), ("target_id is missing", F.col("target_id").isNull()), of("status", REVIEW_STATUS)],
        "chunks": [
            ("an id is missing", F.col("chunk_id").isNull() | F.col("doc_id").isNull() | F.col("block_id").isNull()), ("page is below 1", _between("page", 1)), of("modality", MODALITIES), ("text is blank", is_blank(F.col("text"))),
            ("token_count_ref is missing or negative", F.col("token_count_ref").isNull() | _between("token_count_ref", 0)), ("char_count is negative", _between("char_count", 0)),
        ],
    }[table]


def field_problems(df: DataFrame, table: str) -> DataFrame:
    """(key, problem): each broken field constraint of each row."""
    wrong = F.array(*(F.when(F.coalesce(when, F.lit(False)), F.lit(what)) for what, when in _rules(table)))
    return df.select(F.col(KEYS[table]).alias("key"), F.explode(F.filter(wrong, lambda x: x.isNotNull())).alias("problem"))


def require_valid(df: DataFrame, table: str) -> DataFrame:
    """`df`, failing with the first broken constraint of a row when it is run."""
    first = F.coalesce(*(F.when(F.coalesce(when, F.lit(False)), F.lit(what)) for what, when in _rules(table)))
    key = KEYS[table]
    said = F.concat(F.lit(f"{table} "), F.coalesce(F.col(key).cast("string"), F.lit("?")), F.lit(": "), first)
    return df.withColumn(key, F.when(first.isNotNull(), F.raise_error(said).cast(df.schema[key].dataType)).otherwise(F.col(key)))
