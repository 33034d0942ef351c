import pytest
from pyspark.sql import functions as F

from ravenna import schemas
from ravenna.operators import leakage
from ravenna.operators import validation as V

EVIDENCE = {"evidence_id": "e1", "doc_id": "d1", "page": 1, "section": None, "quote": "a quote", "chunk_ids": ["c1"], "required_group": None}


def bundle(**changes):
    """One article of three pages, one chunk on page 1, one draft question with one evidence and one positive qrel."""
    rows = {
        "articles": [{"doc_id": "d1", "title": "t", "pdf_filename": "f", "pages": 3}],
        "questions": [{"question_id": "q1", "text": "why", "expected_answer": "so", "origin_doc_id": "d1", "evidence": [dict(EVIDENCE)], "review_status": "draft"}],
        "qrels": [{"question_id": "q1", "chunk_id": "c1", "relevance": 1}],
        "evidence_groups": [],
        "chunks": [{"chunk_id": "c1", "doc_id": "d1", "block_id": "b", "page": 1, "text": "x", "token_count_ref": 1}],
    }
    for name, change in changes.items():
        change(rows[name])
    return rows


def frames(spark, rows):
    out = {}
    for name, items in rows.items():
        fields = schemas.schema(name)
        empty = {"chunk_ids": []}
        shape = lambda e: tuple(e[c] for c in EVIDENCE)
        values = [tuple([shape(e) for e in i.get("evidence", [])] if f.name == "evidence" else i.get(f.name, empty.get(f.name)) for f in fields) for i in items]
        out[name] = schemas.with_defaults(spark.createDataFrame(values, fields), name)
    return out


def rules(spark, rows):
    t = frames(spark, rows)
    found = V.violations(t["articles"], t["questions"], t["qrels"], t["evidence_groups"], t["chunks"])
    audited = V.audit(t["questions"], t["qrels"], t["evidence_groups"], t["chunks"])
    return {(r.rule, r.severity) for r in found.unionByName(audited).collect()}


def evidence(**new):
    return lambda questions: questions[0]["evidence"][0].update(new)


def first(**new):
    return lambda items: items[0].update(new)


def more(**new):
    return lambda items: items.append(new)


def again(items):
    items.append(dict(items[0]))


GROUP = {"group_id": "g1", "question_id": "q1", "required": True, "chunk_ids": ["c1"]}
DRAFT = {("V14", "warning")}


@pytest.mark.parametrize(
    "changes,expected",
    [
        ({}, set()),
        ({"articles": again}, {("V1", "error")}),
        ({"questions": again}, {("V2", "error")}),
        ({"chunks": again}, {("V3", "error")}),
        ({"chunks": more(chunk_id="c2", doc_id="no", block_id="b", text="x", token_count_ref=1)}, {("V4", "error")}),
        ({"qrels": more(question_id="no", chunk_id="c1", relevance=0)}, {("V5", "error")}),
        ({"qrels": more(question_id="q1", chunk_id="no", relevance=0)}, {("V6", "error")}),
        ({"qrels": again}, {("V7", "error")}),
        ({"evidence_groups": lambda x: x.extend([GROUP, GROUP])}, {("V8", "error"), ("A3", "error")}),
        ({"evidence_groups": more(**GROUP | {"question_id": "no", "required": False, "chunk_ids": []})}, {("V9", "error")}),
        ({"evidence_groups": more(**GROUP | {"chunk_ids": []})}, {("V10", "warning"), ("A3", "error")}),
        ({"evidence_groups": more(**GROUP | {"required": False, "chunk_ids": ["c1", "c1"]})}, {("V11", "error")}),
        ({"evidence_groups": more(**GROUP | {"required": False, "chunk_ids": ["no"]})}, {("V12", "error")}),
        ({"evidence_groups": more(**GROUP | {"required": False}), "qrels": first(relevance=0)}, {("V13", "error"), ("V25", "warning"), ("V28", "warning")}),
        ({"questions": first(origin_doc_id="no")}, {("V15", "error"), ("A1", "error"), ("A2", "error")}),
        ({"questions": evidence(doc_id="d2")}, {("V16", "error"), ("V23", "error"), ("A1", "error")}),
        ({"questions": evidence(quote=" ")}, {("V17", "warning")}),
        ({"questions": evidence(page=None)}, {("V18", "warning")}),
        ({"questions": evidence(page=4)}, {("V19", "error"), ("V24", "error")}),
        ({"questions": evidence(page=2)}, {("V24", "error")}),
        ({"questions": evidence(chunk_ids=[])}, {("V20", "warning")}),
        ({"questions": evidence(chunk_ids=["c1", "c1"])}, {("V21", "error")}),
        ({"questions": evidence(chunk_ids=["no"])}, {("V22", "error"), ("V25", "warning")}),
        ({"questions": evidence(required_group="no")}, {("V26", "error")}),
        ({"questions": evidence(required_group="g1"), "evidence_groups": more(**GROUP | {"required": False, "chunk_ids": []})}, {("V27", "error")}),
        ({"questions": first(question_type="multi_evidence")}, {("V29", "warning")}),
        ({"questions": first(question_type="multi_evidence"), "evidence_groups": more(**GROUP)}, set()),
        ({"questions": first(notes="REQUIRED_GROUP_JUSTIFICATION: needed"), "evidence_groups": more(**GROUP)}, set()),
        ({"questions": first(notes="REQUIRED_GROUP_JUSTIFICATION: \nnext line"), "evidence_groups": more(**GROUP)}, {("A3", "error")}),
    ],
)
def test_each_defect_breaks_its_rule(spark, changes, expected):
    rows = bundle(**changes)
    assert rules(spark, rows) == expected | DRAFT
    for q in rows["questions"]:
        q["review_status"] = "approved"
    assert rules(spark, rows) == {(r, "error") for r, _ in expected}


def test_counts_and_gate(spark):
    t = frames(spark, bundle(questions=evidence(page=None)))
    found = V.violations(t["articles"], t["questions"], t["qrels"], t["evidence_groups"], t["chunks"])
    assert {(r.category, r.n) for r in V.warning_counts(found).collect()} == {("draft", 1), ("missing_page", 1)} and V.is_valid(found)
    on = lambda *pages: V.quotes_on_page(frames(spark, bundle())["questions"], spark.createDataFrame(list(pages), "doc_id string, page int, page_text string"))
    quotes = on(("d1", 1, "here is a quote,\nliterally"))
    assert [r.found for r in quotes.collect()] == [True]
    assert [r.found for r in on(("d1", None, "here is a quote,\nliterally")).collect()] == [True]
    assert [r.found for r in on(("d1", 2, "here is a quote,\nliterally")).collect()] == [False]
    good = frames(spark, bundle())["questions"]
    assert V.approval_problems("q1", "me", True, good, found.limit(0), quotes) == []
    assert V.approval_problems("q1", " ", True, good, found.limit(0), quotes) == ["reviewer and explicit confirmation are needed"]
    assert V.approval_problems("no", "me", True, good, found, quotes) == ["unknown question"]
    assert V.approval_problems("q1", "me", True, good, found.withColumn("severity", F.lit("error")), quotes) == ["validation errors"]
    assert V.decision_problems("q1", "me", False, good) == ["reviewer and explicit confirmation are needed"]
    bad = frames(spark, bundle(questions=first(notes="MANUAL_VISUAL_REVIEW_REQUIRED", evidence=[], review_status="rejected")))["questions"]
    assert V.approval_problems("q1", "me", True, bad, found.limit(0), quotes) == ["not a draft", "no evidence", "a visual check is pending"]


def test_review_counts_and_next_draft(spark):
    rows = [("a", "draft", None, 0), ("b", "draft", "Análise automática: READY_FOR_HUMAN_REVIEW", 1), ("c", "approved", None, 2), ("d", "rejected", "Análise automática:  X_Y", 3)]
    df = spark.createDataFrame(rows, "question_id string, review_status string, notes string, position int")
    assert tuple(V.review_counts(df).first()) == (4, 1, 1, 1, 1)
    assert V.next_draft(df).first().question_id == "b"
    assert [tuple(r) for r in V.pending_drafts(df).collect()] == [("a", "UNCLASSIFIED")]
    assert V.next_draft(df.where("question_id <> 'b'")).first().question_id == "a" and V.next_draft(df.limit(0)).count() == 0
    assert tuple(V.review_counts(df.limit(0)).first()) == (0, 0, 0, 0, 0)


def test_mapped_chunks_are_distinct(spark):
    t = frames(spark, bundle(evidence_groups=more(**GROUP | {"chunk_ids": ["c1", "c9"]})))
    got = {(r.question_id, r.chunk_id) for r in V.mapped_chunks(t["questions"], t["qrels"], t["evidence_groups"]).collect()}
    assert got == {("q1", "c1"), ("q1", "c9")}


@pytest.mark.parametrize("text,leaked", [("What did SO happen?", {"expected_answer"}), ("about d1?", {"origin_doc_id"}), ("so, d1", {"expected_answer", "origin_doc_id"}), ("why", set())])
def test_leaks(spark, text, leaked):
    questions = spark.createDataFrame([("q1", " " + text + " ", " So ", "d1"), ("q2", "x", "", "")], "question_id string, text string, expected_answer string, origin_doc_id string")
    queries = leakage.retrieval_queries(questions)
    assert queries.columns == ["question_id", "text"] and queries.first().text == text
    assert {r.leaked for r in leakage.leaks(queries, questions).collect()} == leaked
    if leaked:
        with pytest.raises(Exception, match="leak in q1"):
            leakage.require_no_leaks(queries, questions).collect()
    else:
        assert leakage.require_no_leaks(queries, questions).count() == 2


@pytest.mark.parametrize(
    "table,row,problem",
    [
        ("articles", {"doc_id": "a b", "title": "t", "pdf_filename": "f"}, "doc_id is no id"),
        ("articles", {"doc_id": "a", "title": "", "pdf_filename": "f"}, "title is empty"),
        ("articles", {"doc_id": "a", "title": "t", "pdf_filename": "f", "year": 1700}, "year out of range"),
        ("qrels", {"question_id": "q", "chunk_id": "c", "relevance": 2}, "relevance is not 0 or 1"),
        ("chunks", {"chunk_id": "c", "doc_id": "d", "block_id": "b", "text": " \n", "token_count_ref": 1}, "text is blank"),
        ("chunks", {"chunk_id": "c", "doc_id": "d", "block_id": "b", "text": "x", "token_count_ref": -1}, "token_count_ref is missing or negative"),
        ("questions", {"question_id": "q", "text": "t", "expected_answer": "a", "origin_doc_id": "d", "evidence": [EVIDENCE, EVIDENCE]}, "evidence_id repeats"),
        ("questions", {"question_id": "q", "text": "t", "expected_answer": "a", "origin_doc_id": "d", "question_type": "odd"}, "question_type is unknown"),
        ("reviews", {"review_id": "r", "target_type": "page", "target_id": "x", "status": "draft"}, "target_type is unknown"),
        ("evidence_groups", {"group_id": "", "question_id": "q"}, "group_id is no id"),
    ],
)
def test_field_constraints(spark, table, row, problem):
    df = frames(spark, {table: [row]})[table]
    assert [r.problem for r in schemas.field_problems(df, table).collect()] == [problem]
    with pytest.raises(Exception, match=problem):
        schemas.require_valid(df, table).collect()


def test_valid_rows_and_unknown_columns(spark):
    for name, df in frames(spark, bundle()).items():
        assert schemas.field_problems(df, name).count() == 0 and schemas.require_valid(df, name).count() == df.count()
    with pytest.raises(ValueError, match="extra"):
        schemas.with_defaults(spark.createDataFrame([("c", 1)], "chunk_id string, extra int"), "chunks")
