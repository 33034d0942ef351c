import math

import pytest
from pyspark.sql import functions as F

from ravenna.operators import evaluation as E
from ravenna.operators import metrics as M
from ravenna.plans.report import render_report


def ranking(spark, ids, q="q"):
    return spark.createDataFrame([(q, i, c) for i, c in enumerate(ids, 1)], "question_id string, rank int, chunk_id string")


def gold(spark, ids, q="q"):
    return spark.createDataFrame([(q, c, 1) for c in ids] + [(q, "not", 0)], "question_id string, chunk_id string, relevance int")


def measured(spark, ids, relevant, k=(1, 2, 5, 10)):
    q = spark.createDataFrame([("q",)], "question_id string")
    return M.question_metrics(ranking(spark, ids), gold(spark, relevant), q, k).first().asDict()


@pytest.mark.parametrize(
    "ids,relevant,expected",
    [
        ("abcd", "bd", {"recall@2": 0.5, "recall@5": 1.0, "precision@5": 0.5}),
        ("abc", "b", {"hit@1": 0.0, "hit@2": 1.0, "recall@1": 0.0}),
        ("xay", "a", {"mrr@10": 0.5}),
        ("xyz", "a", {"mrr@10": 0.0, "recall@10": 0.0, "ndcg@10": 0.0}),
        ("ab", "a", {"precision@5": 0.5, "precision@1": 1.0}),
        ("xa", "a", {"ndcg@2": 1 / math.log2(3)}),
        ("a", "az", {"ndcg@2": 1 / (1 + 1 / math.log2(3)), "ndcg@1": 1.0}),
        ("", "a", {"precision@5": 0.0, "recall@5": 0.0, "mrr@10": 0.0}),
        ("bcdefghijka", "a", {"mrr@10": 0.0, "recall@10": 0.0}),
    ],
)
def test_metrics(spark, ids, relevant, expected):
    got = measured(spark, ids, relevant)
    assert not got["blocked"]
    for name, value in expected.items():
        assert abs(got[name] - value) < 1e-12, name


def test_question_without_gold_is_blocked_not_zero(spark):
    got = measured(spark, "ab", "")
    assert got["blocked"] and got["n_relevant"] == 0 and got["ndcg@10"] is None and got["recall@1"] is None


def test_recall_grows_with_k(spark):
    got = measured(spark, "xaybzc", "abc", (1, 2, 3, 4, 5, 6))
    values = [got[f"recall@{k}"] for k in range(1, 7)]
    assert values == sorted(values) and values[-1] == 1.0


def test_stage_recall_counts_once(spark):
    stages = ranking(spark, "ab").withColumn("stage", F.lit("bm25")).unionByName(ranking(spark, "xa").withColumn("stage", F.lit("dense")))
    assert {r.stage: r.recall for r in M.stage_recall(stages, gold(spark, "ac")).collect()} == {"bm25": 0.5, "dense": 0.5}


GROUPS = [("g1", "q", True, ["a", "b"]), ("g2", "q", True, ["c"]), ("g3", "q", False, ["d"])]


@pytest.mark.parametrize("ids,covered,fraction,all_covered", [("bcz", ["g1", "g2"], 1.0, True), ("az", ["g1"], 0.5, False), ("", [], 0.0, False)])
def test_groups_are_alternatives(spark, ids, covered, fraction, all_covered):
    groups = spark.createDataFrame(GROUPS, "group_id string, question_id string, required boolean, chunk_ids array<string>")
    q = spark.createDataFrame([("q",), ("none",)], "question_id string")
    got = {r.question_id: r for r in M.group_coverage(ranking(spark, ids), groups, q).collect()}
    assert (got["q"].covered_ids, got["q"].fraction, got["q"].all_covered, got["q"].total) == (covered, fraction, all_covered, 2)
    assert (got["none"].covered, got["none"].total, got["none"].fraction, got["none"].all_covered) == (0, 0, 0.0, True)


@pytest.fixture(scope="module")
def run(spark):
    lists = spark.createDataFrame(
        [("A", "q1", 1, "a"), ("A", "q2", 1, "x"), ("A", "q2", 2, "b"), ("B", "q1", 1, "x"), ("B", "q1", 2, "a"), ("B", "q2", 1, "b"), ("B", "q3", 1, "z")],
        "config_id string, question_id string, rank int, chunk_id string",
    )
    qrels = spark.createDataFrame([("q1", "a", 1), ("q2", "b", 1), ("q4", "c", 1)], "question_id string, chunk_id string, relevance int")
    questions = spark.createDataFrame([("q1", "d1"), ("q2", None), ("q3", "d1"), ("q4", "d2")], "question_id string, origin_doc_id string")
    return M.question_metrics(lists, qrels, questions, keys=("config_id",)).persist(), questions


def test_means_leave_blocked_questions_out(spark, run):
    metrics, questions = run
    means = {r.config_id: r for r in E.config_means(metrics).collect()}
    assert (means["A"].n_questions_evaluated, means["A"].n_blocked) == (3, 1)
    assert abs(means["A"]["mrr@10"] - (1 + 0.5 + 0) / 3) < 1e-12
    articles = {(r.config_id, r.origin_doc_id): r for r in E.article_means(metrics, questions).collect()}
    assert articles["B", "?"]["mrr@10"] == 1.0 and articles["B", "d1"]["mrr@10"] == 0.5 and articles["B", "d2"]["mrr@10"] == 0.0


def test_paired_deltas(spark, run):
    metrics, _ = run
    pairs = spark.createDataFrame([("ab", "A", "B"), ("gone", "A", "C")], "label string, a string, b string")
    got = {r.label: r for r in E.paired_deltas(metrics, pairs, "mrr@10").collect()}
    assert got["ab"].n == 3 and abs(got["ab"].mean_delta) < 1e-12
    assert [(d.question_id, d.delta) for d in got["ab"].deltas] == [("q1", 0.5), ("q2", -0.5), ("q4", 0.0)]
    assert got["gone"].n == 0 and got["gone"].mean_delta is None
    assert {r.n for r in E.paired_deltas(metrics, pairs, "ndcg@7").collect()} == {0}


def test_timings_coverage_and_report(spark, run):
    metrics, _ = run
    timings = spark.createDataFrame([("A", "q1", "bm25", 0.5), ("A", "q3", "bm25", 1.5), ("A", "q1", "dense", None)], "config_id string, question_id string, stage string, seconds double")
    mean = E.mean_timings(timings)
    assert [(r.stage, r.mean_seconds) for r in mean.collect()] == [("bm25", 1.0)]
    cover = spark.createDataFrame([("A", "q1", 1, 2, 0.5, False), ("A", "q3", 1, 1, 1.0, True), ("A", "q2", 0, 0, 0.0, True)], "config_id string, question_id string, covered int, total int, fraction double, all_covered boolean")
    summary = E.coverage_summary(cover, metrics)
    row = summary.first()
    assert (row.mean_fraction, row.questions_with_groups, row.questions_all_covered) == (0.5, 1, 0)
    encoded = E.encoding_times(spark.createDataFrame([("e", "q1", 1.0), ("e", "q2", 3.0)], "embedding string, question_id string, seconds double"))
    assert tuple(encoded.first()) == ("e", 2, 2.0, 4.0)
    pairs = spark.createDataFrame([("ab", "A", "B")], "label string, a string, b string")
    report = render_report("run-1", {"corpus_version": "v", "config_hash": "h"}, E.config_means(metrics), E.paired_deltas(metrics, pairs, "ndcg@10"), metrics, summary, mean, encoded)
    assert "| A | " in report and "| ab | A | B | 3 |" in report and "A:q3" in report and "| e | 2 | 2.000000 | 4.000000 |" in report and "—" in report
