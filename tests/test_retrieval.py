import math
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from ravenna.config import Retrieval
from ravenna.errors import ConfigError
from ravenna.operators import containment as K
from ravenna.operators import dense as D
from ravenna.operators import fusion as R
from ravenna.operators import lexical as L
from ravenna.plans import matrix as M
from ravenna.plans.retrieve import run_matrix, stage_list

TEXTS = {"c1": "the cat sat on the mat", "c2": "the dog sat", "c3": "a cat and a dog, a cat", "c4": "", "c5": "the cat sat on the mat", "c6": None}


def chunks(spark, texts=None):
    return spark.createDataFrame(list((texts or TEXTS).items()), "chunk_id string, text string")


def asked(spark, **queries):
    return spark.createDataFrame(list(queries.items()), "question_id string, text string")


def plain_bm25(texts, query, k1=1.2, b=0.75):
    docs = {i: re.findall(r"\w+", (t or "").lower()) for i, t in texts.items()}
    n, avg = len(docs), sum(map(len, docs.values())) / len(docs)
    out = {}
    for i, d in docs.items():
        score = 0.0
        for term in re.findall(r"\w+", query.lower()):
            df = sum(term in x for x in docs.values())
            tf = Counter(d)[term]
            if not tf:
                continue
            score += math.log((n - df + 0.5) / (df + 0.5) + 1) * tf * (k1 + 1) / (tf + k1 * (1 - b + b * len(d) / avg))
        if any(t in d for t in re.findall(r"\w+", query.lower())):
            out[i] = round(score, 9)
    return sorted(out.items(), key=lambda x: (-x[1], x[0]))


@pytest.mark.parametrize("k1,b", [(1.2, 0.75), (2.0, 0.0), (0.5, 1.0)])
@pytest.mark.parametrize("query", ["cat", "cat cat dog", "unseen cat", "the sat mat on", "Cat, SAT!", "nothing", ""])
def test_bm25(spark, query, k1, b):
    rows = L.bm25_search(L.build_index(chunks(spark)), asked(spark, q=query), k1=k1, b=b).orderBy("rank").collect()
    want = plain_bm25(TEXTS, query, k1, b)
    assert [(r.chunk_id, r.rank) for r in rows] == [(i, k) for k, (i, _) in enumerate(want, 1)]
    assert all(abs(r.score - s) < 1e-8 for r, (_, s) in zip(rows, want, strict=True))


def test_bm25_cut_and_ties(spark):
    rows = L.bm25_search(L.build_index(chunks(spark)), asked(spark, q="mat"), top_n=1).collect()
    assert [(r.chunk_id, r.rank) for r in rows] == [("c1", 1)]


def test_statistics_count_empty_texts(spark):
    index = L.build_index(chunks(spark))
    stats = index.stats.first()
    assert (stats.n_docs, stats.total_tokens) == (6, 22) and abs(stats.avgdl - 22 / 6) < 1e-12
    assert {r.term: r.df for r in index.terms.collect()}["cat"] == 3
    empty = L.build_index(chunks(spark).limit(0))
    assert empty.stats.first().avgdl == 0.0
    assert L.bm25_search(empty, asked(spark, q="cat")).count() == 0


def test_altered_index_is_noticed(spark):
    fresh = L.build_index(chunks(spark))
    assert L.index_differences(fresh, L.build_index(chunks(spark))).count() == 0
    altered = L.LexicalIndex(fresh.postings, fresh.lengths, fresh.terms, fresh.stats.withColumn("avgdl", F.col("avgdl") + 1))
    assert {(r.table, r.side, r.n) for r in L.index_differences(altered, fresh).collect()} == {("stats", "stored", 1), ("stats", "fresh", 1)}


def test_dense_is_exact_with_ties(spark):
    rng = random.Random(1)
    rows = [(f"v{i:03d}", [rng.choice([-1.0, 0.0, 1.0]) for _ in range(4)]) for i in range(200)] + [("null", None)]
    vectors = D.normalised(spark.createDataFrame(rows, "chunk_id string, vector array<float>")).repartition(5)
    asked = vectors.where("chunk_id in ('v001', 'v002')").withColumnRenamed("chunk_id", "question_id")
    unit = {r.chunk_id: r.vector for r in vectors.collect() if r.vector}
    for n in (7, 500):
        got = D.dense_search(vectors, asked, n).orderBy("question_id", "rank").collect()
        want = []
        for q in ("v001", "v002"):
            norm = math.sqrt(sum(x * x for x in unit[q])) + 1e-12
            scored = sorted(((-round(sum(a * b for a, b in zip(unit[q], v, strict=True)) / norm, 12), i) for i, v in unit.items()))[:n]
            want += [(q, i, k) for k, (_, i) in enumerate(scored, 1)]
        assert [(r.question_id, r.chunk_id, r.rank) for r in got] == want


def test_dense_query_blocks(spark, monkeypatch):
    monkeypatch.setattr(D, "BLOCK_NUMBERS", 4)
    vectors = spark.createDataFrame([(str(i), [float(i), 1.0]) for i in range(6)], "chunk_id string, vector array<float>")
    got = D.dense_search(vectors, vectors.withColumnRenamed("chunk_id", "question_id"), 2)
    assert got.count() == 12 and got.groupBy("question_id").count().count() == 6


def test_dense_ranks_unrounded_scores(spark):
    """Products that agree to seven decimals still rank by what they differ in."""
    rows = [("a", [0.6, 0.8]), ("b", [0.6 + 1e-9, 0.8]), ("c", [0.6 - 1e-9, 0.8])] + [(f"x{i}", [0.6, 0.8]) for i in range(9)]
    vectors = spark.createDataFrame(rows, "chunk_id string, vector array<double>").repartition(4)
    query = spark.createDataFrame([("q", [1.0, 0.0])], "question_id string, vector array<double>")
    got = [r.chunk_id for r in D.dense_search(vectors, query, 12).orderBy("rank").collect()]
    assert got == ["b", "a", *(f"x{i}" for i in range(9)), "c"]


CHANGES = [{"bm25": {"k1": 9.0}}, {"bm25": {"b": 0.0}}, {"rrf": {"c": 1.0}}, {"rrf": {"weight_bm25": 9.0}}, {"rrf": {"weight_dense": 9.0}}, {"lexical": {"lowercase": False}}, {"lexical": {"unicode_nfkc": False}}, {"top_n": 2}]


def test_every_setting_changes_the_rankings(spark):
    texts = {"c1": "cat", "c2": "cat cat cat cat and so many other words here", "c3": "Cat mat", "c4": "ｃａｔ dog dog", "c5": "mat mat sat sat"}
    queries, vectors = asked(spark, q="cat mat"), D.normalised(spark.createDataFrame([(c, [float(i), 3.0]) for i, c in enumerate(texts)], "chunk_id string, vector array<float>"))
    query = spark.createDataFrame([("q", [1.0, 0.0])], "question_id string, vector array<float>")
    run = lambda r: sorted((x.stage, x.rank, x.chunk_id, round(x.score, 9)) for x in run_matrix(chunks(spark, texts), queries, M.build_matrix(["e"])[4:5], {"e": vectors}, {"e": query}, r).collect())
    usual = run(Retrieval())
    assert [c for c in CHANGES if run(Retrieval.model_validate(c)) == usual] == []


def test_index_for_queries_equals_the_whole_index(spark):
    queries = asked(spark, q="cat unseen", r="the mat", none="")
    rows = lambda index: sorted((r.question_id, r.chunk_id, r.rank, round(r.score, 9)) for r in L.bm25_search(index, queries).collect())
    part = L.index_for(chunks(spark), queries)
    assert rows(part) == rows(L.build_index(chunks(spark))) and part.stats.collect() == L.build_index(chunks(spark)).stats.collect()
    assert L.index_for(chunks(spark).limit(0), queries).stats.first().n_docs == 0


def test_bm25_tokenises_the_corpus_once(spark, tmp_path):
    chunks(spark).write.parquet(str(tmp_path / "c"))
    stored = spark.read.parquet(str(tmp_path / "c"))
    plan = L.bm25_search(L.index_for(stored, asked(spark, q="cat")), asked(spark, q="cat"))._jdf.queryExecution().executedPlan().toString()
    assert "lexical-asked" in plan and str(tmp_path / "c") not in plan


def test_containing(spark, monkeypatch):
    texts = {"a": "the cat sat", "b": "a catalogue", "c": None, "d": "", "e": "the cat sat and the cat sat"}
    needles = [("1", "cat"), ("2", "the cat sat"), ("3", ""), ("4", None), ("5", "cat"), ("6", "zebra")]
    want = {(n, i) for i, t in texts.items() for n, x in needles if t and x and x in t}
    for block in (4, 1 << 20):
        got = K.containing(chunks(spark, texts), spark.createDataFrame(needles, "question_id string, needle string"), block_chars=block)
        assert {tuple(r) for r in got.collect()} == want
    assert K.containing(chunks(spark, texts), spark.createDataFrame([], "question_id string, needle string")).count() == 0


def test_vector_problems(spark):
    nan, inf = float("nan"), float("inf")
    rows = [("ok", [1.0, 0.0]), ("short", [1.0]), ("nan", [nan, 0.0]), ("inf", [inf, 0.0]), ("zero", [0.0, 0.0]), ("long", [2.0, 0.0]), ("none", None), ("hole", [1.0, None]), ("twice", [0.0, 1.0]), ("twice", [0.0, 1.0])]
    found = {(r.chunk_id, r.problem) for r in D.vector_problems(spark.createDataFrame(rows, "chunk_id string, vector array<float>"), 2).collect()}
    assert found == {("short", "dimension"), ("nan", "not finite"), ("inf", "not finite"), ("zero", "not of unit length"), ("long", "not of unit length"), ("none", "null"), ("hole", "null"), ("twice", "repeated id")}
    with pytest.raises(ConfigError):
        D.require_cosine(True, False)


def ranked(spark, *ids):
    return spark.createDataFrame([("q", i, c) for i, c in enumerate(ids, 1)], "question_id string, rank int, chunk_id string")


@pytest.mark.parametrize(
    "bm25,dense,how,order,scores",
    [
        ("ab", "bc", {}, "bac", [1 / 62 + 1 / 61, 1 / 61, 1 / 62]),
        ("a", "a", {}, "a", [2 / 61]),
        ("x", "y", {}, "xy", [1 / 61, 1 / 61]),
        ("a", "", {}, "a", [1 / 61]),
        ("a", "b", {"weight_bm25": 2.0, "weight_dense": 0.5}, "ab", [2 / 61, 0.5 / 61]),
        ("ab", "", {"c": 1.0}, "ab", [1 / 2, 1 / 3]),
    ],
)
def test_rrf(spark, bm25, dense, how, order, scores):
    rows = R.rrf_fuse(ranked(spark, *bm25), ranked(spark, *dense), **how).orderBy("rank").collect()
    assert "".join(r.chunk_id for r in rows) == order
    assert all(abs(r.score - s) < 1e-9 for r, s in zip(rows, scores, strict=True))
    assert [r.bm25_rank for r in rows] == [bm25.index(c) + 1 if c in bm25 else None for c in order]


def test_rrf_is_symmetric_and_cut_after_the_union(spark):
    a, b = ranked(spark, *"abcd"), ranked(spark, *"cdxy")
    one, two = ({r.chunk_id: r.score for r in R.rrf_union(x, y).collect()} for x, y in ((a, b), (b, a)))
    assert one == two and len(one) == 6
    assert R.rrf_fuse(a, b, top_n=3).count() == 3


CONFIGS = {
    1: ["bm25", "bm25_rerank", "dense_e", "dense_e_rerank", "hybrid_e", "hybrid_e_rerank"],
}


def test_matrix(spark):
    assert [c.config_id for c in M.build_matrix(["e"])] == CONFIGS[1]
    three = M.matrix_frame(spark, ["colibri", "qwen_embedding", "e5"])
    assert three.count() == 14
    pick = lambda *a, **k: [r.config_id for r in M.select_matrix(three, *a, **k).orderBy("position").collect()]
    assert pick(["dense_colibri"]) == ["dense_colibri", "dense_colibri_rerank"]
    assert pick(["dense_colibri"], include_reranker=False) == ["dense_colibri"]
    assert len(pick(None)) == len(pick(["all"])) == len(pick(["*"])) == 14 and pick([]) == []
    assert M.comparisons(spark, ["e", "f"]).count() == 10


def test_every_configuration_reranks_its_own_candidates(spark):
    texts = {f"c{i}": f"shared words here number {i} and {'more' * (i % 3)}" for i in range(10)}
    vectors = spark.createDataFrame([(c, [float(i), 10.0 - i]) for i, c in enumerate(texts)], "chunk_id string, vector array<float>")
    vectors = D.normalised(vectors)
    asked_vectors = spark.createDataFrame([("q1", [1.0, 3.0]), ("q2", [5.0, 1.0])], "question_id string, vector array<float>")
    queries = asked(spark, q1="shared number 3", q2="words 7 more")
    out = run_matrix(chunks(spark, texts), queries, M.build_matrix(["e"]), {"e": vectors}, {"e": asked_vectors}, Retrieval(top_n=6), lambda q, t: F.length(t) % 7, timings=(took := [])).collect()
    assert {(c, s) for c, s, _, n in took if n == 2 and _ > 0} >= {("hybrid_e_rerank", "rrf"), ("hybrid_e_rerank", "rerank"), ("bm25", "bm25"), ("dense_e", "dense")}
    lists = {}
    for r in out:
        lists.setdefault((r.config_id, r.question_id, r.stage), []).append((r.rank, r.chunk_id))
    lists = {k: [c for _, c in sorted(v)] for k, v in lists.items()}
    for base in ("bm25", "dense_e", "hybrid_e"):
        for q in ("q1", "q2"):
            assert lists[base + "_rerank", q, "to_rerank"] == lists[base, q, "final"]
            assert sorted(lists[base + "_rerank", q, "final"]) == sorted(lists[base, q, "final"])
    assert {s for c, _, s in lists if c == "bm25"} == {"bm25", "final"}
    assert {s for c, _, s in lists if c == "hybrid_e_rerank"} == {"bm25", "dense", "rrf_union", "rrf_topn", "to_rerank", "final"}
    assert lists["hybrid_e", "q1", "rrf_topn"] == lists["hybrid_e", "q1", "rrf_union"][:6]
    scored = {(r.config_id, r.stage): r for r in out if r.question_id == "q1" and r.rank == 1}
    last = scored["hybrid_e_rerank", "final"]
    assert last.rerank_score == last.score and last.rrf_score is not None and last.dense_rank is not None
    assert scored["bm25", "final"].bm25_rank == 1 and scored["bm25", "final"].rrf_score is None and scored["bm25_rerank", "to_rerank"].rerank_score is None
    assert run_matrix(chunks(spark, texts), queries, []).count() == 0
    df = spark.createDataFrame(out)
    assert stage_list(df, "unknown").count() == 0
