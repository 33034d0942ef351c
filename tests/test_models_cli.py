import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from ravenna import cli
from ravenna.config import EMBEDDINGS
from ravenna.operators import fusion, models
from ravenna.sources import files, sinks


def make_model(limit=None):
    """A stand-in whose vectors count letters and whose pair score is the pair's length; made where it runs."""

    def make():
        class Model:
            pass

        m = Model()
        m.limit = limit
        m.count = lambda t: len(t.split())
        m.encode = lambda texts: np.array([[t.count("a") + 1.0, t.count("b") + 1.0] for t in texts])
        m.score = lambda pairs: [float(len(p)) for p in pairs]
        return m

    return make


def test_encoder(spark):
    rows = spark.createDataFrame([("c1", "aaa"), ("c2", None), ("c3", "ab ab ab")], "chunk_id string, text string")
    got = {r.chunk_id: r.vector for r in models.encoded(rows, make_model(), batch=2).collect()}
    assert np.allclose(got["c1"], np.array([4, 1]) / np.sqrt(17)) and np.allclose(got["c2"], np.array([1, 1]) / np.sqrt(2))
    with pytest.raises(Exception, match="nothing is cut silently"):
        models.encoded(rows, make_model(2)).collect()


def test_pair_scorer_reranks(spark):
    candidates = spark.createDataFrame([("q", 1, "c1"), ("q", 2, "c2")], "question_id string, rank int, chunk_id string")
    chunks = spark.createDataFrame([("c1", "short"), ("c2", "a longer text")], "chunk_id string, text string")
    queries = spark.createDataFrame([("q", "why")], "question_id string, text string")
    out = fusion.rerank(candidates, queries, chunks, models.pair_scorer(make_model(), "task")).orderBy("rank").collect()
    assert [(r.chunk_id, r.base_rank) for r in out] == [("c2", 2), ("c1", 1)]
    assert models.yes_probability(np.array([0.0, 50.0]), np.array([0.0, 0.0])).round(3).tolist() == [0.5, 1.0]


def test_pooling_and_precision():
    states = np.arange(2 * 3 * 2, dtype=float).reshape(2, 3, 2)
    right, left = np.array([[1, 1, 0], [1, 1, 1]]), np.array([[0, 1, 1], [0, 0, 0]])
    assert models.pooled(states, right, "mean").tolist() == [[1.0, 2.0], [8.0, 9.0]]
    assert models.pooled(states, right, "last_token").tolist() == [[2.0, 3.0], [10.0, 11.0]]
    assert models.pooled(states, left, "last_token").tolist() == [[4.0, 5.0], [0.0, 0.0]] and models.pooled(states, left, "mean")[1].tolist() == [0, 0]
    wanted = {("fp16", "cuda"): "fp16", ("fp16", "cpu"): "fp32", ("bf16", "cpu"): "bf16", ("bf16", "cuda"): "fp32", ("fp32", "cuda"): "fp32"}
    assert {k: models.usable_dtype(*k) for k in wanted} == wanted and models.usable_dtype("bf16", "cuda", True) == "bf16"
    with pytest.raises(ValueError):
        models.pooled(states, right, "max")


def test_models_leave_with_their_task():
    closed = []

    class Model:
        def close(self):
            closed.append(1)

    with pytest.raises(RuntimeError), models.loaded(Model):
        raise RuntimeError
    assert closed == [1]


def test_templates(spark):
    row = spark.createDataFrame([("what",)], "q string").select(models.templated("Instruct: {task}\nQuery: {query}", F.col("q"), "find").alias("a"), models.templated("{text}", F.col("q")).alias("b")).first()
    assert tuple(row) == ("Instruct: find\nQuery: what", "what")


def test_generation_errors_are_rows(spark):
    def make():
        def ask(prompt):
            if "bad" in prompt:
                raise RuntimeError("no service")
            return {"model": "m", "response": prompt.upper()}

        return ask

    prompts = spark.createDataFrame([("q1", "k", "hi"), ("q2", "k", "bad")], "question_id string, config_id string, prompt string")
    got = {r.question_id: r for r in models.generated(prompts, make).collect()}
    assert (got["q1"].response, got["q1"].error, got["q2"].error, got["q2"].response) == ("HI", None, "no service", "")
    unreachable = models.generated(prompts.limit(1), models.http_generator("http://127.0.0.1:9", "m", timeout=1)).first()
    assert unreachable.error


def test_query_vectors_are_encoded_once(spark, tmp_path):
    queries = spark.createDataFrame([("q1", "aaa"), ("q2", "b")], "question_id string, text string")
    log = tmp_path / "log"

    def make():
        class Model:
            limit = None

            def encode(self, texts):
                with open(log, "a") as f:
                    f.write("".join(t + "\n" for t in texts))
                return np.ones((len(texts), 2))

        return Model()

    run = lambda q, e="e": models.cached_vectors(q, e, make, F.concat(F.lit("ask "), "text"), str(tmp_path / "cache")).collect()
    assert {r.question_id for r in run(queries)} == {"q1", "q2"} and sorted(log.read_text().split("\n"))[1:] == ["ask aaa", "ask b"]
    assert len(run(queries)) == 2 and len(log.read_text().split()) == 4
    assert len(run(queries.withColumn("text", F.when(F.col("question_id") == "q2", "c").otherwise(F.col("text"))))) == 2
    assert log.read_text().endswith("ask c\n") and len(log.read_text().split()) == 6
    assert len(run(queries, "other")) == 2 and len(log.read_text().split()) == 10


@pytest.fixture
def project(tmp_path):
    (tmp_path / "md").mkdir()
    (tmp_path / "md" / "art.md").write_text("# art\n<!-- PAGE 1 -->\n\nBirds fly over the lake.\n\nFish swim under the bridge.\n\nCats sleep on the sofa.\n")
    q = lambda n, text, chunk: {"question_id": n, "text": text, "expected_answer": "unsaid", "origin_doc_id": "art", "review_status": "approved", "evidence": [{"evidence_id": "e" + n, "doc_id": "art", "page": 1, "quote": "x", "chunk_ids": [chunk]}]}
    tables = {
        "articles": [{"doc_id": "art", "title": "t", "pdf_filename": "f.pdf", "pages": 1}],
        "questions": [q("q1", "where do birds fly", "art-b0000-c000"), q("q2", "who sleeps on the sofa", "art-b0002-c000")],
        "qrels": [{"question_id": "q1", "chunk_id": "art-b0000-c000", "relevance": 1}, {"question_id": "q2", "chunk_id": "art-b0002-c000", "relevance": 1}],
        "evidence_groups": [],
    }
    for name, items in tables.items():
        sinks.write_yaml(tmp_path / "gold" / f"{name}.yaml", {name: items})
    return tmp_path


class LetterModel:
    """Vectors that count letters, of the width that the embedding has."""

    limit = None

    def __init__(self, width):
        self.width = width

    def count(self, text):
        return len(text.split())

    def encode(self, texts):
        x = np.zeros((len(texts), self.width))
        for i, t in enumerate(texts):
            for c in t.lower():
                x[i, ord(c) % 97] += 1
        return x


def encoders(name):
    width = EMBEDDINGS[name]["dimension"]
    return lambda: LetterModel(width)


def generator():
    return lambda prompt: {"model": "stand-in", "response": f"{len(prompt)} characters"}


def test_commands_end_to_end(spark, project, capsys, monkeypatch):
    from ravenna import config

    monkeypatch.setitem(config.EMBEDDINGS["e5"], "dimension", 100)
    p = {n: str(project / n) for n in ("md", "chunks", "index", "gold", "results")}
    corpus = ["--chunks", p["chunks"], "--manifest", str(project / "manifest.json")]
    sinks.write_yaml(project / "settings.yaml", {"experiments": {"embeddings": ["e5"]}, "root": str(project)})
    run = lambda name, *args: cli.main([name, "--config", str(project / "settings.yaml"), *args], spark)
    said = lambda: capsys.readouterr().out
    assert run("matrix") == 0 and len(said().split()) == 6
    assert run("chunk", "--markdown", p["md"], *corpus) == 2  # no tokenizers
    assert run("chunk", "--markdown", p["md"], *corpus, "--tokenizers", "qwen_embedding=/opt/tokenizers/byte_bpe_50k.json") == 2
    assert run("chunk", "--markdown", p["md"], *corpus, "--tokenizers", "e5=/opt/tokenizers/byte_bpe_50k.json") == 0
    report = files.read_json(project / "manifest.json")["token_validation"]
    assert (report["binding_model"], report["binding_limit"], report["per_model"]["e5"]["overflow_chunks"], report["subdivided_blocks"]) == ("e5", 512, 0, 0)
    assert run("chunk", "--markdown", p["md"], *corpus, "--tokenizers", "e5=/opt/tokenizers/byte_bpe_50k.json") == 2
    gold, results = ["--annotations", p["gold"]], ["--results", p["results"]]
    assert run("retrieve", *corpus, *gold, *results, "--index", p["index"]) == 2  # no index
    me = __name__
    for word in ("built", "kept"):
        assert run("index", *corpus, "--index", p["index"], "--encoders", f"{me}:encoders") == 0 and said().count(word) == 2
    assert run("validate", *gold, "--chunks", p["chunks"]) == 0
    assert run("evaluate", *corpus, *gold, *results) == 2
    assert run("retrieve", *corpus, *gold, *results, "--index", p["index"], "--encoders", f"{me}:encoders") == 0
    assert run("report", *corpus, *gold, *results) == 2
    assert run("evaluate", *corpus, *gold, *results) == 0
    latest = project / "results" / files.latest_run(p["results"])
    summary = files.read_json(latest / "metrics_summary.json")
    means = {m["config_id"]: m for m in summary["means"]}
    assert len(means) == 6 and means["bm25"]["mrr@10"] == 1.0 and {t["stage"] for t in summary["timings"]} == {"bm25", "dense", "rrf", "rerank"}
    assert {d["label"] for d in files.read_json(latest / "comparison.json")} == {"pipeline_total", "hibridizacao", "rerank_dense", "rerank_hybrid", "hibridizacao_com_rerank"}
    text = (latest / "report.md").read_text()
    assert "bm25_rerank" in text and "Query encoding" in text and "Mean seconds" in text
    said()
    assert run("report", *corpus, *gold, *results) == 0 and said().strip() == text.strip()
    assert run("generate", *corpus, *gold, *results, "--configuration", "bm25", "--generator", f"{me}:generator") == 0
    rows = spark.read.json(str(latest / "generation" / "generations")).collect()
    assert {r.question_id for r in rows} == {"q1", "q2"} and all(r.context_included and "characters" in r.response and "Question:\n" in r.prompt_sent for r in rows)
    assert len(files.read_json(latest / "generation" / "blind_mapping.json")) == 2
    where = [*corpus, *gold, *results, "--index", p["index"]]
    said()
    assert run("status", *where) == 0
    status = json.loads(said())
    assert status["corpus"]["status"] == status["indexes"]["bm25"]["status"] == status["indexes"]["e5"]["status"] == "valid"
    assert status["gold"]["approved"] == 2 and status["models"]["e5"]["status"] == "invalid" and not status["ready"]
    assert run("inventory", *where, "--require", "corpus,indexes") == 0 and run("inventory", *where, "--require", "corpus,models") == 2
    assert "corpus: READY" in said() and run("prepare-models") == 2
    other = files.read_yaml(project / "settings.yaml") | {"retrieval": {"bm25": {"k1": 2.0}}}
    sinks.write_yaml(project / "other.yaml", other)
    assert cli.main(["retrieve", "--config", str(project / "other.yaml"), *where], spark) == 2  # the index is of other settings
    table = spark.read.parquet(f"{p['index']}/bm25/lengths").withColumn("doc_len", F.col("doc_len") + 1)
    sinks.write_table(spark.createDataFrame(table.collect(), table.schema), f"{p['index']}/bm25/lengths")
    assert run("retrieve", *where) == 2  # an altered index
    qrels = files.read_yaml(project / "gold" / "qrels.yaml")
    qrels["qrels"].append({"question_id": "none", "chunk_id": "none", "relevance": 1})
    sinks.write_yaml(project / "gold" / "qrels.yaml", qrels)
    assert run("validate", *gold, "--chunks", p["chunks"]) == 1
    assert run("evaluate", *corpus, *gold, *results) == 2


def test_review_of_gold(spark, project, capsys):
    p = {n: str(project / n) for n in ("md", "chunks", "gold")}
    corpus = ["--chunks", p["chunks"], "--manifest", str(project / "manifest.json")]
    sinks.write_yaml(project / "settings.yaml", {"chunking": {"require_token_validation": False}})
    run = lambda name, *args: cli.main([name, "--config", str(project / "settings.yaml"), *args], spark)
    assert run("chunk", "--markdown", p["md"], *corpus) == 0
    path = project / "gold" / "questions.yaml"
    raw = files.read_yaml(path)
    raw["questions"][0] |= {"review_status": "draft", "notes": "Análise automática: READY_FOR_HUMAN_REVIEW"}
    raw["questions"][0]["evidence"][0]["quote"] = "Birds fly"
    raw["questions"].append(raw["questions"][1] | {"question_id": "q3", "review_status": "draft", "evidence": []})
    sinks.write_yaml(path, raw)
    review = lambda *args: run("review-gold", "--annotations", p["gold"], *corpus, "--markdown", p["md"], *args)
    capsys.readouterr()
    assert review("--summary") == 0 and "draft_ready: 1" in capsys.readouterr().out
    assert review() == 0 and capsys.readouterr().out.count(" | ") == 4
    assert review("--next") == 0 and "question_id: q1" in capsys.readouterr().out
    approve = ("--question", "q1", "--decision", "approve", "--reviewer", "someone")
    assert review(*approve) == 2 and "confirmation" in capsys.readouterr().err
    assert review("--question", "q3", "--decision", "approve", "--reviewer", "someone", "--confirm") == 2 and "no evidence" in capsys.readouterr().err
    assert review("--question", "none") == 2 and review("--decision", "reject") == 2
    assert review(*approve, "--confirm") == 0 and files.read_yaml(path)["questions"][0]["review_status"] == "approved"
    assert review("--question", "q3", "--decision", "reject", "--reviewer", "someone", "--confirm") == 0
    assert len(list((project / "gold" / "reviews").iterdir())) == 2 and review("--next") == 0 and "no draft" in capsys.readouterr().out
