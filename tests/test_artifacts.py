import json
from pathlib import Path

import pytest
import yaml
from pydantic import ValidationError
from pyspark.sql import functions as F

from ravenna import artifacts as A
from ravenna.config import Settings, load_settings
from ravenna.errors import ConfigError, FrozenCorpusError, IncompatibleArtifactError, MissingArtifactError
from ravenna.operators.context import assemble_context, raise_problems
from ravenna.operators.human_eval import SHEET, blind_rows
from ravenna.operators.lexical import build_index, index_differences
from ravenna.sources import files, sinks


def chunk_frame(spark, n=5, words=39):
    rows = [(f"c{i}", "d", None if i % 2 else i + 1, f"c{i} " + "w " * (words if i != 1 else 3)) for i in range(n)]
    return spark.createDataFrame(rows, "chunk_id string, doc_id string, page int, text string")


def ranked(spark, *ids, q="q"):
    return spark.createDataFrame([(q, i, c) for i, c in enumerate(ids, 1)], "question_id string, rank int, chunk_id string")


def test_context_skips_what_does_not_fit_and_goes_on(spark):
    prompt = spark.createDataFrame([("q", "ask this"), ("none", "x")], "question_id string, prompt string")
    out = {r.question_id: r for r in assemble_context(ranked(spark, "c0", "c2", "c1", "c3"), chunk_frame(spark), prompt, top_k=3, budget=70).collect()}
    assert (out["q"].included, out["q"].excluded) == (["c0", "c1"], ["c2"])
    assert out["q"].context_text.startswith("[ID: c0 | doc=d | página 1]\nc0 w") and "[ID: c1 | doc=d]\n" in out["q"].context_text
    assert out["q"].total_tokens == out["q"].prompt_tokens + out["q"].context_tokens + 512 and out["q"].context_tokens <= 70
    assert (out["none"].included, out["none"].context_text, out["none"].problem) == ([], "", None)
    wide = assemble_context(ranked(spark, "c0", "c2", "c1"), chunk_frame(spark), prompt).where("question_id = 'q'").first()
    assert wide.excluded == [] and wide.problem is None


@pytest.mark.parametrize("how,problem", [({"budget": 3}, "no candidate"), ({"window": 513}, "exceed the window")])
def test_context_problems_are_errors(spark, how, problem):
    prompt = spark.createDataFrame([("q", "ask this")], "question_id string, prompt string")
    out = assemble_context(ranked(spark, "c0"), chunk_frame(spark), prompt, **how)
    assert problem in out.first().problem
    with pytest.raises(Exception, match=problem):
        raise_problems(out).collect()


def test_blind_rows(spark):
    rows = [(f"q{i}", f"k{i % 2}", f"answer {i}", "ctx", ["c1", "c2"] if i else None) for i in range(12)]
    gen = spark.createDataFrame(rows, "question_id string, config_id string, response string, context_text string, context_included array<string>")
    questions = spark.createDataFrame([("q1", "text of 1")], "question_id string, text string")
    sheet, key = blind_rows(gen, questions)
    assert tuple(sheet.columns) == SHEET and {r.blind_id for r in sheet.collect()} == {f"item-{i:03d}" for i in range(1, 13)}
    by = {r.blind_id: r for r in key.collect()}
    answers = {by[r.blind_id].question_id: (r.question, r.generated_answer, r.context_included_ids) for r in sheet.collect()}
    assert answers["q1"] == ("text of 1", "answer 1", "c1, c2") and answers["q2"][0] == "q2" and answers["q0"][2] == ""
    assert [by[k].question_id for k in sorted(by)] != sorted(f"q{i}" for i in range(12))
    assert {tuple(r) for r in blind_rows(gen.repartition(3), questions)[1].collect()} == {tuple(r) for r in key.collect()}
    assert blind_rows(gen.limit(0), questions)[0].count() == 0


def test_canonical_hashes(tmp_path):
    assert A.hash_json({"b": 1, "a": "é"}) == A.sha256_text('{"a":"é","b":1}')
    assert A.hash_json({"a": 1, "b": 2}) == A.hash_json({"b": 2, "a": 1}) != A.hash_json({"a": 1})
    f = tmp_path / "x"
    f.write_text("açã")
    assert A.sha256_file(f) == A.sha256_text("açã")
    assert A.source_issues({"x": f}, {"x": A.sha256_text("açã"), "y": ""}) == (["y"], []) and A.source_issues({"x": f}, {"x": "no"}) == ([], ["x"])
    base = A.index_fingerprint("bm25", "v", k1=1.2, b=0.75, lexical={})
    assert base == A.sha256_text('{"b":0.75,"corpus_version":"v","k1":1.2,"kind":"bm25","lexical":{}}') != A.index_fingerprint("bm25", "v2", k1=1.2, b=0.75, lexical={})
    dense = {"embedding_name": "e", "checkpoint": "c", "revision": None}
    assert A.index_fingerprint("dense", "v", dimension=4, **dense) != A.index_fingerprint("dense", "v", dimension=5, **dense)
    with pytest.raises(ValueError):
        A.index_fingerprint("dense", "v", k1=1)
    with pytest.raises(IncompatibleArtifactError):
        A.require_same(base, "other", "index")
    assert A.new_run_id().startswith("run-") and A.Timer().stop() >= 0
    pinned = {"m": {"checkpoint": "org/m", "revision": "0" * 40}}
    assert A.pinned_revisions(pinned, {"m": "org/m"}) == {"org/m": "0" * 40}
    for bad, expected in ((pinned, {"m": "org/other"}), (pinned, {"m": "org/m", "n": "org/n"}), ({"m": {"checkpoint": "org/m", "revision": "main"}}, {"m": "org/m"})):
        with pytest.raises(IncompatibleArtifactError):
            A.pinned_revisions(bad, expected)


def test_checkpoints_are_found_at_their_pinned_revision(tmp_path):
    pins = {"org/m": "a" * 40}
    with pytest.raises(IncompatibleArtifactError, match="revision"):
        A.local_checkpoint(tmp_path, "org/m", pins)
    sinks.write_json(tmp_path / "revisions.json", {"revisions": pins})
    with pytest.raises(MissingArtifactError):
        A.local_checkpoint(tmp_path, "org/m", pins)
    (tmp_path / "models--org--m" / "snapshots" / ("a" * 40)).mkdir(parents=True)
    assert A.local_checkpoint(tmp_path, "org/m", pins).name == "a" * 40


def test_audited_sources(tmp_path):
    (tmp_path / "d.pdf").write_bytes(b"x")
    (tmp_path / "d.md").write_text("text")
    raw = {"corpus_version": "0" * 64, "documents": {"d": {"pdf_filename": "d.pdf", "pdf_sha256": A.sha256_file(tmp_path / "d.pdf"), "md_sha256": A.sha256_text("text")}}}
    A.require_sources(tmp_path, raw, "pdf")
    A.require_sources(tmp_path, raw, "markdown")
    (tmp_path / "d.md").write_text("changed")
    with pytest.raises(IncompatibleArtifactError, match="changed: ."):
        A.require_sources(tmp_path, raw, "markdown")
    for bad in ({"documents": None}, {"corpus_version": "short"}, {"documents": {"d": raw["documents"]["d"] | {"md_sha256": "no"}}}, {"documents": {"a b": raw["documents"]["d"]}}):
        with pytest.raises(ConfigError):
            A.audited_corpus(raw | bad)


BOUND = {k: k for k in A.BOUND}


@pytest.fixture(scope="module")
def rankings(spark):
    rows = [("A", "q1", "final", 1, "c1", 0.5), ("A", "q1", "final", 2, "c2", 0.25)]
    return spark.createDataFrame(rows, "config_id string, question_id string, stage string, rank int, chunk_id string, score double")


def test_run_validation(spark, rankings):
    manifest = A.run_manifest("run-1", BOUND, ["A"], ["q1"], rankings)
    chunks = spark.createDataFrame([("c1",), ("c2",)], "chunk_id string")
    good = ["run-1", BOUND, ["A"], ["q1"], rankings.repartition(3), chunks]
    A.require_run(manifest, *good)
    for k in A.BOUND:
        assert A.run_problems(manifest | {k: "other"}, *good) == [f"{k} differs"]
    assert A.run_problems(manifest, "run-2", *good[1:]) == ["run_id differs"]
    assert A.run_problems(manifest, *good[:2], ["A", "B"], *good[3:]) == ["the configurations differ"]
    assert A.run_problems(manifest, *good[:3], [], *good[4:]) == ["the questions differ"]
    assert A.run_problems(manifest, *good[:4], rankings.withColumn("score", F.col("score") + 1), chunks) == ["the rankings changed"]
    assert A.run_problems(manifest, *good[:5], chunks.limit(1)) == ["a ranked chunk is not in the corpus"]
    assert "a chunk repeats in a list" in A.run_problems(manifest, *good[:4], rankings.unionByName(rankings), chunks)
    with pytest.raises(IncompatibleArtifactError, match="seed"):
        A.require_run(manifest | {"seed": 1}, *good)


@pytest.mark.parametrize(
    "bad",
    [
        {"chunking": {"target_tokens": 5, "overlap_tokens": 5}},
        {"chunking": {"unknown": 1}},
        {"retrieval": {"bm25": {"b": 2}}},
        {"retrieval": {"rrf": {"c": 0}}},
        {"retrieval": {"cosine_similarity": False}},
        {"retrieval": {"lexical": {"strip_accents": True}}},
        {"models": {"reranker": {"checkpoint": "other"}}},
        {"models": {"revisions_path": "other.yaml"}},
        {"experiments": {"embeddings": ["no"]}},
        {"experiments": {"embeddings": ["e5", "e5"]}},
        {"metrics": {"primary": 3}},
    ],
)
def test_bad_settings(bad, tmp_path):
    path = tmp_path / "s.yaml"
    path.write_text(yaml.safe_dump(bad))
    with pytest.raises(ValidationError):
        load_settings(path)


def test_settings_hash_without_the_machine(tmp_path):
    assert Settings(root=tmp_path).fingerprint() == Settings().fingerprint() == load_settings().fingerprint()
    assert Settings(experiments={"seed": 1}).fingerprint() != Settings().fingerprint()


def test_annotations_are_read_and_checked(spark, tmp_path):
    good = {"questions": [{"question_id": "q1", "text": "t", "expected_answer": "a", "origin_doc_id": "d", "evidence": [{"evidence_id": "e", "doc_id": "d"}]}]}
    path = tmp_path / "q.yaml"
    sinks.write_yaml(path, good)
    row = files.read_annotations(spark, path, "questions").first()
    assert (row.review_status, row.question_type, row.evidence[0].quote, row.evidence[0].chunk_ids) == ("draft", "factual", "", [])
    with pytest.raises(ConfigError):
        files.read_annotations(spark, tmp_path / "none.yaml", "questions")
    sinks.write_yaml(path, {"questions": [good["questions"][0] | {"surprise": 1}]})
    with pytest.raises(ConfigError, match="surprise"):
        files.read_annotations(spark, path, "questions")
    sinks.write_yaml(path, {"questions": [good["questions"][0] | {"text": ""}]})
    with pytest.raises(Exception, match="text is empty"):
        files.read_annotations(spark, path, "questions").collect()


def full_chunks(spark):
    rows = [(f"c{i}", "d", "b", 1, None, "text", f"text {i}", 2, 6, "h") for i in range(3)]
    return spark.createDataFrame(rows, files.schemas.schema("chunks"))


def test_frozen_corpus(spark, tmp_path):
    chunks = full_chunks(spark)
    manifest = {"frozen": True} | files.frozen_identity(chunks)
    assert (manifest["chunk_count"], manifest["document_count"]) == (3, 1)
    path, record = str(tmp_path / "chunks"), tmp_path / "manifest.json"
    sinks.write_frozen_chunks(chunks, path, manifest, record)
    assert files.read_frozen_corpus(spark, path, record).count() == 3
    with pytest.raises(FrozenCorpusError):
        sinks.write_frozen_chunks(chunks, path + "2", manifest, record)
    for change in ({"chunk_count": 4}, {"corpus_version": "x"}, {"documents_digest": "x"}, {"document_count": 2}, {"frozen": False}):
        sinks.write_json(record, manifest | change)
        with pytest.raises(FrozenCorpusError):
            files.read_frozen_corpus(spark, path, record)
    altered = chunks.withColumn("text", F.when(F.col("chunk_id") == "c1", "other").otherwise(F.col("text")))
    assert files.frozen_corpus_problems(altered, manifest) == ["version"]
    assert "repeated ids" in files.frozen_corpus_problems(chunks.unionByName(chunks), manifest)


def test_json_lines_markdown_and_index(spark, tmp_path):
    sinks.write_json_lines(full_chunks(spark), str(tmp_path / "j"))
    assert files.read_json_lines(spark, str(tmp_path / "j"), "chunks").count() == 3
    (tmp_path / "bad.jsonl").write_text('{"chunk_id": "c"}\n\n{broken\n')
    with pytest.raises(Exception, match="MALFORMED|Malformed"):
        files.read_json_lines(spark, str(tmp_path / "bad.jsonl"), "chunks").collect()
    (tmp_path / "md").mkdir()
    (tmp_path / "md" / "art-1.md").write_text("# art-1\n\ntext\n")
    assert [tuple(r) for r in files.read_markdown(spark, str(tmp_path / "md")).collect()] == [("art-1", "# art-1\n\ntext\n")]
    index = build_index(full_chunks(spark))
    sinks.write_lexical_index(index, str(tmp_path / "index"))
    assert index_differences(sinks.read_lexical_index(spark, str(tmp_path / "index")), index).count() == 0


def test_rankings_round_trip_and_runs(spark, rankings, tmp_path):
    full = rankings.select("*", *(F.lit(None).cast(t).alias(c) for c, t in (("bm25_rank", "int"), ("dense_rank", "int"), ("rrf_score", "double"), ("rerank_score", "double"))))
    sinks.write_rankings(full, str(tmp_path / "run-2" / "r"))
    assert A.rankings_digest(files.read_rankings(spark, str(tmp_path / "run-2" / "r"))) == A.rankings_digest(rankings)
    (tmp_path / "run-10").mkdir()
    (tmp_path / "other").mkdir()
    assert files.latest_run(tmp_path) == "run-2" and files.latest_run(tmp_path / "none") is None
    assert files.checkpoint_inventory(tmp_path / "none")["available"] is False
    for name in ("config.json", "tokenizer.json", "model.safetensors"):
        (tmp_path / "other" / name).write_text("x")
    assert files.checkpoint_inventory(tmp_path / "other")["available"] is True


def test_pdfs_through_a_parser(spark, tmp_path):
    (tmp_path / "good.pdf").write_bytes(b"two pages")
    (tmp_path / "bad.pdf").write_bytes(b"broken")

    def parser(data: bytes) -> list:
        if data == b"broken":
            raise ValueError("no PDF")
        return [{"page_number": 1, "text": data.decode(), "word_count": 2}, {"page_number": 2, "text": "", "has_text_layer": False}]

    got = {r.doc_id: r for r in files.read_pdfs(spark, str(tmp_path), parser, lambda data: {"n": 2}).collect()}
    assert got["good"].pages[0].text == "two pages" and got["good"].metadata == {"n": "2"} and got["good"].review_items == ["page 2: no text layer"]
    assert "no PDF" in got["bad"].warnings[0] and got["bad"].review_items == ["no text was extracted"]
    with pytest.raises(MissingArtifactError):
        files.read_pdfs(spark, str(tmp_path))


def test_sheet_and_review_record(spark, tmp_path):
    gen = spark.createDataFrame([("q", "k", 'an "answer", two\nlines', "", ["c"])], "question_id string, config_id string, response string, context_text string, context_included array<string>")
    sheet, key = blind_rows(gen, spark.createDataFrame([], "question_id string, text string"))
    sinks.write_sheet(sheet, key, str(tmp_path / "sheet"), tmp_path / "key.json")
    assert json.loads((tmp_path / "key.json").read_text()) == {"item-001": {"question_id": "q", "config_id": "k"}}
    assert "blind_id,question" in next(Path(tmp_path / "sheet").glob("*.csv")).read_text()
    path = tmp_path / "q.yaml"
    sinks.write_yaml(path, {"questions": [{"question_id": "q", "review_status": "draft"}]})
    seen = path.read_bytes()
    left = sinks.record_review(path, tmp_path / "reviews", "q", "approved", " me ", "", "today", seen)
    assert files.read_yaml(path)["questions"][0]["review_status"] == "approved" and files.read_yaml(left)["reviews"][0]["reviewer"] == "me"
    with pytest.raises(FrozenCorpusError):
        sinks.record_review(path, tmp_path / "reviews", "q", "rejected", "me", "", "today", seen)
    assert len(list((tmp_path / "reviews").iterdir())) == 1 and not list(tmp_path.glob(".q*"))
