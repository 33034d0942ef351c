"""Identities of indexes and runs: canonical hashes, fingerprints, run manifests and their validation."""

from __future__ import annotations

import hashlib
import json
import platform
import re
import time
import uuid
from datetime import datetime, timezone
from importlib import metadata
from pathlib import Path
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ravenna.errors import ConfigError, IncompatibleArtifactError, MissingArtifactError


def sha256_text(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def sha256_file(path: str | Path) -> str:
    with open(path, "rb") as f:
        return hashlib.file_digest(f, "sha256").hexdigest()


#: The form of hashed JSON. Sorted keys, no spaces, characters as they are.
CANONICAL = {"sort_keys": True, "separators": (",", ":"), "ensure_ascii": False, "default": str}


def hash_json(value: Any) -> str:
    return sha256_text(json.dumps(value, **CANONICAL))


def utc_now() -> str:
    return datetime.now(timezone.utc).isoformat(timespec="seconds")


def new_run_id() -> str:
    return f"run-{datetime.now(timezone.utc):%Y%m%dT%H%M%S+0000}-{uuid.uuid4().hex[:8]}"


def index_fingerprint(kind: str, corpus_version: str, **of: Any) -> str:
    """The identity of an index of a corpus: "bm25" with k1, b and lexical, "dense" with embedding_name, checkpoint, revision and dimension."""
    needed = {"bm25": {"k1", "b", "lexical"}, "dense": {"embedding_name", "checkpoint", "revision", "dimension"}}[kind]
    if set(of) != needed:
        raise ValueError(f"a {kind} index is identified by {sorted(needed)}")
    return hash_json({"kind": kind, "corpus_version": corpus_version, **of})


def require_same(stored: Any, expected: Any, what: str) -> None:
    if stored != expected:
        raise IncompatibleArtifactError(f"{what}: stored {stored!r}, expected {expected!r}")


def environment() -> dict[str, Any]:
    """Versions that a manifest may name."""
    found = {}
    for name in ("pyspark", "numpy", "pyarrow", "pandas"):
        try:
            found[name] = metadata.version(name)
        except metadata.PackageNotFoundError:
            found[name] = None
    return {"python": platform.python_version(), "system": platform.system(), "packages": found}


class Timer:
    """Wall-clock seconds since it was made or reset."""

    def __init__(self):
        self.reset()

    def reset(self) -> None:
        self.began = time.perf_counter()

    def stop(self) -> float:
        return time.perf_counter() - self.began


def rankings_digest(rankings: DataFrame) -> dict[str, str]:
    """A hash for each configuration, the same whatever the rows' order; a handful of rows reaches the driver."""
    line = F.sha2(F.to_json(F.struct("question_id", "stage", "rank", "chunk_id", F.round("score", 9)), {"ignoreNullFields": "false"}), 256)
    parts = [F.sum(F.conv(F.substring(line, 1 + 15 * i, 15), 16, 10).cast("decimal(38,0)")) for i in range(4)]
    rows = rankings.groupBy("config_id").agg(F.count("*").alias("n"), *(p.alias(f"p{i}") for i, p in enumerate(parts))).collect()
    return {r["config_id"]: hash_json([r["n"], *(str(r[f"p{i}"]) for i in range(4))]) for r in rows}


#: What a run and the present inputs must agree in.
BOUND = ("corpus_version", "config_hash", "questions_hash", "qrels_hash", "groups_hash", "seed", "embeddings")


def run_manifest(run_id: str, bound: dict[str, Any], config_ids: list[str], question_ids: list[str], rankings: DataFrame, parameters: dict[str, Any] | None = None) -> dict[str, Any]:
    missing = set(BOUND) - set(bound)
    if missing:
        raise ValueError(f"a manifest needs {sorted(missing)}")
    return {"run_id": run_id, **{k: bound[k] for k in BOUND}, "config_ids": list(config_ids), "question_ids": sorted(question_ids), "ranking_hashes": rankings_digest(rankings), "environment": environment(), "parameters": parameters or {}, "generated_at": utc_now()}


def run_problems(manifest: dict[str, Any], run_id: str, bound: dict[str, Any], config_ids: list[str], question_ids: list[str], rankings: DataFrame, chunks: DataFrame) -> list[str]:
    """Why a run can't be evaluated against the present inputs; empty when it can."""
    found = [f"{k} differs" for k in BOUND if manifest.get(k) != bound.get(k)]
    if manifest.get("run_id") != run_id:
        found.append("run_id differs")
    if set(manifest.get("config_ids", [])) != set(config_ids):
        found.append("the configurations differ")
    if set(manifest.get("question_ids", [])) != set(question_ids):
        found.append("the questions differ")
    if manifest.get("ranking_hashes") != rankings_digest(rankings):
        found.append("the rankings changed")
    if not rankings.join(chunks.select("chunk_id").distinct(), "chunk_id", "left_anti").isEmpty():
        found.append("a ranked chunk is not in the corpus")
    if not rankings.groupBy("config_id", "question_id", "stage", "chunk_id").count().where("count > 1").isEmpty():
        found.append("a chunk repeats in a list")
    return found


def require_run(*args: Any) -> None:
    if problems := run_problems(*args):
        raise IncompatibleArtifactError("the run can't be evaluated: " + "; ".join(problems))


HEX64, HEX40 = re.compile(r"[0-9a-f]{64}"), re.compile(r"[0-9a-f]{40}")


def audited_corpus(raw: dict[str, Any]) -> dict[str, Any]:
    """The record of an audited corpus: its version, and of each document the file names and hashes; malformed ones are refused."""
    bad = [k for k in ("corpus_version",) if not HEX64.fullmatch(str(raw.get(k)))]
    documents = raw.get("documents")
    if not isinstance(documents, dict):
        raise ConfigError("the audited corpus lists no documents")
    for doc_id, entry in documents.items():
        fine = isinstance(entry, dict) and re.fullmatch(r"[A-Za-z0-9_-]+", str(doc_id)) and re.fullmatch(r"[A-Za-z0-9_.-]+\.pdf", str(entry.get("pdf_filename")))
        if not fine or not all(HEX64.fullmatch(str(entry.get(k))) for k in ("pdf_sha256", "md_sha256")):
            bad.append(str(doc_id))
    if bad:
        raise ConfigError(f"malformed in the audited corpus: {bad}")
    return raw


def source_issues(files: dict[str, str | Path], audited: dict[str, str]) -> tuple[list[str], list[str]]:
    """(missing, changed): audited sources without a file, and those whose hash differs."""
    missing = [n for n in audited if n not in files or not Path(files[n]).exists()]
    return missing, [n for n in audited if n not in missing and sha256_file(files[n]) != audited[n]]


def require_sources(folder: str | Path, raw: dict[str, Any], kind: str) -> None:
    """Fails unless `folder` has all audited files of a kind, pdf or markdown, unchanged."""
    documents = audited_corpus(raw)["documents"]
    name = lambda d, e: e["pdf_filename"] if kind == "pdf" else f"{d}.md"
    missing, changed = source_issues({d: Path(folder) / name(d, e) for d, e in documents.items()}, {d: e["pdf_sha256" if kind == "pdf" else "md_sha256"] for d, e in documents.items()})
    if missing or changed:
        raise IncompatibleArtifactError(f"{kind} sources missing: {missing}, changed: {changed}")


def pinned_revisions(models: dict[str, Any], expected: dict[str, str]) -> dict[str, str]:
    """Revisions by checkpoint. `models` has exactly the `expected` names, each with its checkpoint and a full lower-case commit hash."""
    wrong = set(models) ^ set(expected)
    wrong |= {n for n in set(models) & set(expected) if models[n].get("checkpoint") != expected[n] or not HEX40.fullmatch(str(models[n].get("revision")))}
    if wrong:
        raise IncompatibleArtifactError(f"revisions that aren't pinned as expected: {sorted(wrong)}")
    return {models[n]["checkpoint"]: models[n]["revision"] for n in expected}


def local_checkpoint(cache_dir: str | Path, checkpoint: str, pins: dict[str, str]) -> Path:
    """The folder of a checkpoint's pinned snapshot; nothing is downloaded."""
    record = Path(cache_dir) / "revisions.json"
    known = json.loads(record.read_text(encoding="utf-8")).get("revisions", {}) if record.exists() else {}
    require_same(known.get(checkpoint), pins.get(checkpoint), f"revision of {checkpoint}")
    snapshot = Path(cache_dir) / ("models--" + checkpoint.replace("/", "--")) / "snapshots" / str(pins.get(checkpoint))
    if not snapshot.is_dir():
        raise MissingArtifactError(f"{snapshot} does not exist")
    return snapshot
