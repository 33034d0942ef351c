"""Sinks: tables as Parquet, JSON lines and CSV by Spark; small records as JSON, YAML and text by the driver."""

from __future__ import annotations

import json
import os
import uuid
from collections.abc import Callable
from pathlib import Path
from typing import Any

import yaml
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ravenna.artifacts import require_same
from ravenna.errors import FrozenCorpusError, IncompatibleArtifactError, MissingArtifactError
from ravenna.operators.dense import vector_problems
from ravenna.operators.lexical import LexicalIndex, build_index, index_differences


def write_text(path: str | Path, text: str) -> None:
    Path(path).parent.mkdir(parents=True, exist_ok=True)
    Path(path).write_text(text, encoding="utf-8")


def write_json(path: str | Path, value: Any) -> None:
    write_text(path, json.dumps(value, ensure_ascii=False, indent=2, default=str) + "\n")


def write_yaml(path: str | Path, value: Any) -> None:
    write_text(path, yaml.safe_dump(value, allow_unicode=True, sort_keys=False))


def write_json_lines(df: DataFrame, path: str) -> None:
    df.write.option("ignoreNullFields", False).json(path)


def write_table(df: DataFrame, path: str, form: str = "parquet") -> None:
    """A run's table; an evaluation that is repeated replaces it."""
    df.write.mode("overwrite").format(form).save(path)


def require_unfrozen(manifest_path: str | Path) -> None:
    if Path(manifest_path).exists() and json.loads(Path(manifest_path).read_text(encoding="utf-8")).get("frozen"):
        raise FrozenCorpusError(f"{manifest_path} is frozen")


def write_frozen_chunks(chunks: DataFrame, path: str, manifest: dict[str, Any], manifest_path: str | Path) -> None:
    """Chunks and their manifest; a frozen corpus is never overwritten."""
    require_unfrozen(manifest_path)
    chunks.write.mode("errorifexists").parquet(path)
    write_json(manifest_path, manifest)


INDEX_TABLES = ("postings", "lengths", "terms", "stats")


def write_lexical_index(index: LexicalIndex, path: str, record: dict[str, Any] | None = None) -> None:
    """The index's tables, postings sorted by term within their files so that a few terms' scan skips most; a record beside them."""
    for name in INDEX_TABLES:
        df = getattr(index, name)
        (df.repartition("term").sortWithinPartitions("term") if name == "postings" else df).write.mode("overwrite").parquet(f"{path}/{name}")
    if record is not None:
        write_json(f"{path}/index.json", record)


def read_lexical_index(spark, path: str, expected: dict[str, Any] | None = None) -> LexicalIndex:
    """A stored index; with `expected` it is refused unless its record says so."""
    if expected is not None:
        record = Path(path) / "index.json"
        if not record.exists():
            raise MissingArtifactError(f"{path} has no lexical index")
        stored = json.loads(record.read_text(encoding="utf-8"))
        for k, v in expected.items():
            require_same(stored.get(k), v, f"{k} of {path}")
    return LexicalIndex(*(spark.read.parquet(f"{path}/{name}") for name in INDEX_TABLES))


def verified_lexical_index(spark, path: str, chunks: DataFrame, expected: dict[str, Any], **how: bool) -> LexicalIndex:
    """read_lexical_index, refused too unless every row agrees with an index that is built anew from `chunks`."""
    stored = read_lexical_index(spark, path, expected)
    if not index_differences(stored, build_index(chunks, **how)).isEmpty():
        raise IncompatibleArtifactError(f"{path} doesn't agree with its chunks")
    return stored


def write_vectors(vectors: DataFrame, path: str, record: dict[str, Any]) -> None:
    """A dense index: (chunk_id, vector), and beside it the record that says what it was made from and of."""
    vectors.select("chunk_id", "vector").write.mode("overwrite").parquet(f"{path}/vectors")
    write_json(f"{path}/index.json", record)


def read_vectors(spark, path: str, chunks: DataFrame, expected: dict[str, Any]) -> DataFrame:
    """A dense index's vectors, refused unless its record is the expected one and it has a sound vector for each chunk, and no other."""
    record = Path(path) / "index.json"
    if not record.exists():
        raise MissingArtifactError(f"{path} has no dense index")
    stored = json.loads(record.read_text(encoding="utf-8"))
    for k, v in expected.items():
        require_same(stored.get(k), v, f"{k} of {path}")
    vectors = spark.read.parquet(f"{path}/vectors")
    if not vector_problems(vectors, expected["dimension"]).isEmpty():
        raise IncompatibleArtifactError(f"{path} has unsound vectors")
    ids, known = vectors.select("chunk_id"), chunks.select("chunk_id")
    if not ids.join(known, "chunk_id", "left_anti").isEmpty() or not known.join(ids, "chunk_id", "left_anti").isEmpty():
        raise IncompatibleArtifactError(f"{path} has vectors of other chunks")
    return vectors


def write_extracted(extracted: DataFrame, folder: str | Path) -> list[str]:
    """Markdown and provenance files of (doc_id, text, provenance), one document at a time on the driver; their ids."""
    ids = []
    for r in extracted.select("doc_id", "text", F.to_json("provenance").alias("provenance")).toLocalIterator():
        write_text(Path(folder) / f"{r['doc_id']}.md", r["text"])
        write_json(Path(folder) / f"{r['doc_id']}.provenance.json", json.loads(r["provenance"]))
        ids.append(r["doc_id"])
    return ids


def write_rankings(rankings: DataFrame, path: str) -> None:
    """Rankings in one folder for each configuration, so one configuration's scan prunes the others."""
    rankings.write.mode("overwrite").partitionBy("config_id").parquet(path)


def write_sheet(sheet: DataFrame, key: DataFrame, path: str, key_path: str | Path) -> None:
    """The blind sheet as CSV in the order of its ids, and the key apart from it as JSON."""
    sheet.orderBy("blind_id").coalesce(1).write.mode("overwrite").option("header", True).option("escape", '"').csv(path)
    write_json(key_path, {r["blind_id"]: {"question_id": r["question_id"], "config_id": r["config_id"]} for r in key.orderBy("blind_id").collect()})


def replace_if_unchanged(path: str | Path, seen: bytes, change: Callable[[dict[str, Any]], dict[str, Any]]) -> None:
    """Rewrite a YAML file by an atomic rename, unless it is no longer what was `seen`."""
    path = Path(path)
    new = path.with_name(f".{path.name}.{uuid.uuid4().hex}")
    try:
        write_yaml(new, change(yaml.safe_load(seen) or {}))
        if path.read_bytes() != seen:
            raise FrozenCorpusError(f"{path} changed meanwhile")
        os.replace(new, path)
    finally:
        new.unlink(missing_ok=True)


def record_review(path: str | Path, reviews_dir: str | Path, question_id: str, status: str, reviewer: str, comments: str, date: str, seen: bytes) -> Path:
    """Set a question's review status and leave a record of who decided; the record goes again if the file can't be changed."""
    record = {"review_id": f"review-{uuid.uuid4().hex}", "target_type": "question", "target_id": question_id, "status": status, "reviewer": reviewer.strip(), "comments": comments, "date": date}
    left = Path(reviews_dir) / f"{record['review_id']}.yaml"

    def change(raw: dict[str, Any]) -> dict[str, Any]:
        for item in raw.get("questions", []):
            if item.get("question_id") == question_id:
                item["review_status"] = status
        return raw

    write_yaml(left, {"reviews": [record]})
    try:
        replace_if_unchanged(path, seen, change)
    except Exception:
        left.unlink(missing_ok=True)
        raise
    return left
