"""Scans of the file formats: YAML and JSON on the driver where they are small, JSON lines, Markdown and binary files by Spark."""

from __future__ import annotations

import json
import os
from collections.abc import Callable, Iterator
from pathlib import Path
from typing import Any

import pandas as pd
import yaml
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ravenna import schemas
from ravenna.errors import ConfigError, FrozenCorpusError, MissingArtifactError
from ravenna.functions.text import is_blank
from ravenna.operators.chunking import corpus_digest, documents_digest
from ravenna.session import ship_package

LISTS = {"articles": "articles", "questions": "questions", "qrels": "qrels", "evidence_groups": "evidence_groups"}


def read_yaml(path: str | Path) -> dict[str, Any]:
    """A mapping; an empty file is an empty one."""
    return yaml.safe_load(Path(path).read_text(encoding="utf-8")) or {}


def read_json(path: str | Path) -> Any:
    return json.loads(Path(path).read_text(encoding="utf-8"))


def read_annotations(spark: SparkSession, path: str | Path, table: str) -> DataFrame:
    """A typed list from a YAML file of people's annotations, with defaults; rows that break a constraint fail when they are read.

    A missing file and unknown columns are errors at once.
    """
    if not Path(path).exists():
        raise ConfigError(f"{table}: {path} does not exist")
    items = read_yaml(path).get(LISTS[table]) or []
    fields = schemas.schema(table)
    for i, item in enumerate(items):
        if extra := set(item) - set(fields.names):
            raise ConfigError(f"{table} item {i} has unknown fields {sorted(extra)}")
    rows = spark.createDataFrame([tuple(_shaped(item.get(f.name), f.dataType) for f in fields) for item in items], fields)
    return schemas.require_valid(schemas.with_defaults(rows, table), table)


def _shaped(value: Any, kind: Any) -> Any:
    """A YAML value in the shape of a Spark type: structs take their fields by name, empty ones their defaults."""
    name = kind.typeName()
    if name == "array" and isinstance(value, list):
        return [_shaped(x, kind.elementType) for x in value]
    if name == "struct" and isinstance(value, dict):
        return tuple(_shaped(value.get(f.name, {"quote": "", "chunk_ids": []}.get(f.name)), f.dataType) for f in kind)
    return value


def read_json_lines(spark: SparkSession, path: str, table: str | None = None) -> DataFrame:
    """JSON lines; with a table name in its schema, and malformed lines fail. Blank lines are skipped."""
    reader = spark.read.option("mode", "FAILFAST")
    return (reader.schema(schemas.schema(table)) if table else reader).json(path)


def read_chunks(spark: SparkSession, path: str) -> DataFrame:
    """Chunks from Parquet (a folder or a .parquet file) or JSON lines; broken rows fail when they are read, columns of other names are left out."""
    raw = spark.read.parquet(path) if not path.endswith((".json", ".jsonl")) else read_json_lines(spark, path, "chunks")
    known = schemas.schema("chunks").names
    return schemas.require_valid(schemas.with_defaults(raw.select(*(c for c in raw.columns if c in known)), "chunks"), "chunks")


def frozen_identity(chunks: DataFrame) -> dict[str, Any]:
    """What a manifest says of its chunks: their number, a digest of all, the number of documents and a digest of their ids.

    Only these figures reach the driver, whatever the corpus's size.
    """
    docs = documents_digest(chunks).first()
    return {"chunk_count": chunks.count(), "corpus_version": corpus_digest(chunks).first()[0], "document_count": docs["n_docs"], "documents_digest": docs["digest"]}


def frozen_corpus_problems(chunks: DataFrame, manifest: dict[str, Any]) -> list[str]:
    """How `chunks` differ from their manifest: freeze, count, version, documents, repeated ids, blank texts."""
    found = [] if manifest.get("frozen") else ["the manifest is not frozen"]
    seen = chunks.agg(F.count("*").alias("n"), F.count_distinct("chunk_id").alias("ids"), F.sum(is_blank(F.col("text")).cast("int")).alias("blank")).first()
    own = frozen_identity(chunks)
    checks = [
        ("count", seen["n"], manifest.get("chunk_count")),
        ("repeated ids", seen["ids"], seen["n"]),
        ("blank texts", seen["blank"] or 0, 0),
        ("version", own["corpus_version"], manifest.get("corpus_version")),
        ("documents", (own["document_count"], own["documents_digest"]), (manifest.get("document_count"), manifest.get("documents_digest"))),
    ]
    return found + [what for what, got, want in checks if got != want]


def read_frozen_corpus(spark: SparkSession, chunks_path: str, manifest_path: str) -> DataFrame:
    chunks = read_chunks(spark, chunks_path)
    if problems := frozen_corpus_problems(chunks, read_json(manifest_path)):
        raise FrozenCorpusError("the corpus differs from its manifest: " + ", ".join(problems))
    return chunks


def read_markdown(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, text): whole Markdown files, named by their file names."""
    name = F.regexp_extract(F.col("_metadata.file_name"), r"^(.*?)(?:\.[^.]*)?$", 1)
    return spark.read.text(path, wholetext=True).select(name.alias("doc_id"), F.col("value").alias("text"))


BOX = "struct<x0: double, top: double, x1: double, bottom: double>"
PAGE = f"struct<page_number: int, text: string, word_count: int, has_text_layer: boolean, words: array<struct<text: string, x0: double, x1: double, top: double, bottom: double>>, tables: array<struct<table_id: string, bbox: {BOX}, rows: array<array<string>>, caption: string>>>"
PDF_SCHEMA = f"doc_id string, pdf_filename string, pdf_sha256 string, pages array<{PAGE}>, metadata map<string, string>, warnings array<string>, review_items array<string>"


def _page(doc_id: str, page: dict[str, Any]) -> dict[str, Any]:
    """A parser's page in the shape of PAGE; its tables are numbered."""
    words = [{"text": w["text"], **{c: float(w[c]) for c in ("x0", "x1", "top", "bottom")}} for w in page.get("words") or []]
    number, text, tables = int(page["page_number"]), page.get("text") or "", []
    for k, t in enumerate(page.get("tables") or [], 1):
        box = dict(zip(("x0", "top", "x1", "bottom"), map(float, t["bbox"]), strict=True)) if t.get("bbox") else None
        tables.append({"table_id": t.get("table_id") or f"{doc_id}:t{number}-{k}", "bbox": box, "rows": [["" if c is None else str(c) for c in r] for r in t.get("rows") or []], "caption": t.get("caption")})
    count = page.get("word_count", len(words))
    return {"page_number": number, "text": text, "word_count": count, "has_text_layer": page.get("has_text_layer", bool(text.strip()) or count > 0), "words": words, "tables": tables}


def read_pdfs(spark: SparkSession, path: str, parser: Callable[[bytes], list[dict[str, Any]]] | None = None, metadata: Callable[[bytes], dict[str, Any]] | None = None) -> DataFrame:
    """(PDF_SCHEMA) of the PDFs under `path`, read by a site's `parser`: bytes to pages with their text, positioned words and tables.

    A file that it can't read is a warning, not a failure, and keeps the pages that came before; what `metadata` can't read is just missing.
    """
    if parser is None:
        raise MissingArtifactError("no PDF library is installed; pass a parser")
    ship_package(spark)
    named = F.regexp_extract(F.col("path"), r"([^/]*)$", 1)
    rows = spark.read.format("binaryFile").load(path).select(F.regexp_replace(named, r"\.[^.]*$", "").alias("doc_id"), named.alias("pdf_filename"), F.sha2("content", 256).alias("pdf_sha256"), "content")

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.itertuples():
                warnings, review, pages, said = [], [], [], {}
                try:
                    for page in parser(row.content):
                        pages.append(_page(row.doc_id, page))
                except Exception as e:  # whatever a foreign file makes of a foreign library
                    warnings.append(f"the PDF can't be read: {e}")
                try:
                    said = {str(k): str(v) for k, v in (metadata(row.content) if metadata else {}).items() if v is not None}
                except Exception:  # metadata are a courtesy
                    said = {}
                review += [f"page {p['page_number']}: no text layer" for p in pages if not p["has_text_layer"]]
                if not sum(len(p["text"]) for p in pages):
                    review.append("no text was extracted")
                yield pd.DataFrame([{"doc_id": row.doc_id, "pdf_filename": row.pdf_filename, "pdf_sha256": row.pdf_sha256, "pages": pages, "metadata": said, "warnings": warnings, "review_items": review}])

    return rows.mapInPandas(parse, PDF_SCHEMA)


def read_rankings(spark: SparkSession, path: str) -> DataFrame:
    """Long-form rankings as write_rankings leaves them."""
    return spark.read.schema(schemas.schema("rankings")).parquet(path)


def latest_run(results: str | Path) -> str | None:
    """The greatest folder name that starts with run-."""
    root = Path(results)
    return max((p.name for p in root.iterdir() if p.is_dir() and p.name.startswith("run-")), default=None) if root.exists() else None


def checkpoint_inventory(folder: str | Path) -> dict[str, bool]:
    """Whether a model folder has its configuration, its tokenizer and weights, none of them empty."""
    root = Path(folder)
    files = {p.name: p.stat().st_size for p in root.rglob("*") if p.is_file()} if root.exists() else {}
    weights = [n for n in files if n.endswith((".safetensors", ".bin"))]
    got = {"config": files.get("config.json", 0) > 0, "tokenizer": any(files.get(n, 0) > 0 for n in ("tokenizer.json", "tokenizer.model", "vocab.txt")), "weights": bool(weights) and all(files[n] for n in weights)}
    return got | {"available": all(got.values())}


def project_root() -> Path:
    return Path(os.environ.get("RAVENNA_ROOT") or Path.cwd())


