"""Models behind injectable interfaces: encoders, rerankers and generators run in Arrow batches, loaded once for each task.

No model is part of this package. What is passed in is a factory, so that a model is made where it runs and leaves with its task.
"""

from __future__ import annotations

import json
import time
import urllib.request
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from typing import Any, Protocol

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ravenna.functions.text import filled, sha256
from ravenna.session import exists, ship_package

#: The pair format of the reranking model.
PAIR_PREFIX = '<|im_start|>system\nJudge whether the Document meets the requirements based on the Query and the Instruct provided. Note that the answer can only be "yes" or "no".<|im_end|>\n<|im_start|>user\n'
PAIR_SUFFIX = "<|im_end|>\n<|im_start|>assistant\n<think>\n\n</think>\n\n"


class Encoder(Protocol):
    limit: int | None

    def count(self, text: str) -> int: ...
    def encode(self, texts: list[str]) -> np.ndarray: ...


class PairScorer(Protocol):
    limit: int | None

    def count(self, text: str) -> int: ...
    def score(self, pairs: list[str]) -> list[float]: ...


def templated(template: str, text: Column, task: str = "") -> Column:
    """A query's or a document's text in its model's template, which has {task} and {query} or {text}."""
    return filled(template.replace("{task}", task), query=text, text=text)


def pair_text(query: Column, text: Column, task: str) -> Column:
    return F.concat(F.lit(f"{PAIR_PREFIX}<Instruct>: {task}\n<Query>: "), query, F.lit("\n<Document>: "), text, F.lit(PAIR_SUFFIX))


def pooled(states: np.ndarray, mask: np.ndarray, how: str) -> np.ndarray:
    """(texts, width) of a model's states (texts, positions, width): their mean over the positions that the mask keeps, or the last such position's.

    Padding may stand on either side. A text without positions is all zeros.
    """
    keep = np.asarray(mask, bool)
    if how == "mean":
        return np.where(keep[:, :, None], states, 0).sum(1) / np.maximum(keep.sum(1), 1)[:, None]
    if how != "last_token":
        raise ValueError(f"no pooling {how!r}")
    last = keep.shape[1] - 1 - keep[:, ::-1].argmax(1)
    return np.where(keep.any(1)[:, None], states[np.arange(len(states)), last], 0)


def usable_dtype(wanted: str, device: str, bf16: bool = False) -> str:
    """The precision that a device gives: halves need a GPU, bf16 also its support there; otherwise full precision, never fewer digits than asked."""
    if device not in ("cuda", "cpu"):
        raise ValueError(f"no device {device!r}")
    given = {"fp16": device == "cuda", "bf16": device == "cpu" or bf16}
    return wanted if given.get(wanted, False) else "fp32"


@contextmanager
def loaded(make: Callable[[], Any]) -> Iterator[Any]:
    """A model for the time of a task; one with a close() is closed at its end, whatever happens."""
    model = make()
    try:
        yield model
    finally:
        if close := getattr(model, "close", None):
            close()


def _fitting(model: Any, texts: list[str]) -> list[str]:
    if model.limit is not None:
        for t in texts:
            if (n := model.count(t)) > model.limit:
                raise ValueError(f"a text has {n} tokens; the model takes {model.limit}, and nothing is cut silently")
    return texts


def encoded(rows: DataFrame, make: Callable[[], Encoder], id_col: str = "chunk_id", text_col: str = "text", batch: int = 8) -> DataFrame:
    """(id, vector): unit vectors of the texts, `batch` at a time. A text over the model's limit fails the job."""
    ship_package(rows.sparkSession)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        with loaded(make) as model:
            for frame in frames:
                texts = _fitting(model, frame[text_col].fillna("").tolist())
                parts = [np.asarray(model.encode(texts[k : k + batch]), np.float32) for k in range(0, len(texts), batch)]
                if parts:
                    x = np.concatenate(parts)
                    x = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
                    yield pd.DataFrame({id_col: frame[id_col].tolist(), "vector": list(x)})

    kind = rows.schema[id_col].dataType.simpleString()
    return rows.select(id_col, text_col).mapInPandas(run, f"{id_col} {kind}, vector array<float>")


def cached_vectors(queries: DataFrame, embedding: str, make: Callable[[], Encoder], template: Column, path: str, batch: int = 8) -> DataFrame:
    """(question_id, vector) of `queries` (question_id, text): only those are encoded whose (embedding, id, text) isn't under `path` yet.

    New vectors are appended there, so a query is encoded once whatever the configurations and runs that ask for it. `template`
    is the text that the model gets.
    """
    spark = queries.sparkSession
    asked = queries.select("question_id", sha256(F.col("text")).alias("text_hash"), template.alias("text"))
    stored = lambda: spark.read.schema("embedding string, question_id string, text_hash string, vector array<float>").parquet(path).where(F.col("embedding") == embedding)
    new = asked.join(stored(), ["question_id", "text_hash"], "left_anti") if exists(spark, path) else asked
    rows = encoded(new.select(F.struct("question_id", "text_hash").alias("k"), "text"), make, "k", "text", batch)
    rows.select(F.lit(embedding).alias("embedding"), F.col("k.question_id").cast("string").alias("question_id"), "k.text_hash", "vector").write.mode("append").parquet(path)
    return asked.join(stored().dropDuplicates(["question_id", "text_hash"]).drop("embedding"), ["question_id", "text_hash"]).select("question_id", "vector")


def pair_scorer(make: Callable[[], PairScorer], task: str, batch: int = 8) -> Callable[[Column, Column], Column]:
    """A score function for ravenna.operators.fusion.rerank around a model."""

    @F.pandas_udf("double")
    def scored(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        with loaded(make) as model:
            for texts in batches:
                pairs = _fitting(model, texts.tolist())
                yield pd.Series([s for k in range(0, len(pairs), batch) for s in model.score(pairs[k : k + batch])], dtype=float)

    return lambda query, text: scored(pair_text(query, text, task))


def yes_probability(yes: np.ndarray, no: np.ndarray) -> np.ndarray:
    """The softmax over the two answers' logits."""
    return 1 / (1 + np.exp(np.asarray(no, float) - np.asarray(yes, float)))


GENERATED = "question_id string, config_id string, model string, response string, prompt_sent string, latency_s double, error string"


def generated(prompts: DataFrame, make: Callable[[], Callable[[str], dict[str, Any]]]) -> DataFrame:
    """The answers to (question_id, config_id, prompt): what fails is a row with its error, not a failed job."""
    ship_package(prompts.sparkSession)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ask = make()
        for frame in frames:
            rows = []
            for q, c, prompt in zip(frame["question_id"], frame["config_id"], frame["prompt"], strict=True):
                began, said, error = time.perf_counter(), {}, None
                try:
                    said = ask(prompt)
                except Exception as e:  # whatever the service or the network makes of it
                    error = str(e)
                rows.append((q, c, said.get("model"), said.get("response", ""), prompt, time.perf_counter() - began, error))
            yield pd.DataFrame(rows, columns=["question_id", "config_id", "model", "response", "prompt_sent", "latency_s", "error"])

    return prompts.select("question_id", "config_id", "prompt").mapInPandas(run, GENERATED)


def http_generator(host: str, model: str, temperature: float = 0.0, seed: int | None = None, num_ctx: int = 8192, reasoning: bool = False, timeout: float = 600) -> Callable[[], Callable[[str], dict[str, Any]]]:
    """A factory of a client for a local generation service."""

    def make() -> Callable[[str], dict[str, Any]]:
        def ask(prompt: str) -> dict[str, Any]:
            body: dict[str, Any] = {"model": model, "prompt": prompt, "stream": False, "temperature": temperature, "options": {"num_ctx": num_ctx}}
            if seed is not None:
                body["seed"] = seed
            if reasoning:
                body["think"] = True
            request = urllib.request.Request(f"{host.rstrip('/')}/api/generate", json.dumps(body).encode(), {"Content-Type": "application/json"})
            with urllib.request.urlopen(request, timeout=timeout) as answer:
                return {"model": model} | json.load(answer)

        return ask

    return make
