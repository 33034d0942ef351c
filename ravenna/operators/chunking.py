"""Blocks to overlapping token windows, with stable ids, limits of a binding tokenizer, and the corpus's identity."""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ravenna.errors import ConfigError
from ravenna.functions.text import is_blank, reference_tiles, stripped, token_count
from ravenna.session import ship_package

TARGET, OVERLAP = 350, 50


def with_windows(rows: DataFrame, text_col: str = "text", target: int = TARGET, overlap: int = OVERLAP) -> DataFrame:
    """`rows` with `pieces`: the text's windows (piece, tokens) of `target` tokens, each `target - overlap` after the one before.

    The last window reaches the end. A text of at most `target` tokens is one window, unchanged; without tokens there is none.
    Windows are cut from the original characters, from their first token to their last, so their tokens need no other count.
    The texts are tokenised once, in a column that is used more than once, which the optimizer therefore leaves in a step of its own.
    """
    if not 0 <= overlap < target:
        raise ConfigError("the overlap must be less than the target")
    step = target - overlap
    tiles = F.col("__tiles")
    n = F.size(tiles)
    last = F.greatest(F.ceil((n - F.lit(target)) / F.lit(step)), F.lit(0)).cast("int")
    piece = lambda text, tokens: F.struct(text.alias("piece"), tokens.cast("int").alias("tokens"))
    cut = F.transform(F.sequence(F.lit(0), last), lambda i: piece(stripped(F.array_join(F.slice(tiles, i * step + 1, target), "")), F.least(F.lit(target), n - i * step)))
    none = F.expr("cast(array() as array<struct<piece: string, tokens: int>>)")
    tiled = rows.withColumn("__tiles", reference_tiles(F.col(text_col)))
    return tiled.withColumn("pieces", F.when(n == 0, none).when(n <= target, F.array(piece(F.col(text_col), n))).otherwise(cut)).drop("__tiles")


def chunk_blocks(blocks: DataFrame, target: int = TARGET, overlap: int = OVERLAP) -> DataFrame:
    """Chunks of `blocks` (doc_id, block_id, page, section, modality, text, source_block_hash).

    Blank pieces are dropped but keep their number, so ids may have gaps. Ids widen beyond three digits.
    """
    return _chunks(with_windows(blocks, "text", target, overlap))


def _chunks(pieces: DataFrame) -> DataFrame:
    # The outer form, as the optimizer derives filters of the inner one that would tokenise the texts again; rows without pieces go as blank.
    rows = pieces.select("doc_id", "block_id", "page", "section", "modality", "source_block_hash", F.posexplode_outer("pieces").alias("place", "p"))
    rows = rows.select("*", "p.piece", "p.tokens").where(~is_blank(F.col("piece")))
    return rows.select(
        F.format_string("%s-c%03d", "block_id", "place").alias("chunk_id"),
        "doc_id",
        "block_id",
        "page",
        "section",
        F.when(F.col("modality").isin("text", "table"), F.col("modality")).otherwise("text").alias("modality"),
        F.col("piece").alias("text"),
        F.col("tokens").alias("token_count_ref"),
        F.length("piece").alias("char_count"),
        "source_block_hash",
    )


@dataclass(frozen=True)
class Limit:
    """A model's input limit in its own tokens: `offsets(text)` gives the (start, end) of each, `template` surrounds a document.

    `special` tokens are added by the model itself.
    """

    name: str
    limit: int | None
    offsets: object
    template: str = "{text}"
    special: int = 0

    def count(self, text: str) -> int:
        return self.special + len(self.offsets(self.template.replace("{text}", text)))


class FileTokenizer:
    """Offsets of a text's tokens by a tokenizer file of the tokenizers library, opened where it is used."""

    def __init__(self, path: str):
        self.path, self._opened = path, None

    def __getstate__(self):
        return {"path": self.path, "_opened": None}

    def opened(self):
        if self._opened is None:
            from tokenizers import Tokenizer

            self._opened = Tokenizer.from_file(self.path)
            self._opened.no_truncation()
            self._opened.no_padding()
        return self._opened

    def special(self) -> int:
        return self.opened().num_special_tokens_to_add(False)

    def __call__(self, text: str) -> list[tuple[int, int]]:
        return self.opened().encode(text, add_special_tokens=False).offsets


def binding(limits: list[Limit]) -> Limit | None:
    """The model with the least known limit, the first of equals."""
    known = [m for m in limits if m.limit is not None]
    return min(known, key=lambda m: m.limit) if known else None


def split_to_limit(text: str, model: Limit, overlap: int) -> list[str]:
    """`text` cut at the model's tokens into pieces that fit its limit together with the template."""
    room = max(1, model.limit - model.count(""))
    spans = model.offsets(text)
    if len(spans) <= room:
        return [text]
    pieces, start = [], 0
    while True:
        end = min(start + room, len(spans))
        pieces.append(text[spans[start][0] : spans[end - 1][1]])
        if end == len(spans):
            return [p for p in pieces if p.strip()]
        start = max(start + 1, end - overlap)


def _fitted(blocks: DataFrame, model: Limit, target: int, overlap: int) -> DataFrame:
    """`blocks` with `pieces` and `anew`: whether the block had a piece over the limit, and so was split by the model's tokens."""
    ship_package(blocks.sparkSession)

    @F.pandas_udf("array<string>")
    def refit(texts: pd.Series, pieces: pd.Series) -> pd.Series:
        return pd.Series([split_to_limit(t, model, overlap) if any(model.count(x) > model.limit for x in p) else None for t, p in zip(texts, pieces, strict=True)], dtype=object)

    pieces = with_windows(blocks, "text", target, overlap)
    again = pieces.withColumn("__anew", refit(F.col("text"), F.transform("pieces", lambda p: p["piece"])))
    counted = F.transform("__anew", lambda t: F.struct(t.alias("piece"), token_count(t).alias("tokens")))
    return again.select(*blocks.columns, F.coalesce(counted, "pieces").alias("pieces"), F.col("__anew").isNotNull().alias("anew"))


def fit_to_limit(blocks: DataFrame, limits: list[Limit], target: int = TARGET, overlap: int = OVERLAP) -> DataFrame:
    """chunk_blocks, but a block with any piece over the binding limit is split anew, once and as a whole, by the binding model's tokens."""
    model = binding(limits)
    return chunk_blocks(blocks, target, overlap) if model is None else _chunks(_fitted(blocks, model, target, overlap))


def subdivided_blocks(blocks: DataFrame, limits: list[Limit], target: int = TARGET, overlap: int = OVERLAP) -> DataFrame:
    """(doc_id, block_id) of the blocks that fit_to_limit splits anew."""
    model = binding(limits)
    if model is None:
        return blocks.select("doc_id", "block_id").limit(0)
    return _fitted(blocks, model, target, overlap).where("anew").select("doc_id", "block_id")


def overflow(chunks: DataFrame, limits: list[Limit]) -> DataFrame:
    """(model, limit, chunk_id, tokens) of the chunks that still exceed a model's limit."""
    ship_package(chunks.sparkSession)
    out = chunks.sparkSession.createDataFrame([], "model string, limit int, chunk_id string, tokens int")
    for model in (m for m in limits if m.limit is not None):
        count = F.pandas_udf(lambda texts, m=model: texts.map(m.count), "int")
        rows = chunks.select(F.lit(model.name).alias("model"), F.lit(model.limit).alias("limit"), "chunk_id", count("text").alias("tokens"))
        out = out.unionByName(rows.where(F.col("tokens") > model.limit))
    return out


def overflow_summary(over: DataFrame, limits: DataFrame) -> DataFrame:
    """(model, limit, limit_known, overflow_chunks) for each of `limits` (model, limit)."""
    counts = over.groupBy("model").agg(F.count("*").alias("n"))
    return limits.join(counts, "model", "left").select("model", "limit", F.col("limit").isNotNull().alias("limit_known"), F.coalesce("n", F.lit(0)).alias("overflow_chunks"))


def merged_reports(reports: DataFrame) -> DataFrame:
    """(model, limit, limit_known, overflow_chunks): summaries of several corpora or documents in one, their counts added up."""
    first = lambda c: F.first(c, ignorenulls=True).alias(c)
    return reports.groupBy("model").agg(first("limit"), first("limit_known"), F.sum("overflow_chunks").alias("overflow_chunks"))


def corpus_version(chunks: DataFrame) -> DataFrame:
    """One row (corpus_version): the SHA-256 of the compact JSON list of {chunk_id, doc_id, text}, sorted by chunk id.

    A hash of one sequence is one task's work; that task sorts on disk and reads the rows as a stream, so it holds a batch of them at a
    time. corpus_digest is the distributed identity, by which corpora are verified.
    """
    ship_package(chunks.sparkSession)
    rows = chunks.select("chunk_id", F.to_json(F.struct("chunk_id", "doc_id", "text")).alias("json")).repartition(1).sortWithinPartitions("chunk_id", "json")

    def digest(batches):
        state, between = hashlib.sha256(b"["), b""
        for batch in batches:
            for entry in batch.column("json").to_pylist():
                state.update(between + entry.encode())
                between = b","
        state.update(b"]")
        yield pa.RecordBatch.from_pydict({"corpus_version": [state.hexdigest()]})

    return rows.select("json").mapInArrow(digest, "corpus_version string")


def corpus_digest(chunks: DataFrame, bits: int = 12) -> DataFrame:
    """One row (corpus_digest): a hash of the hashes of 2**bits groups of chunks, so no task holds more than a group's ids and hashes."""
    row = chunks.select(F.col("chunk_id").cast("string").alias("chunk_id"), F.sha2(F.to_json(F.struct("chunk_id", "doc_id", "text")), 256).alias("h"))
    return _digest(row, bits).withColumnRenamed("digest", "corpus_digest")


def documents_digest(chunks: DataFrame, bits: int = 12) -> DataFrame:
    """One row (n_docs, digest) of the distinct doc_ids."""
    docs = chunks.select(F.col("doc_id").cast("string").alias("chunk_id")).distinct()
    return docs.agg(F.count("*").alias("n_docs")).crossJoin(_digest(docs.withColumn("h", F.sha2("chunk_id", 256)), bits))  # one row each


def _digest(row: DataFrame, bits: int) -> DataFrame:
    """One row (digest) of (chunk_id, h), the same whatever the rows' order."""
    groups = row.groupBy(F.pmod(F.xxhash64("chunk_id"), F.lit(1 << bits)).alias("g")).agg(F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("chunk_id", "h"))), lambda e: e["h"]), ""), 256).alias("h"))
    return groups.agg(F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("g", "h"))), lambda e: e["h"]), ""), 256).alias("digest"))
