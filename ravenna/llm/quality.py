"""Quality by nearest-neighbour voting in a latent-semantic space.

Terms are hashed words, three-character patterns of a text's letters, capitals, digits and kinds of punctuation, and marks of
its repetition (how many words, word pairs and lines are repeated, in steps). A truncated SVD of the weighted
term counts of a bounded labelled sample gives the latent space; the sample's unit vectors and labels are broadcast. For every
document the exact cosines with all of them are computed in blocks, and the nearest vote with their similarity. Of equally
near neighbours at the last place all vote, so a score depends on nothing but the text and the sample.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ravenna.llm._arrow import map_slices, texts_of
from ravenna.llm._sample import fold, labelled_sample

#: Bounds of the sample: texts of each class, and bytes of a text.
PER_CLASS, MAX_BYTES = 1500, 1 << 16
DIMENSIONS, NEIGHBOURS = 48, 15
WORDS, SHAPES, STEPS = 4096, 4096, 12
MARKS = ("pairs", "lines", "words", "adjacent", "capitals", "letters", "symbols", "length")
TERMS = WORDS + SHAPES + len(MARKS) * STEPS
#: Texts that are compared at a time.
BLOCK = 128


def _classes() -> np.ndarray:
    kinds = np.zeros(256, np.uint16)
    for k, chars in enumerate(["abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", " \t", "\n\r", ".", ",", "!", "?", "|", "#$%&*@^~+=<>\\", "\"'()[]{}:;/", "-_"], 1):
        kinds[list(chars.encode())] = k
    kinds[128:] = 1
    return kinds


KINDS = _classes()


def terms(text: str) -> np.ndarray:
    """Counts of the hashed words and of the character patterns, and one mark a step for each kind of repetition and share of characters."""
    out = np.zeros(TERMS, np.float32)
    raw = np.frombuffer(text.encode(), np.uint8)
    if not len(raw):
        return out
    kinds = KINDS[raw]
    if len(raw) > 2:
        out[WORDS : WORDS + SHAPES] = np.bincount(kinds[:-2] << 8 | kinds[1:-1] << 4 | kinds[2:], minlength=SHAPES)
    words, lines = text.lower().split(), text.split("\n")
    if words:
        out[:WORDS] = np.bincount([xxhash.xxh3_64_intdigest(w) % WORDS for w in words], minlength=WORDS)
    n = max(1, len(words))
    of_kind = np.bincount(kinds, minlength=16) / len(raw)
    shares = {
        "pairs": 1 - len(set(zip(words, words[1:], strict=False))) / max(1, len(words) - 1) if len(words) > 1 else 0,
        "lines": 1 - len(set(lines)) / len(lines),
        "words": 1 - len(set(words)) / n,
        "adjacent": sum(map(str.__eq__, words, words[1:])) / n,
        "capitals": of_kind[2] / max(1e-9, of_kind[1] + of_kind[2]),
        "letters": of_kind[1] + of_kind[2],
        "symbols": of_kind[8:13].sum() * 2,
        "length": min(1, np.log2(n) / 16),
    }
    for k, name in enumerate(MARKS):
        out[WORDS + SHAPES + k * STEPS + min(STEPS - 1, int(max(0, shares[name]) * STEPS))] = 1
    return out


class LatentVotes:
    """The latent space and its labelled vectors."""

    def __init__(self, counts: np.ndarray, labels: np.ndarray, seed: int = 7):
        """`counts` is overwritten: it is the largest thing that the driver holds."""
        n, x = len(counts), counts
        self.weight = np.log((1 + n) / (1 + np.count_nonzero(x, axis=0))).astype(np.float32) + 0.3
        self.weight[WORDS + SHAPES :] += 2
        self.mean = np.zeros(TERMS, np.float32)
        np.log1p(x, out=x)
        x *= self.weight
        x /= np.maximum(1e-6, np.linalg.norm(x, axis=1, keepdims=True))
        self.mean = x.mean(0)
        x -= self.mean
        rng = np.random.default_rng(seed)
        k = min(DIMENSIONS, n)
        basis = rng.standard_normal((TERMS, k + 8)).astype(np.float32)
        for _ in range(4):  # power iterations of a randomised SVD
            basis = np.linalg.qr(x.T @ (x @ basis))[0]
        _, _, v = np.linalg.svd(x @ basis, full_matrices=False)
        self.axes = np.ascontiguousarray((basis @ v.T)[:, :k], np.float32)
        self.vectors, self.labels = self.unit(x @ self.axes), labels.astype(np.float32)
        share = self.labels.mean()
        self.balance = np.where(self.labels > 0, 0.5 / max(share, 1e-6), 0.5 / max(1 - share, 1e-6)).astype(np.float32)

    def weighted(self, counts: np.ndarray) -> np.ndarray:
        x = np.log1p(counts)
        x *= self.weight
        x /= np.maximum(1e-6, np.linalg.norm(x, axis=1, keepdims=True))
        x -= self.mean
        return x

    @staticmethod
    def unit(x: np.ndarray) -> np.ndarray:
        return (x / np.maximum(1e-9, np.linalg.norm(x, axis=1, keepdims=True))).astype(np.float32)

    def vote(self, counts: np.ndarray) -> np.ndarray:
        """The share of the neighbours' similarity that says 1."""
        cosine = self.unit(self.weighted(counts) @ self.axes) @ self.vectors.T
        k = min(NEIGHBOURS, cosine.shape[1])
        last = np.partition(cosine, -k, axis=1)[:, -k, None]
        force = np.where(cosine >= last, np.maximum(cosine, 1e-3) ** 8 * self.balance, 0)
        return (force * self.labels).sum(1) / force.sum(1)

    def scores(self, texts: list[str]) -> np.ndarray:
        return np.concatenate([np.zeros(0), *(self.vote(np.stack([terms(t) for t in texts[k : k + BLOCK]])) for k in range(0, len(texts), BLOCK))])


def fit_quality(sample: list[tuple[str, int]]) -> LatentVotes | None:
    """None when there is no labelled text."""
    if not sample:
        return None
    counts = np.empty((len(sample), TERMS), np.float32)
    for row, (t, _) in zip(counts, sample, strict=True):
        row[:] = terms(t)
    return LatentVotes(counts, np.array([y for _, y in sample]))


def quality_scores(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS, max_bytes: int = MAX_BYTES) -> DataFrame:
    """`docs` (which has doc_id and text) with `held_out` and `score`: the probability of label 1, from 0 to 1.

    Labels are learnt from at most `per_class` rows of either class with texts of at most `max_bytes`, none of them held out
    (crc32 of the id modulo 3 is 1). Every row is scored by its whole text alone. Null and empty texts are scored as the
    empty text; without labels every score is 0.5. Null ids are not held out. Columns named held_out or score are replaced.
    """
    learn = fold(F.col("doc_id"), 3) != 1
    model = docs.sparkSession.sparkContext.broadcast(fit_quality(labelled_sample(docs, labels, "quality", learn, per_class, max_bytes, [0, 1])))
    rows = docs.drop("held_out", "score").withColumn("held_out", F.coalesce(fold(F.col("doc_id"), 3) == 1, F.lit(False)))

    def make():
        votes = model.value

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            score = votes.scores(texts_of(batch)) if votes else np.full(batch.num_rows, 0.5)
            return pa.RecordBatch.from_arrays([*batch.columns, pa.array(score, pa.float64())], [*batch.schema.names, "score"])

        return step

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema) + ", score double"
    return map_slices(rows, make, schema)
