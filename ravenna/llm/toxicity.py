"""Toxicity by a convolutional text classifier over hashed word embeddings.

A word's embedding is the sum of hashed table rows: two rows, by different bits of a hash, for the word and for each of its
beginnings of a few lengths, so that inflected forms share most of what they mean. Filters of several widths slide over the
words; max pooling keeps each filter's greatest value over the whole document; a logistic layer weighs them together
with the document's length. All weights start at random and are trained in numpy by backpropagation on a bounded labelled
sample; words are left out at random, so that no single one decides. Decision thresholds are calibrated by language on
scores of texts by networks that were not trained on them; a language with few toxic texts leans on the overall threshold.
The language is guessed from the text's bytes, and scores are stretched so that each language's threshold becomes 0.7.
"""

from __future__ import annotations

import json
import uuid

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ravenna.llm._arrow import map_slices, texts_of
from ravenna.llm._sample import fold, labelled_sample

#: Bounds of the sample: texts of each class, and bytes of a text.
PER_CLASS, MAX_BYTES = 1200, 1 << 15
ROWS, WIDE, WIDTHS, FILTERS = 1 << 16, 16, (1, 2, 3), 12
BEGINNINGS = (3, 4, 5, 6, 7, 8)
PARTS = 2 * (1 + len(BEGINNINGS))
EPOCHS, BATCH, RATE, TABLE_RATE, LEFT_OUT = 5, 16, 0.01, 0.02, 0.3
#: Folds of the calibration, and toxic texts of a language at which its own threshold weighs as much as the overall one.
FOLDS, HALF_WEIGHT = 4, 10
#: Words that the filters slide over at a time, and words that a worker remembers.
BLOCK, CACHE_WORDS = 1 << 15, 400_000
DECISION = 0.7
EDGES = ".,;:!?\"'()[]{}<>|*#$%&@^~+=_-/\\"


def split(text: str) -> list[str]:
    return text.lower().split()


def table_rows(words: list[str]) -> np.ndarray:
    """(words, PARTS): the table rows of each word without punctuation at its ends; row 0 stands for nothing."""
    out = np.zeros((len(words), PARTS), np.int32)
    for i, w in enumerate(words):
        w = w.strip(EDGES)
        if w:
            hashes = [xxhash.xxh3_64_intdigest("=" + w), *(xxhash.xxh3_64_intdigest(w[:k]) for k in BEGINNINGS if k <= len(w))]
            out[i, : 2 * len(hashes)] = [1 + (x >> shift) % ROWS for x in hashes for shift in (0, 32)]
    return out


class Network:
    def __init__(self, seed: int = 13):
        rng = np.random.default_rng(seed)
        self.table = (rng.standard_normal((1 + ROWS, WIDE)) * 0.12).astype(np.float32)
        self.table[0] = 0
        self.filters = [(rng.standard_normal((w * WIDE, FILTERS)) / np.sqrt(w * WIDE)).astype(np.float32) for w in WIDTHS]
        self.shift = [np.zeros(FILTERS, np.float32) for _ in WIDTHS]
        self.last = (rng.standard_normal(FILTERS * len(WIDTHS)) * 0.2).astype(np.float32)
        self.by_length = np.zeros(2, np.float32)  # of the logarithm of the length, and the constant

    def weights(self) -> list[np.ndarray]:
        return [*self.filters, *self.shift, self.last, self.by_length]

    def values(self, e: np.ndarray) -> np.ndarray:
        """Each filter at every place of a document, given its words' embeddings; beyond the end there is nothing."""
        out = np.empty((len(e), FILTERS * len(WIDTHS)), e.dtype)
        for c, (width, f, b) in enumerate(zip(WIDTHS, self.filters, self.shift, strict=True)):
            v = out[:, c * FILTERS : (c + 1) * FILTERS]
            np.dot(e, f[:WIDE], out=(first := np.empty((len(e), FILTERS), e.dtype)))
            v[:] = first + b
            for k in range(1, width):
                v[:-k] += e[k:] @ f[k * WIDE : (k + 1) * WIDE]
        return out

    def pooled(self, e: np.ndarray) -> np.ndarray:
        """The greatest value of each filter, 0 at least. Long documents are read in blocks that overlap by a filter's width."""
        out = np.zeros(FILTERS * len(WIDTHS), np.float32)
        reach = max(WIDTHS) - 1
        for start in range(0, len(e), BLOCK):
            block = self.values(e[start : start + BLOCK + reach])
            np.maximum(out, block[:BLOCK].max(0), out=out)
        return out

    def logit(self, e: np.ndarray) -> float:
        return float(self.pooled(e) @ self.last + self.by_length[0] * np.log1p(len(e)) + self.by_length[1])

    def logits(self, embedded: list[np.ndarray]) -> np.ndarray:
        return np.array([self.logit(e) for e in embedded])

    def gradients(self, rows: list[np.ndarray], y: np.ndarray, force: np.ndarray) -> tuple[float, list[np.ndarray], np.ndarray, np.ndarray]:
        """(loss, gradients of weights(), table rows, their gradients) of the mean cross entropy of documents, each with its force.

        Of a filter only the place of its greatest value is moved.
        """
        grads = [np.zeros_like(w) for w in self.weights()]
        reach, wide = max(WIDTHS) - 1, FILTERS * len(WIDTHS)
        gap = np.zeros((reach, PARTS), np.int32)  # nothing, between the documents
        joined = np.concatenate([x for r in rows for x in (r, gap)])
        sizes = np.array([len(r) for r in rows])
        starts = np.cumsum(sizes + reach) - sizes - reach
        e = self.table[joined].sum(1)
        v = self.values(e)
        at = np.stack([s + v[s : s + n].argmax(0) if n else np.zeros(wide, np.int64) for s, n in zip(starts, sizes, strict=True)])
        top = np.where(sizes[:, None] > 0, np.maximum(v[at, np.arange(wide)], 0), 0)
        size, share = np.log1p(sizes), force / len(rows)
        x = top @ self.last + self.by_length[0] * size + self.by_length[1]
        p = 1 / (1 + np.exp(-np.clip(x, -30, 30)))
        loss = float((share * np.logaddexp(0, np.where(y == 1, -x, x))).sum())
        d = share * (p - y)
        grads[-2] += d @ top
        grads[-1] += np.array([d @ size, d.sum()])
        g = np.where(top > 0, d[:, None] * self.last, 0).astype(np.float32)
        pulled, touched = np.zeros_like(e), np.zeros(len(e), bool)  # of each word's embedding
        for c, (width, f) in enumerate(zip(WIDTHS, self.filters, strict=True)):
            own, place = g[:, c * FILTERS : (c + 1) * FILTERS], at[:, c * FILTERS : (c + 1) * FILTERS]
            grads[len(WIDTHS) + c] += own.sum(0)
            for j in range(width):
                part, on = slice(j * WIDE, (j + 1) * WIDE), np.nonzero((place + j < (starts + sizes)[:, None]) & (own != 0))
                force_on, words = own[on][:, None], place[on] + j
                np.add.at(grads[c][part].T, on[1], e[words] * force_on)
                np.add.at(pulled, words, f[part].T[on[1]] * force_on)
                touched[words] = True
        at, inverse = np.unique(joined[touched].ravel(), return_inverse=True)
        moved = np.zeros((len(at), WIDE), np.float32)
        np.add.at(moved, inverse, np.repeat(pulled[touched], PARTS, 0))
        return loss, grads, at, moved

    def train(self, rows: list[np.ndarray], y: np.ndarray, seed: int = 17) -> None:
        """Adam on the weights and Adagrad on the table, at falling rates; both classes weigh the same."""
        rng = np.random.default_rng(seed)
        share = np.clip(y.mean(), 1e-6, 1 - 1e-6)
        force = np.where(y == 1, 0.5 / share, 0.5 / (1 - share))
        weights = self.weights()
        first, second = [np.zeros_like(w) for w in weights], [np.zeros_like(w) for w in weights]
        squares = np.full(len(self.table), 1e-6, np.float32)
        steps, step = EPOCHS * -(-len(rows) // BATCH), 0
        for _ in range(EPOCHS):
            order = rng.permutation(len(rows))
            for start in range(0, len(order), BATCH):
                pick = order[start : start + BATCH]
                step, fall = step + 1, 1 - step / (steps + 1)
                some = [r[rng.random(len(r)) >= LEFT_OUT] if len(r) > 3 else r for r in (rows[i] for i in pick)]
                _, grads, at, moved = self.gradients(some, y[pick], force[pick])
                for w, g, a, b in zip(weights, grads, first, second, strict=True):
                    a += 0.1 * (g - a)
                    b += 0.01 * (g * g - b)
                    w -= (RATE * fall * (a / (1 - 0.9**step)) / (np.sqrt(b / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
                squares[at] += (moved * moved).mean(1)
                self.table[at] -= TABLE_RATE * fall * moved / np.sqrt(squares[at])[:, None]
                self.table[0] = 0


def _trained(rows: list[np.ndarray], y: np.ndarray, pick: np.ndarray) -> Network:
    network = Network()
    network.train([rows[i] for i in pick], y[pick])
    return network


class Model:
    """The network, the byte shares by which languages are guessed, and each language's threshold."""

    def __init__(self, sample: list[tuple[str, int, str]]):
        rows, y = [table_rows(split(t)) for t, _, _ in sample], np.array([y for _, y, _ in sample], float)
        every = np.arange(len(sample))
        fold, logits = np.random.default_rng(19).integers(0, FOLDS, len(sample)), np.zeros(len(sample))
        for k in range(FOLDS):
            fit, rest = every[fold != k], every[fold == k]
            if len(set(y[fit])) < 2:
                fit = every  # too few texts to keep any back
            logits[rest] = (net := _trained(rows, y, fit)).logits([net.table[rows[i]].sum(1) for i in rest])
        self.network = _trained(rows, y, every)
        self.languages = sorted({x for _, _, x in sample})
        counts = np.ones((len(self.languages), 256))
        for t, _, x in sample:
            counts[self.languages.index(x)] += np.bincount(np.frombuffer(t.encode(), np.uint8), minlength=256)
        self.shares = np.log(counts / counts.sum(1, keepdims=True)).T
        language, overall = np.array([self.languages.index(x) for _, _, x in sample]), self.cut(logits, y)
        self.cuts = np.array([self.leaning(logits[language == k], y[language == k], overall) for k in range(len(self.languages))])

    def guess(self, texts: list[str]) -> np.ndarray:
        return np.array([(np.bincount(np.frombuffer(t.encode(), np.uint8), minlength=256) @ self.shares).argmax() for t in texts], int)

    @staticmethod
    def cut(logits: np.ndarray, y: np.ndarray) -> float:
        """The middle of the widest stretch of thresholds with the fewest errors."""
        order = np.argsort(logits, kind="stable")
        cuts = np.concatenate([[min(-5.0, logits.min(initial=0))], logits[order], [max(5.0, logits.max(initial=0))]])
        errors = np.concatenate([[0], np.cumsum(y[order] == 1)]) + np.concatenate([np.cumsum((y[order] == 0)[::-1])[::-1], [0]])
        best = np.flatnonzero(errors == errors.min())
        widest = best[np.argmax(cuts[best + 1] - cuts[best])]
        return float((cuts[widest] + cuts[widest + 1]) / 2)

    @classmethod
    def leaning(cls, logits: np.ndarray, y: np.ndarray, overall: float) -> float:
        """A language's own threshold, drawn to the overall one the more the fewer texts of its scarcer class there are."""
        n = min((y == 1).sum(), (y == 0).sum())
        own = cls.cut(logits, y) if n else overall
        return float((n * own + HALF_WEIGHT * overall) / (n + HALF_WEIGHT))

    def scores(self, texts: list[str], memory: Memory) -> np.ndarray:
        """The probability on either side of the threshold, stretched so that the threshold is DECISION."""
        logits = self.network.logits([memory.embedded(w) for w in memory.prepare([split(t) for t in texts])])
        p, t = (1 / (1 + np.exp(-np.clip(x, -30, 30))) for x in (logits, self.cuts[self.guess(texts)]))
        return np.where(p < t, p / t * DECISION, DECISION + (p - t) / (1 - t) * (1 - DECISION))


class Memory:
    """Embeddings of the words that a Python worker has met, within a bound."""

    def __init__(self, model: Model):
        self.table, self.place, self.found = model.network.table, {}, np.zeros((1024, WIDE), np.float32)

    def prepare(self, documents: list[list[str]]) -> list[list[str]]:
        distinct = set().union(*documents)
        new = [w for w in distinct if w not in self.place]
        if len(self.place) + len(new) > CACHE_WORDS:
            self.place, new = {}, list(distinct)
        at = len(self.place)
        while len(self.found) < at + len(new):
            self.found = np.concatenate([self.found, np.zeros_like(self.found)])
        for k in range(0, len(new), 4096):
            part = new[k : k + 4096]
            self.found[at + k : at + k + len(part)] = self.table[table_rows(part)].sum(1)
        self.place.update(zip(new, range(at, at + len(new)), strict=True))
        return documents

    def embedded(self, words: list[str]) -> np.ndarray:
        return self.found[np.fromiter(map(self.place.__getitem__, words), np.int64, len(words))]


#: The memory of this Python worker, by the model's key.
_memories: dict[str, Memory] = {}


def _memory(key: str, model: Model) -> Memory:
    if key not in _memories:
        _memories.clear()
        _memories[key] = Memory(model)
    return _memories[key]


def fit_toxicity(sample: list[tuple[str, int, str]]) -> Model | None:
    """(text, label, language) of the sample; None unless both labels occur."""
    return Model(sample) if len({y for _, y, _ in sample}) == 2 else None


def toxicity_scores(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS, max_bytes: int = MAX_BYTES) -> DataFrame:
    """doc_id, held_out and `score` (0 to 1; from 0.7 the text counts as toxic) for each row of `docs` (doc_id, text, lang).

    Learns from at most `per_class` rows of either class with texts of at most `max_bytes`, none of them held out
    (crc32 of the id modulo 3 is 1); their lang only says whose threshold they calibrate. A row is scored by its whole text alone.
    Null and empty texts are scored as a document without words; without both labels every score is 0. Null ids are not
    held out; other columns are ignored; repeated rows are scored each.
    """
    spark = docs.sparkSession
    learn = fold(F.col("doc_id"), 3) != 1
    both = docs.select("doc_id", F.struct("text", F.coalesce("lang", F.lit("")).alias("lang")).alias("both"))
    packed = both.select("doc_id", F.to_json("both").alias("text"))
    sample = [((x := json.loads(t)).get("text") or "", y, x["lang"]) for t, y in labelled_sample(packed, labels, "toxic", learn, per_class, max_bytes, [0, 1])]
    model, key = spark.sparkContext.broadcast(fit_toxicity(sample)), uuid.uuid4().hex

    def make():
        fitted = model.value
        memory = _memory(key, fitted) if fitted else None

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            score = fitted.scores(texts_of(batch), memory) if fitted else np.zeros(batch.num_rows)
            return pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(score, pa.float64())], ["doc_id", "held_out", "score"])

        return step

    rows = docs.select("doc_id", "text", F.coalesce(fold(F.col("doc_id"), 3) == 1, F.lit(False)).alias("held_out"))
    return map_slices(rows, make, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, held_out boolean, score double")
