"""Language identification by a bidirectional gated recurrent network over bytes.

The network reads a text's bytes forwards and backwards, white space included, and labels every position with probabilities of
the languages; a document's probabilities are the mean over all its positions. Texts are read in stretches of SEGMENT bytes
with CONTEXT bytes of their surroundings on either side, over which the states build up, so a stretch is labelled much as if
the reading had begun at the text's end, and stretches of all texts are read side by side. What lies beyond a text counts as
spaces. Training is plain backpropagation through time in numpy.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ravenna.llm._arrow import map_slices, texts_of
from ravenna.llm._sample import fold, labelled_sample

#: Bounds of the sample: texts of each language, and bytes of a text.
PER_LANGUAGE, MAX_BYTES = 300, 1 << 15
HIDDEN, SEGMENT, CONTEXT = 12, 240, 16
STEPS, BATCH, RATE, STRETCH = 600, 256, 0.02, 48
#: Stretches that are read side by side, and numbers that a position of them takes for its languages.
LANES, MOST_NUMBERS = 1024, 1 << 22
LETTER = regex.compile(r"\p{L}")
SPACE = 32


def _sigmoid(x: np.ndarray) -> np.ndarray:
    """In place; what overflows is 0."""
    np.negative(x, out=x)
    np.exp(x, out=x)
    x += 1
    return np.reciprocal(x, out=x)


class Direction:
    """Gated recurrent units that read in one direction. A byte's inputs to update, reset and state come from tables."""

    def __init__(self, rng: np.random.Generator, hidden: int):
        self.table = (rng.standard_normal((3, 256, hidden)) * 0.3).astype(np.float32)
        self.back = (rng.standard_normal((3, hidden, hidden)) / np.sqrt(hidden)).astype(np.float32)

    def forward(self, raw: np.ndarray, keep: list | None = None) -> np.ndarray:
        """States after each position: raw is (length, lanes), the result (length, lanes, hidden)."""
        n, m = raw.shape
        h = np.zeros((m, self.back.shape[1]), self.back.dtype)
        out = np.empty((n, *h.shape), h.dtype)
        for t in range(n):
            x = [np.take(table, raw[t], axis=0) for table in self.table]
            z, r = _sigmoid(x[0] + h @ self.back[0]), _sigmoid(x[1] + h @ self.back[1])
            new = _sigmoid(2 * (x[2] + (r * h) @ self.back[2]))
            new *= 2
            new -= 1  # the hyperbolic tangent
            if keep is not None:
                keep.append((h, z, r, new))
            h = h + z * (new - h)
            out[t] = h
        return out

    def read(self, raw: np.ndarray) -> np.ndarray:
        """What forward() gives, for reading only: in place, with the signs and factors of the gates' functions in the tables."""
        n, m = raw.shape
        k = self.back.shape[1]
        gates, state = np.concatenate([-self.table[0], -self.table[1]], 1), 2 * self.table[2]
        back_gates, back_state = np.concatenate([-self.back[0], -self.back[1]], 1), 2 * self.back[2]
        out, h = np.empty((n, m, k), gates.dtype), np.zeros((m, k), gates.dtype)
        g, more, c, reset = (np.empty((m, w), gates.dtype) for w in (2 * k, 2 * k, k, k))
        for t in range(n):
            np.take(gates, raw[t], 0, g, "clip")
            g += np.matmul(h, back_gates, more)
            np.exp(g, g)
            g += 1
            np.reciprocal(g, g)
            np.take(state, raw[t], 0, c, "clip")
            c += np.multiply(g[:, k:], h, reset) @ back_state
            np.exp(c, c)
            c += 1
            np.divide(-2, c, c)
            c += 1
            c -= h
            c *= g[:, :k]
            h = np.add(h, c, out[t])
        return out

    def backward(self, raw: np.ndarray, kept: list, grad: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Gradients of the tables and of the recurrent weights, given those of the states."""
        d_table, d_back = np.zeros_like(self.table), np.zeros_like(self.back)
        moves = np.empty((3, *grad.shape), grad.dtype)
        dh = np.zeros_like(grad[0])
        for t in range(len(raw) - 1, -1, -1):
            h, z, r, new = kept[t]
            dh = dh + grad[t]
            d_new = dh * z * (1 - new * new)
            d_rh = d_new @ self.back[2].T
            d_z, d_r = dh * (new - h) * z * (1 - z), d_rh * h * r * (1 - r)
            for g, d, state in zip(d_back, (d_z, d_r, d_new), (h, h, r * h), strict=True):
                g += state.T @ d
            moves[:, t] = d_z, d_r, d_new
            dh = dh * (1 - z) + d_rh * r + d_z @ self.back[0].T + d_r @ self.back[1].T
        for g, d in zip(d_table, moves, strict=True):
            np.add.at(g, raw.ravel(), d.reshape(-1, d.shape[-1]))
        return d_table, d_back


def stretches(texts: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(lanes, places, rows): the bytes of up to LANES stretches with their surroundings, how many of each are its own, and whose text it is."""
    width = SEGMENT + 2 * CONTEXT
    lanes, sizes, rows = np.full((LANES, width), SPACE, np.uint8), np.zeros(LANES, np.int64), np.zeros(LANES, np.int64)
    n = 0
    for i, text in enumerate(texts):
        raw = np.frombuffer(text, np.uint8)
        for start in range(0, len(raw), SEGMENT):
            part = raw[max(0, start - CONTEXT) : start + SEGMENT + CONTEXT]
            skip = CONTEXT - min(start, CONTEXT)
            lanes[n, skip : skip + len(part)] = part
            sizes[n], rows[n] = min(SEGMENT, len(raw) - start), i
            n += 1
            if n == LANES:
                yield lanes, sizes, rows
                lanes, n = np.full_like(lanes, SPACE), 0
    if n:
        most = int(sizes[:n].max()) + 2 * CONTEXT  # few short texts need no more steps
        yield lanes[:n, :most], sizes[:n], rows[:n]


class ByteReader:
    """Both directions and the layer that labels a position."""

    def __init__(self, languages: list[str], seed: int = 11, hidden: int = HIDDEN):
        rng = np.random.default_rng(seed)
        self.languages, self.ways = languages, [Direction(rng, hidden), Direction(rng, hidden)]
        self.out = (rng.standard_normal((2 * hidden, len(languages))) * 0.2).astype(np.float32)
        self.bias = np.zeros(len(languages), np.float32)

    def weights(self) -> list[np.ndarray]:
        return [self.ways[0].table, self.ways[0].back, self.ways[1].table, self.ways[1].back, self.out, self.bias]

    def states(self, raw: np.ndarray, keep: tuple[list, list] | None = None) -> np.ndarray:
        """(length, lanes, 2 hidden): what either direction knows after each position."""
        with np.errstate(over="ignore"):
            return np.concatenate([self.ways[0].forward(raw, keep and keep[0]), self.ways[1].forward(raw[::-1], keep and keep[1])[::-1]], 2)

    def labels(self, states: np.ndarray) -> np.ndarray:
        """Probabilities of the languages at each position."""
        x = states @ self.out + self.bias
        x -= x.max(-1, keepdims=True)
        np.exp(x, out=x)
        x /= x.sum(-1, keepdims=True)
        return x

    def gradients(self, raw: np.ndarray, y: np.ndarray) -> tuple[float, list[np.ndarray]]:
        """The mean cross entropy of all positions of (length, lanes) bytes, and its gradients of weights()."""
        keep = ([], [])
        both = self.states(raw, keep)
        p = self.labels(both)
        lane = np.arange(len(y))
        loss = -float(np.log(np.maximum(p[:, lane, y], 1e-12)).mean())
        p[:, lane, y] -= 1
        d = p / (p.shape[0] * p.shape[1])
        k = both.shape[2] // 2
        d_both = d @ self.out.T
        ahead, behind = self.ways[0].backward(raw, keep[0], d_both[:, :, :k]), self.ways[1].backward(raw[::-1], keep[1], d_both[::-1, :, k:])
        return loss, [*ahead, *behind, both.reshape(-1, 2 * k).T @ d.reshape(-1, d.shape[2]), d.sum((0, 1))]

    def train(self, texts: list[list[np.ndarray]], steps: int = STEPS, seed: int = 5) -> None:
        """`texts` has the bytes of each language's texts. Adam on stretches that start anywhere; languages are drawn alike."""
        rng = np.random.default_rng(seed)
        joined = [np.concatenate(t) for t in texts]
        weights = self.weights()
        first, second = [np.zeros_like(w) for w in weights], [np.zeros_like(w) for w in weights]
        for step in range(1, steps + 1):
            y = rng.integers(0, len(joined), BATCH)
            raw = np.full((STRETCH, BATCH), SPACE, np.uint8)
            for lane, k in enumerate(y):
                at = int(rng.integers(0, max(1, len(joined[k]) - STRETCH + 1)))
                part = joined[k][at : at + STRETCH]
                raw[: len(part), lane] = part
            _, grads = self.gradients(raw, y)
            rate = RATE * min(1, 2 * (1 - step / (steps + 1)))
            for w, g, a, b in zip(weights, grads, first, second, strict=True):
                a += 0.1 * (g - a)
                b += 0.01 * (g * g - b)
                w -= (rate * (a / (1 - 0.9**step)) / (np.sqrt(b / (1 - 0.99**step)) + 1e-8)).astype(np.float32)

    def documents(self, texts: list[bytes]) -> np.ndarray:
        """Mean probabilities over all positions of each text; zeros without bytes."""
        out = np.zeros((len(texts), len(self.languages)))
        for lanes, sizes, rows in stretches(texts):
            raw, width = np.ascontiguousarray(lanes.T), len(sizes)
            with np.errstate(over="ignore"):
                ahead, behind = self.ways[0].read(raw)[CONTEXT:], self.ways[1].read(raw[::-1])[::-1][CONTEXT:]
            own = np.arange(len(ahead))[:, None] < sizes
            some, k = max(1, MOST_NUMBERS // (width * len(self.languages))), ahead.shape[2]
            for t in range(0, int(sizes.max()), some):
                # languages come first, so that sums over them run along whole rows
                x = self.out[:k].T @ ahead[t : t + some].reshape(-1, k).T
                x += self.out[k:].T @ behind[t : t + some].reshape(-1, k).T
                x += self.bias[:, None]
                x -= x.max(0)
                np.exp(x, x)
                x *= own[t : t + some].ravel() / x.sum(0)
                np.add.at(out, rows, x.reshape(len(x), -1, width).sum(1).T)
        return out / np.maximum(out.sum(1, keepdims=True), 1e-9)


def fit_language(sample: list[tuple[str, str]], steps: int = STEPS) -> ByteReader | None:
    """None when there is no labelled text. A text is followed by a space; every language is drawn as often as any other."""
    languages = sorted({y for _, y in sample})
    if not languages:
        return None
    of: dict[str, list[np.ndarray]] = {y: [] for y in languages}
    for text, y in sample:
        of[y].append(np.frombuffer((text or "").encode() + b" ", np.uint8))
    reader = ByteReader(languages)
    reader.train([of[y] for y in languages], steps)
    return reader


def identify_language(docs: DataFrame, labelled: DataFrame | None = None, per_language: int = PER_LANGUAGE, max_bytes: int = MAX_BYTES, steps: int = STEPS) -> DataFrame:
    """doc_id, held_out, lang_pred, score and `probabilities` for each row of `docs` (doc_id, text).

    Learns every lang from text and lang of `labelled` (default `docs`), at most `per_language` rows of a language (fewer when
    there are over 64 languages) with texts of at most `max_bytes`, none of them held out (crc32 of the id modulo 4 is 2). Texts that are null or have no letter are
    `und` with score 0, and so is everything when nothing is labelled. Null ids are not held out; other columns are
    ignored; repeated rows are predicted each.
    """
    source = docs if labelled is None else labelled
    spark = docs.sparkSession
    reader = fit_language(labelled_sample(source, source, "lang", fold(F.col("doc_id"), 4) != 2, per_language, max_bytes), steps)
    model = spark.sparkContext.broadcast(reader)
    languages = reader.languages if reader else []

    def make():
        reader = model.value

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            texts = texts_of(batch)
            p = reader.documents([t.encode() for t in texts]) if reader else np.zeros((len(texts), 1))
            lettered = [bool(languages) and LETTER.search(t) is not None for t in texts]
            best = p.argmax(1)
            return pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    batch.column("held_out"),
                    pa.array([languages[b] if ok else "und" for b, ok in zip(best, lettered, strict=True)], pa.string()),
                    pa.array([float(x[b]) if ok else 0.0 for x, b, ok in zip(p, best, lettered, strict=True)], pa.float64()),
                    pa.array(list(p) if languages else [[]] * len(texts), pa.list_(pa.float64())),
                ],
                ["doc_id", "held_out", "lang_pred", "score", "probabilities"],
            )

        return step

    rows = docs.select("doc_id", "text", F.coalesce(fold(F.col("doc_id"), 4) == 2, F.lit(False)).alias("held_out"))
    return map_slices(rows, make, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, held_out boolean, lang_pred string, score double, probabilities array<double>")
