"""Keeping each query's best in a task, so that only they reach the shuffle."""

from __future__ import annotations

import numpy as np
import pyarrow as pa


class Best:
    """The best `top_n` (id, score) of each query among all that a task was given, ties at the last place included."""

    def __init__(self, top_n: int):
        self.top_n, self.query, self.ids, self.score = top_n, np.zeros(0, np.int64), None, np.zeros(0)

    def add(self, query: np.ndarray, ids: pa.Array, score: np.ndarray) -> None:
        query, score = np.concatenate([self.query, query]), np.concatenate([self.score, score])
        ids = ids if self.ids is None else pa.concat_arrays([self.ids, ids])
        order = np.lexsort((-score, query))
        query, score = query[order], score[order]
        first, end = np.searchsorted(query, query), np.searchsorted(query, query, "right")
        kept = np.flatnonzero(score >= score[np.minimum(first + self.top_n, end) - 1]) if len(score) else order
        self.query, self.score, self.ids = query[kept], score[kept], ids.take(pa.array(order[kept]))

    def rows(self, names: list) -> list[pa.RecordBatch]:
        """(question_id, chunk_id, score), given the queries' names; none without rows."""
        if self.ids is None or not len(self.query):
            return []
        return [pa.RecordBatch.from_arrays([pa.array([names[j] for j in self.query]), self.ids, pa.array(self.score)], ["question_id", "chunk_id", "score"])]


def candidates(score: np.ndarray, top_n: int, slack: float = 0.0) -> tuple[np.ndarray, np.ndarray]:
    """(row, column) of the `top_n` greatest of each column of (rows, queries), and of those that lie at most `slack` below."""
    k = min(top_n, len(score))
    return np.nonzero(score >= np.partition(score, len(score) - k, axis=0)[len(score) - k] - slack) if k else (np.zeros(0, np.int64),) * 2
