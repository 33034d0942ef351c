"""Benchmark decontamination by pigeonhole edit matching.

Texts are compared as lower-case letters and digits with one space for everything between them. An item with n such characters
may differ from a passage by n * rate edits, its budget. It is split into budget + 1 pieces: whatever the edits, one piece
stays whole in the passage, so every passage within the budget is found by an exact hit of a piece. All pieces of a block of
items are looked for at once with an Aho-Corasick automaton, and each hit is verified around its place with Myers'
bit-parallel edit distance.
"""

from __future__ import annotations

import re
import uuid

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ravenna.llm._arrow import map_slices, texts_of

#: Edits allowed for each character of an item.
RATE = 0.08
#: Characters of the items that are matched in one pass; a larger benchmark takes several passes over the documents.
BLOCK_CHARS = 1_000_000
BETWEEN = re.compile(r"[\W_]+")


def plain(text: str) -> str:
    return BETWEEN.sub(" ", text.lower()).strip()


def myers(pattern: str, text: str) -> tuple[int, int]:
    """The least edit distance between `pattern` and any stretch of `text`, and where the first such stretch ends."""
    m = len(pattern)
    masks: dict[str, int] = {}
    for i, c in enumerate(pattern):
        masks[c] = masks.get(c, 0) | 1 << i
    full, top, get = (1 << m) - 1, 1 << (m - 1), masks.get
    up, down, score = full, 0, m
    best, end = m, 0
    for j, c in enumerate(text, 1):
        eq = get(c, 0)
        xv = eq | down
        xh = (((eq & up) + up) ^ up) | eq
        ph = down | (full & ~(xh | up))
        mh = up & xh
        if ph & top:
            score += 1
        elif mh & top:
            score -= 1
        ph, mh = (ph << 1) & full, (mh << 1) & full  # a stretch may start anywhere at no cost
        up, down = mh | (full & ~(xv | ph)), ph & xv
        if score < best:
            best, end = score, j
    return best, end


def pieces(text: str, budget: int) -> list[tuple[int, str]]:
    """budget + 1 pieces of nearly equal length with their places."""
    n, k = len(text), min(budget + 1, len(text))
    cuts = [n * i // k for i in range(k + 1)]
    return [(a, text[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)]


class Matcher:
    """The automaton of one block of items (item_id, plain text)."""

    def __init__(self, items: list[tuple[object, str]], rate: float):
        self.items = [(i, t, int(len(t) * rate)) for i, t in items if t]
        found: dict[str, list[tuple[int, int]]] = {}
        for k, (_, t, budget) in enumerate(self.items):
            for at, piece in pieces(f" {t} " if not budget else t, budget):
                found.setdefault(piece, []).append((k, at))
        self.automaton = ahocorasick.Automaton()
        for piece, places in found.items():
            self.automaton.add_word(piece, (len(piece), places))
        if found:
            self.automaton.make_automaton()

    def hits(self, text: str) -> list[tuple[object, int, int, int]]:
        """(item_id, distance, start, end) of each item within its budget somewhere; places are in the plain text.

        The passage of least distance is given, of several the first found.
        """
        if not self.items:
            return []
        text = plain(text)
        best: dict[int, tuple[int, int, int]] = {}
        tried: set[tuple[int, int]] = set()
        padded = f" {text} "
        for end, (size, places) in self.automaton.iter(padded):
            for k, at in places:
                _, item, budget = self.items[k]
                start = end + 1 - size - at - (1 if budget else 0)  # of the passage in `text`, without edits
                if best.get(k, (1,))[0] == 0 or (k, start) in tried:
                    continue
                tried.add((k, start))
                a = max(0, start - budget)
                if text.startswith(item, max(0, start)) and start >= 0:
                    best[k] = (0, start, start + len(item))
                    continue
                if not budget:
                    continue
                distance, stop = myers(item, text[a : start + len(item) + budget])
                if distance <= budget and distance < best.get(k, (budget + 1,))[0]:
                    best[k] = (distance, max(a, a + stop - len(item)), a + stop)
        return [(self.items[k][0], *best[k]) for k in sorted(best)]


#: The matchers of this Python worker, by their block's key.
_matchers: dict[str, Matcher] = {}


def _blocks(benchmark: DataFrame, rate: float, block_chars: int):
    """(key, broadcast items) of each block; only one block's items are on the driver at a time."""
    spark = benchmark.sparkSession
    items = benchmark.where(F.col("text").isNotNull()).select("item_id", "text")
    total = items.agg(F.sum(F.length("text"))).first()[0] or 0
    n = -(-total // block_chars)
    for b in range(n):
        part = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == b).distinct()
        rows = sorted(((r["item_id"], plain(r["text"])) for r in part.collect()), key=lambda x: (str(x[0]), x[1]))
        yield uuid.uuid4().hex, spark.sparkContext.broadcast(rows)


def _matcher(key: str, items, rate: float) -> Matcher:
    if key not in _matchers:
        _matchers.clear()
        _matchers[key] = Matcher(items.value, rate)
    return _matchers[key]


def find_leaks(docs: DataFrame, benchmark: DataFrame, rate: float = RATE, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """(doc_id, item_id, distance, start, end) for each row of `docs` (doc_id, text) and item of `benchmark` (item_id, text) within the budget in it.

    start and end are places in the plain text. Null and empty texts and items without letters and digits match nothing.
    Items with a budget below one edit must occur as whole words. Repeated rows are matched each, equal item rows once; null
    ids stay null; other columns are ignored. Without items or rows the result is empty.
    """
    rows = docs.select("doc_id", "text")
    ids = f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, item_id {benchmark.schema['item_id'].dataType.simpleString()}"
    kinds = [pa.field(c, t) for c, t in (("distance", pa.int64()), ("start", pa.int64()), ("end", pa.int64()))]
    schema = f"{ids}, distance long, start long, end long"
    out = docs.sparkSession.createDataFrame([], schema)
    for key, items in _blocks(benchmark, rate, block_chars):

        def make(key=key, items=items):
            matcher = _matcher(key, items, rate)

            def step(batch: pa.RecordBatch) -> pa.RecordBatch:
                found = [(i, *h) for i, t in enumerate(texts_of(batch)) if t for h in matcher.hits(t)]
                at = pa.array([f[0] for f in found], pa.int64())
                columns = [batch.column("doc_id").take(at), pa.array([f[1] for f in found])]
                columns += [pa.array([f[2 + k] for f in found], kind.type) for k, kind in enumerate(kinds)]
                return pa.RecordBatch.from_arrays(columns, ["doc_id", "item_id", *(k.name for k in kinds)])

            return step

        out = out.unionByName(map_slices(rows, make, schema))
    return out


def drop_leaks(docs: DataFrame, benchmark: DataFrame, rate: float = RATE, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """`docs` without the rows that hold a passage of `benchmark`; a filter without a shuffle."""
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    for key, items in _blocks(benchmark, rate, block_chars):

        def make(key=key, items=items):
            matcher = _matcher(key, items, rate)

            def step(batch: pa.RecordBatch) -> pa.RecordBatch:
                return batch.filter(pa.array([not (t and matcher.hits(t)) for t in texts_of(batch)], pa.bool_()))

            return step

        docs = map_slices(docs, make, schema)
    return docs
