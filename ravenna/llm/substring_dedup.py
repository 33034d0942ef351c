"""Substring deduplication with a log-structured index of window fingerprints.

A window is a number of consecutive words. Out of every window one shorter run of words is chosen, the one with the least
hash, so equal windows choose equal runs; neighbouring windows mostly choose the same one, so a tenth of the fingerprints
stands for all windows. Batches of documents add their fingerprints to the index as sorted immutable runs, which are cut into ranges
of hashes and stored by range. Each new run is merge-joined with the historical ones where they lie; a fingerprint that occurs twice
makes the windows that chose it candidates. When there are many runs they are compacted, range by range.

Candidates are verified: whole windows are sorted and compared by two hashes of their words, which come from independent hashes of
each word, so a shared run inside windows that differ elsewhere removes nothing. Documents with the same words form one class first, by
a cryptographic digest; a class with several members repeats all its windows.
"""

from __future__ import annotations

import hashlib
import secrets
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ravenna.llm._arrow import map_slices, texts_of
from ravenna.llm._rows import small, split_join
from ravenna.session import bucketed, materialize, release, ship_package

WINDOW = 35
#: Words of the chosen run; every window has WINDOW - RUN + 1 of them.
RUN = 18
#: Fingerprints of a part of a sorted run on average, runs before a compaction, batches of one table.
PART, FAN, BATCHES = 1 << 16, 2, 3
CACHE_WORDS = 300_000
BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)


def powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64, for i below n."""
    out = []
    for b in (base, pow(base, -1, 1 << 64)):
        x = np.full(n, b, np.uint64)
        x[:1] = 1
        out.append(np.cumprod(x, dtype=np.uint64))
    return out[0], out[1]


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Windows:
    """Hashes of a document's words, runs and windows. A word has one hash for each of `seeds` seeds, remembered within a bound."""

    def __init__(self, seeds: int = 1):
        self.place: dict[bytes, int] = {}
        self.hashes = np.zeros((seeds, CACHE_WORDS), np.uint64)
        self.tables: list[tuple[np.ndarray, np.ndarray]] = [powers(b, 1 << 15) for b in BASES]

    def words(self, words: list[bytes]) -> np.ndarray:
        """(seeds, words)"""
        place = self.place
        new = [w for w in set(words) if w not in place]
        if new:
            if len(place) + len(new) > CACHE_WORDS:
                place.clear()
                new = list(set(words))
            at = len(place)
            if at + len(new) > self.hashes.shape[1]:
                self.hashes = np.zeros((len(self.hashes), at + len(new)), np.uint64)  # one text of so many words; nothing else is remembered
            for seed, row in enumerate(self.hashes):
                row[at : at + len(new)] = [xxhash.xxh3_64_intdigest(w, seed) for w in new]
            place.update(zip(new, range(at, at + len(new)), strict=True))
        return self.hashes[:, np.fromiter(map(place.__getitem__, words), np.int64, len(words))]

    def rolled(self, hashes: np.ndarray, size: int, which: int = 0) -> np.ndarray:
        """A hash of each run of `size` words, from the words' hashes of the seed `which`."""
        n = len(hashes)
        if n < size:
            return np.zeros(0, np.uint64)
        if len(self.tables[which][0]) < n:
            self.tables[which] = powers(BASES[which], 2 * n)
        up, down = self.tables[which]
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum(hashes * up[:n], out=sums[1:])
        return mixed((sums[size:] - sums[:-size]) * down[: n - size + 1])

    def chosen(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The hashes of all runs, and for each window the place of its chosen run: the leftmost least."""
        runs = self.rolled(hashes, RUN)
        width = WINDOW - RUN + 1
        if len(runs) < width:
            return runs, np.zeros(0, np.int64)
        return runs, sliding_window_view(runs, width).argmin(1) + np.arange(len(runs) - width + 1)


def _long(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, print, n_words, words_sha, chosen) of each row: chosen has the fingerprint of every chosen run, repeats included."""

    def make():
        windows = Windows()

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            n, shas, found = [], [], []
            for t in texts_of(batch):
                words = t.encode().split()
                joined = b" ".join(words)
                n.append(len(words))
                shas.append(hashlib.sha256(joined).hexdigest())
                if len(words) >= WINDOW:
                    runs, at = windows.chosen(windows.words(words)[0])
                    found.append(_long(runs[np.unique(at)]))
                else:
                    found.append(np.zeros(0, np.int64))
            offsets = np.cumsum([0, *map(len, found)])
            chosen = pa.LargeListArray.from_arrays(pa.array(offsets, pa.int64()), pa.array(np.concatenate(found) if found else np.zeros(0, np.int64))).cast(pa.list_(pa.int64()))
            arrays = [batch.column("doc_id"), batch.column("print"), pa.array(n, pa.int64()), pa.array(shas, pa.string()), chosen]
            return pa.RecordBatch.from_arrays(arrays, ["doc_id", "print", "n_words", "words_sha", "chosen"])

        return step

    rows = docs.select("doc_id", "text", F.xxhash64("text").alias("print"))
    return map_slices(rows, make, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, print long, n_words long, words_sha string, chosen array<long>")


def _flat(column: pa.Array) -> np.ndarray:
    """All the numbers in a column of lists of longs."""
    return column.flatten().to_numpy(zero_copy_only=False).view(np.uint64)


def _u64(values: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(values), np.uint64)


def _u32(values: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(values), np.uint32)


def _counted(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct keys, and how often each occurs."""
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    return keys[first], np.minimum(np.add.reduceat(counts.astype(np.int64), first), (1 << 32) - 1).astype(np.uint32) if len(first) else np.zeros(0, np.uint32)


class FingerprintIndex:
    """Sorted immutable runs of historical fingerprints, kept in the shared folder.

    A run has a row for each range of hashes (part): its sorted distinct fingerprints and how often each occurred. Batches are
    pre-aggregated before they are shuffled, so a fingerprint that a third of all documents have weighs no more than one that each
    task has seen. Runs are stored in buckets by part, as many as the session has shuffle partitions, so a new run and the
    historical ones are joined bucket by bucket without another shuffle of either.

    `windows` are both hashes of all windows of the tables that `remember` was given, each once, cut in the same way.
    """

    def __init__(self, spark: SparkSession):
        ship_package(spark)
        self.spark, self.runs, self.bits, self.size = spark, [], 0, 0
        self.buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.windows: DataFrame | None = None
        self.window_bits = self.n_windows = 0

    def _stored(self, rows: DataFrame) -> DataFrame:
        """(part, keys, counts), a row for each part, from rows of which some have the same part."""

        def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            """Rows come sorted by part."""
            part, keys, counts = None, [], []
            for batch in batches:
                for p, k, c in zip(*(batch.column(x).to_pylist() for x in ("part", "keys", "counts")), strict=True):
                    if p != part and keys:
                        yield _row(part, *_counted(_u64(keys), _u32(counts)))
                        keys, counts = [], []
                    part = p
                    keys.append(k)
                    counts.append(c)
            if keys:
                yield _row(part, *_counted(_u64(keys), _u32(counts)))

        dealt = rows.repartition(self.buckets, "part").sortWithinPartitions("part")
        return bucketed(dealt.mapInArrow(merge, RUN_SCHEMA), "part", self.buckets, "index-run")

    def _sorted_run(self, rows: DataFrame, column: str) -> DataFrame:
        """Rows of one run from rows with a list column of fingerprints."""
        bits = self.bits

        def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held, size = [], 0
            for batch in batches:
                held.append(_flat(batch.column(0)).copy())
                size += len(held[-1])
                if size >= 1 << 20:
                    yield _parts(*_counted(np.concatenate(held), np.ones(size, np.uint32)), bits)
                    held, size = [], 0
            if size:
                yield _parts(*_counted(np.concatenate(held), np.ones(size, np.uint32)), bits)

        return rows.select(column).mapInArrow(split, RUN_SCHEMA)

    def _beside(self, runs: list[DataFrame], how: str) -> DataFrame:
        """(part, keys0, counts0, keys1, ...): the same part of all `runs`, by a join of buckets."""
        named = lambda k: runs[k].select("part", F.col("keys").alias(f"keys{k}"), F.col("counts").alias(f"counts{k}"))
        out = named(0)
        for k in range(1, len(runs)):
            out = out.join(named(k), "part", how)
        return out

    def add(self, batch: DataFrame, column: str = "chosen") -> DataFrame:
        """Add the fingerprints in `batch`'s list column; return (fingerprint, times) for those of the batch that now occur twice or more."""
        n = batch.agg(F.sum(F.size(column))).first()[0] or 0
        self.size += n
        need = max(0, (self.size // PART).bit_length())
        if need > self.bits and self.runs:
            self.compact(need)
        self.bits = max(self.bits, need)
        run = self._stored(self._sorted_run(batch, column))
        sides = len(self.runs) + 1

        def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for row in batch.to_pylist():
                    own = _u64([row["keys0"]])
                    keys, often = _counted(*_together(row, sides))
                    at = np.searchsorted(keys, own)
                    twice = often[at] > 1
                    yield pa.RecordBatch.from_arrays([pa.array(_long(own[twice])), pa.array(often[at][twice].astype(np.int64))], ["fingerprint", "times"])

        repeated = materialize(self._beside([run, *self.runs], "left").mapInArrow(joined, "fingerprint long, times long"), "index-repeated")
        self.runs.append(run)
        if len(self.runs) > FAN:
            self.compact(self.bits)
        return repeated

    def compact(self, bits: int) -> None:
        """Merge all runs into one. It is a merge of buckets, unless the ranges are cut anew, at 2**bits, which deals them out again."""
        old, sides = self.runs, len(self.runs)
        if bits == self.bits:

            def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                for batch in batches:
                    for row in batch.to_pylist():
                        yield _row(row["part"], *_counted(*_together(row, sides)))

            self.runs = [bucketed(self._beside(old, "full").mapInArrow(merge, RUN_SCHEMA), "part", self.buckets, "index-compacted")]
        else:

            def again(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                for batch in batches:
                    for k, c in zip(batch.column("keys").to_pylist(), batch.column("counts").to_pylist(), strict=True):
                        yield _parts(_u64([k]), _u32([c]), bits)

            self.runs = [self._stored(reduce(DataFrame.unionByName, old).mapInArrow(again, RUN_SCHEMA))]
        self.bits = bits
        for run in old:
            release(run)

    def drop(self) -> None:
        """Delete the index's tables."""
        release(*self.runs, *([self.windows] if self.windows is not None else []))
        self.runs, self.windows = [], None

    def remember(self, docs: DataFrame) -> None:
        """Add all windows of the texts in `docs`, so that later tables find them."""
        rows = materialize(_all_windows(docs), "index-window-slices", None)
        self.n_windows += rows.agg(F.sum(F.length("keys") / 8).cast("long")).first()[0] or 0
        self.window_bits = max(self.window_bits, (self.n_windows // PART).bit_length())
        both = rows if self.windows is None else rows.unionByName(self.windows)
        last, self.windows = self.windows, materialize(_merged_windows(_recut(both, self.window_bits)), "index-windows")
        release(rows, *([last] if last is not None else []))


RUN_SCHEMA = "part long, keys binary, counts binary"


def _row(part: int, keys: np.ndarray, counts: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([part], pa.int64()), pa.array([keys.tobytes()], pa.binary()), pa.array([counts.tobytes()], pa.binary())], ["part", "keys", "counts"])


def _together(row: dict, sides: int) -> tuple[np.ndarray, np.ndarray]:
    """All keys and counts of a part; runs without it have none."""
    return tuple(read([row[f"{c}{k}"] or b"" for k in range(sides)]) for c, read in (("keys", _u64), ("counts", _u32)))


def _cut(keys: np.ndarray, checks: np.ndarray, bits: int) -> pa.RecordBatch:
    """Distinct windows, sorted and cut at the ranges' ends."""
    keys, checks = _distinct(keys, checks)
    of = (keys >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(keys), np.int64)
    starts = np.flatnonzero(np.concatenate([[True], of[1:] != of[:-1]])) if len(of) else np.zeros(0, np.int64)
    spans = list(zip(starts, [*starts[1:], len(keys)], strict=False))
    blob = lambda x: pa.array([x[a:b].tobytes() for a, b in spans], pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(of[starts]), blob(keys), blob(checks)], ["part", "keys", "checks"])


def _distinct(keys: np.ndarray, checks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.lexsort((checks, keys))
    keys, checks = keys[order], checks[order]
    first = np.concatenate([[True], (keys[1:] != keys[:-1]) | (checks[1:] != checks[:-1])]) if len(keys) else np.zeros(0, bool)
    return keys[first], checks[first]


def _all_windows(docs: DataFrame) -> DataFrame:
    """(part, keys, checks): the distinct windows of slices of the texts."""

    def make():
        windows = Windows(2)

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            keys, checks = [np.zeros(0, np.uint64)], [np.zeros(0, np.uint64)]
            for t in texts_of(batch):
                h = windows.words(t.encode().split())
                for which, found in ((0, keys), (1, checks)):
                    found.append(windows.rolled(h[which], WINDOW, which))
            return _cut(np.concatenate(keys), np.concatenate(checks), 0)

        return step

    return map_slices(docs.select("text"), make, "part long, keys binary, checks binary")


def _recut(rows: DataFrame, bits: int) -> DataFrame:
    """Rows of sorted windows cut at 2**bits ranges."""

    def again(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k, c in zip(batch.column("keys").to_pylist(), batch.column("checks").to_pylist(), strict=True):
                yield _cut(_u64([k]), _u64([c]), bits)

    return rows.mapInArrow(again, "part long, keys binary, checks binary")


def _merged_windows(rows: DataFrame) -> DataFrame:
    def merge(part: pa.Table) -> pa.Table:
        keys, checks = _distinct(_u64(part.column("keys").to_pylist()), _u64(part.column("checks").to_pylist()))
        return pa.table({"part": part.column("part")[:1], "keys": pa.array([keys.tobytes()], pa.binary()), "checks": pa.array([checks.tobytes()], pa.binary())})

    return rows.groupBy("part").applyInArrow(merge, "part long, keys binary, checks binary")


def _parts(keys: np.ndarray, counts: np.ndarray, bits: int) -> pa.RecordBatch:
    """Sorted keys cut at the ranges' ends."""
    of = (keys >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(keys), np.int64)
    starts = np.flatnonzero(np.concatenate([[True], of[1:] != of[:-1]])) if len(of) else np.zeros(0, np.int64)
    ends = [*starts[1:], len(keys)]
    return pa.RecordBatch.from_arrays(
        [pa.array(of[starts]), pa.array([keys[a:b].tobytes() for a, b in zip(starts, ends, strict=False)], pa.binary()), pa.array([counts[a:b].tobytes() for a, b in zip(starts, ends, strict=False)], pa.binary())],
        ["part", "keys", "counts"],
    )


def _chunks(candidates: DataFrame) -> DataFrame:
    """Rows (cid, text, repeated) packed into chunks of bounded size, each with an id of its own."""

    def make():
        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            pack = lambda c: pa.array([batch.column(c).to_pylist()], pa.list_(batch.column(c).type))
            return pa.RecordBatch.from_arrays([pa.array([secrets.randbits(62)], pa.int64()), pack("cid"), pack("text"), pack("repeated")], ["chunk", "cids", "texts", "repeated"])

        return step

    return map_slices(candidates, make, "chunk long, cids array<long>, texts array<string>, repeated array<array<long>>")


def _candidate_windows(windows: Windows, text: str, repeated: list[int]) -> tuple[list[bytes], np.ndarray, np.ndarray, np.ndarray]:
    """The words, and of all windows whose chosen run is repeated: the starts, hashes and checks."""
    words = text.encode().split()
    h = windows.words(words)
    runs, at = windows.chosen(h[0])
    starts = np.flatnonzero(np.isin(_long(runs)[at], np.array(repeated, np.int64)))
    return words, starts, windows.rolled(h[0], WINDOW)[starts], windows.rolled(h[1], WINDOW, 1)[starts]


def _repeated_windows(chunks: DataFrame, bits: int, history: DataFrame | None = None) -> DataFrame:
    """(chunk, keys, checks): the windows of a chunk's candidates that start anywhere else too, or stand in `history`."""

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        windows = Windows(2)
        for batch in batches:
            for chunk, texts, repeated in zip(*(batch.column(c).to_pylist() for c in ("chunk", "texts", "repeated")), strict=True):
                found = [_candidate_windows(windows, t, r)[2:] for t, r in zip(texts, repeated, strict=True)]
                keys, checks = np.concatenate([k for k, _ in found]), np.concatenate([c for _, c in found])
                order = np.lexsort((checks, keys))
                keys, checks = keys[order], checks[order]
                first = np.flatnonzero(np.concatenate([[True], (keys[1:] != keys[:-1]) | (checks[1:] != checks[:-1])])) if len(keys) else np.zeros(0, np.int64)
                twice = np.diff(np.append(first, len(keys))) > 1
                keys, checks = keys[first], checks[first]
                of = (keys >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(keys), np.int64)
                cuts = np.flatnonzero(np.concatenate([[True], of[1:] != of[:-1]])) if len(of) else np.zeros(0, np.int64)
                spans = list(zip(cuts, [*cuts[1:], len(keys)], strict=False))
                if spans:
                    blob = lambda x: pa.array([x[a:b].tobytes() for a, b in spans], pa.binary())  # noqa: B023, E731
                    yield pa.RecordBatch.from_arrays([pa.array(of[cuts]), pa.array([chunk] * len(spans), pa.int64()), blob(keys), blob(checks), blob(twice.astype(np.uint8))], ["part", "chunk", "keys", "checks", "twice"])

    def answer(part: pa.Table) -> pa.Table:
        blobs = {c: part.column(c).to_pylist() for c in ("keys", "checks", "twice")}
        keys, checks, twice = _u64(blobs["keys"]), _u64(blobs["checks"]), np.frombuffer(b"".join(blobs["twice"]), np.uint8)
        order = np.lexsort((checks, keys))
        k, c = keys[order], checks[order]
        first = np.flatnonzero(np.concatenate([[True], (k[1:] != k[:-1]) | (c[1:] != c[:-1])]))
        total = np.add.reduceat(1 + twice[order].astype(np.int64), first)
        often = np.empty(len(keys), bool)
        often[order] = np.repeat(total > 1, np.diff(np.append(first, len(k))))
        ends = np.cumsum([len(x) // 8 for x in blobs["keys"]])
        spans = list(zip([0, *ends[:-1]], ends, strict=True))
        out = pa.table({"chunk": part.column("chunk"), "keys": pa.array([keys[a:b][often[a:b]].tobytes() for a, b in spans], pa.binary()), "checks": pa.array([checks[a:b][often[a:b]].tobytes() for a, b in spans], pa.binary())})
        return out.filter(pa.array([bool(often[a:b].any()) and x is not None for (a, b), x in zip(spans, part.column("chunk").to_pylist(), strict=True)]))

    asked = chunks.mapInArrow(ask, "part long, chunk long, keys binary, checks binary, twice binary")
    if history is not None:
        once = F.expr("cast(repeat(chr(0), cast(length(keys) / 8 as int)) as binary)")
        asked = asked.unionByName(_recut(history, bits).select("part", F.lit(None).cast("long").alias("chunk"), "keys", "checks", once.alias("twice")))
    return asked.groupBy("part").applyInArrow(answer, "chunk long, keys binary, checks binary")


def _removed(chunks: DataFrame, repeated: DataFrame) -> DataFrame:
    """(cid, n_removed, kept_sha256, spans) for each candidate; spans are the removed words' (start, end) in words."""
    answers = repeated.groupBy("chunk").agg(F.collect_list(F.struct("keys", "checks")).alias("answers"))

    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        windows = Windows(2)
        for batch in batches:
            for row in batch.to_pylist():
                keys = _u64([x["keys"] for x in row["answers"] or []])
                checks = _u64([x["checks"] for x in row["answers"] or []])
                order = np.argsort(keys, kind="stable")
                keys, checks = keys[order], checks[order]
                out = []
                for cid, text, r in zip(row["cids"], row["texts"], row["repeated"], strict=True):
                    words, starts, k, c = _candidate_windows(windows, text, r)
                    starts = starts[_contained(k, c, keys, checks)]
                    cover = np.zeros(len(words) + 1, np.int64)
                    np.add.at(cover, starts, 1)
                    np.add.at(cover, np.minimum(starts + WINDOW, len(words)), -1)
                    gone = np.cumsum(cover)[:-1] > 0
                    edges = np.flatnonzero(np.diff(np.concatenate([[0], gone.astype(np.int8), [0]])))
                    kept = b" ".join(w for w, g in zip(words, gone.tolist(), strict=True) if not g)
                    out.append((cid, int(gone.sum()), hashlib.sha256(kept).hexdigest(), [{"start": int(a), "end": int(b)} for a, b in edges.reshape(-1, 2)]))
                cids, n, shas, spans = zip(*out, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(cids, pa.int64()), pa.array(n, pa.int64()), pa.array(shas), pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))], ["cid", "n_removed", "kept_sha256", "spans"])

    return chunks.join(answers, "chunk", "left").select("cids", "texts", "repeated", "answers").mapInArrow(remove, "cid long, n_removed long, kept_sha256 string, spans array<struct<start: long, end: long>>")


def _contained(keys: np.ndarray, checks: np.ndarray, all_keys: np.ndarray, all_checks: np.ndarray) -> np.ndarray:
    """Whether each key stands among the sorted `all_keys` together with its check; a key may stand there with several."""
    first, end = np.searchsorted(all_keys, keys), np.searchsorted(all_keys, keys, "right")
    found = end > first
    found[found] = all_checks[first[found]] == checks[found]
    for i in np.flatnonzero((end - first > 1) & ~found):
        found[i] = (all_checks[first[i] : end[i]] == checks[i]).any()
    return found


def substring_dedup(docs: DataFrame, batches: int = BATCHES, index: FingerprintIndex | None = None) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256, spans for each row of `docs` (doc_id, text).

    Every word covered by a window of 35 words that also starts anywhere else, the same row included, is removed;
    all windows are judged on the input. spans has the removed stretches as (start, end) in words. kept_sha256 is that of the kept
    words joined by one space. Null and empty texts, and texts of fewer words, lose nothing. Rows that repeat an id are
    rows of their own, as are rows without id. An empty table gives an empty result; other columns are ignored. The table
    is added to `index` (default: a new one, which is not kept) in `batches` parts. Windows of the tables of earlier calls with
    the same index count as starting elsewhere; those calls' results stay as they are.
    """
    spark = docs.sparkSession
    ship_package(spark)
    rows = materialize(fingerprints(docs.select("doc_id", "text")), "sub-rows", None)
    no_id: Column = F.col("doc_id").isNull()
    grouped = rows.where(F.col("n_words") >= WINDOW).groupBy("words_sha").agg(F.min(F.struct(no_id.alias("none"), "doc_id", "print")).alias("first"), F.count("*").alias("members"), F.first("chosen").alias("chosen"))
    classes = materialize(grouped.select(F.monotonically_increasing_id().alias("cid"), "words_sha", F.col("first.doc_id").alias("rep"), F.col("first.print").alias("rep_print"), "members", "chosen"), "sub-classes")
    lasting = index is not None
    index = index if lasting else FingerprintIndex(spark)
    found = [index.add(classes.where(F.pmod(F.xxhash64("words_sha"), F.lit(batches)) == b)) for b in range(batches)]
    repeated = materialize(reduce(DataFrame.unionByName, found).groupBy("fingerprint").agg(F.max("times").alias("times")), "sub-repeated")
    hits = split_join(classes.select("cid", F.explode("chosen").alias("fingerprint")), repeated, ["fingerprint"], "times")
    hits = materialize(hits.groupBy("cid").agg(F.collect_set("fingerprint").alias("repeated")), "sub-hits")
    release(repeated, *found)

    # Classes with several members lose all words whatever the others have, but the others' windows must find theirs.
    reps = materialize(classes.join(hits.select("cid"), "cid", "left_semi").select("cid", F.col("rep").alias("i"), F.col("rep_print").alias("p")), "sub-reps")
    source = docs.select(F.col("doc_id").alias("doc_i"), F.xxhash64("text").alias("doc_p"), "text")
    few = small(reps)
    texts = source.join(few, source["doc_i"].eqNullSafe(few["i"]) & (source["doc_p"] == few["p"])).select("cid", "text").dropDuplicates(["cid"])
    chunks = materialize(_chunks(texts.join(hits, "cid").select("cid", "text", "repeated")), "sub-chunks", None)
    n = hits.agg(F.sum(F.size("repeated"))).first()[0] or 0
    bits = max((n * 8 // PART).bit_length(), index.window_bits)
    lost = materialize(_removed(chunks, _repeated_windows(chunks, bits, index.windows)), "sub-removed", None)
    if lasting:
        index.remember(docs)
    else:
        index.drop()

    per_class = classes.select("words_sha", "cid", "members").join(lost, "cid", "left").select("words_sha", "members", F.col("n_removed").alias("gone"), F.col("kept_sha256").alias("sha"), F.col("spans").alias("cut"))
    per_class = materialize(per_class, "sub-classes-removed")
    release(classes, hits, reps, chunks, lost)
    rows = rows.drop("chosen", "print")
    long = split_join(rows.where(F.col("n_words") >= WINDOW), per_class.withColumn("times", F.col("members")), ["words_sha"], "times")
    none = F.lit(None)
    short = rows.where(F.col("n_words") < WINDOW).select("*", F.lit(1).cast("long").alias("members"), none.cast("long").alias("gone"), none.cast("string").alias("sha"), none.cast(per_class.schema["cut"].dataType).alias("cut"))
    all_gone = F.col("members") > 1
    whole = F.array(F.struct(F.lit(0).cast("long").alias("start"), F.col("n_words").alias("end")))
    none = F.expr("cast(array() as array<struct<start: bigint, end: bigint>>)")
    return long.unionByName(short).select(
        "doc_id",
        "n_words",
        F.when(all_gone, F.col("n_words")).otherwise(F.coalesce("gone", F.lit(0))).alias("n_removed"),
        F.when(all_gone, F.lit(hashlib.sha256(b"").hexdigest())).otherwise(F.coalesce("sha", "words_sha")).alias("kept_sha256"),
        F.when(all_gone, whole).otherwise(F.coalesce("cut", none)).alias("spans"),
    )
