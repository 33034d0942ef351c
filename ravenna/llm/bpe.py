"""Byte-level BPE encoding and decoding.

A text is split by the tokenizer's pattern and each match is encoded by itself. A segment tree over the byte positions
of a match stores, in every node, the leftmost minimum pair rank below it. The root names the next merge; the merge
touches its own leaf, its right neighbour's and its left neighbour's, so it costs three logarithmic point updates on
live neighbours, and a match of n bytes O(n log n).

Short matches are encoded many at a time, each in a lane of one array of trees; long ones have a tree of their own. Each
task keeps the codes of the matches it has seen in a dictionary of bounded size.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache
from itertools import islice

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ravenna.llm._arrow import map_slices, small_file, texts_of

#: White space as Unicode's property has it; the pattern language of the reference tokenizer uses that set.
WHITE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: Matches kept in a task's dictionary, bytes of the longest one kept there, and matches taken at a time from one text.
CACHE_ENTRIES, CACHE_BYTES, BLOCK = 300_000, 64, 1 << 20
#: Lanes are 8 to 256 bytes wide; longer matches have a tree of their own.
WIDTHS = (8, 16, 32, 64, 256)
NONE = np.iinfo(np.int64).max


def compiled(pattern: str) -> regex.Pattern:
    return regex.compile(pattern.replace(r"[^\s", "[^" + WHITE).replace(r"\S", f"[^{WHITE}]").replace(r"\s", f"[{WHITE}]"))


class Ranks:
    """A rank file's tokens, and the rank that each pair of tokens merges into."""

    def __init__(self, data: bytes):
        self.ids = {base64.b64decode(a): int(b) for a, b in (line.split() for line in data.splitlines() if line)}
        self.of_byte = np.array([self.ids[bytes([b])] for b in range(256)], np.int64)
        get, found = self.ids.get, {}
        for token, n in self.ids.items():
            for i in range(1, len(token)):
                if (a := get(token[:i])) is not None and (b := get(token[i:])) is not None:
                    found[a << 32 | b] = n
        self.pair = found
        self.keys = np.fromiter(found.keys(), np.int64, len(found))
        order = np.argsort(self.keys)
        self.keys = self.keys[order]
        self.into = np.fromiter(found.values(), np.int64, len(found))[order]

    def merged(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Ranks of the merged pairs, -1 where a pair doesn't merge."""
        key = (left << 32) | right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.into[at], -1)


class Decoder:
    """A rank file's tokens by their ids."""

    def __init__(self, data: bytes):
        ids = {int(b): base64.b64decode(a) for a, b in (line.split() for line in data.splitlines() if line)}
        tokens = [ids.get(n, b"") for n in range(max(ids) + 1)]
        self.sizes = np.array([len(t) for t in tokens], np.int64)
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.blob = np.frombuffer(b"".join(tokens), np.uint8)

    def decode(self, ids: np.ndarray) -> bytes:
        sizes = self.sizes[ids]
        ends = np.cumsum(sizes)
        total = int(ends[-1]) if len(ids) else 0
        return self.blob[np.repeat(self.starts[ids] - (ends - sizes), sizes) + np.arange(total)].tobytes()

    def decode_packed(self, ids: bytes) -> bytes:
        return self.decode(np.frombuffer(ids, "<u4").astype(np.int64))


@lru_cache(maxsize=1)
def ranks_from(data: bytes) -> Ranks:
    return Ranks(data)


@lru_cache(maxsize=1)
def decoder_from(data: bytes) -> Decoder:
    return Decoder(data)


def encode_one(piece: bytes, ranks: Ranks) -> list[int]:
    """One match, in a segment tree of its own."""
    n = len(piece)
    width = 1 << max(0, n - 1).bit_length()
    token = [int(ranks.of_byte[b]) for b in piece]
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    get, none = ranks.pair.get, (1 << 62, 0)
    tree = [none] * (2 * width)
    for i in range(n - 1):
        r = get(token[i] << 32 | token[i + 1])
        if r is not None:
            tree[width + i] = (r, i)
    for k in range(width - 1, 0, -1):
        tree[k] = min(tree[2 * k], tree[2 * k + 1])

    def put(i: int) -> None:
        """The leaf of position i, then its ancestors as far as they change."""
        j = after[i]
        r = get(token[i] << 32 | token[j]) if token[i] >= 0 and j < n else None
        k, value = width + i, none if r is None else (r, i)
        tree[k] = value
        while k > 1:
            k >>= 1
            value = min(tree[2 * k], tree[2 * k + 1])
            if tree[k] == value:
                break
            tree[k] = value

    while tree[1] != none:
        rank, i = tree[1]
        j = after[i]
        token[i], token[j] = rank, -1
        after[i] = after[j]
        if after[i] < n:
            before[after[i]] = i
        put(j)
        put(i)
        if before[i] >= 0:
            put(before[i])
    return [t for t in token if t >= 0]


def encode_lanes(pieces: list[bytes], width: int, ranks: Ranks) -> list[bytes]:
    """Matches of at most `width` bytes, each in a lane of its own; the ids as little-endian unsigned 32-bit integers."""
    m, shift = len(pieces), width.bit_length() - 1
    sizes = np.fromiter(map(len, pieces), np.int64, m)
    live = np.arange(width) < sizes[:, None]
    raw = np.frombuffer(b"".join(p.ljust(width, b"\0") for p in pieces), np.uint8).reshape(m, width)
    token = np.where(live, ranks.of_byte[raw], -1)
    after = np.broadcast_to(np.arange(1, width + 1), (m, width)).copy()
    before = after - 2
    tree = np.full((m, 2 * width), NONE)
    first = ranks.merged(token[:, :-1], token[:, 1:])
    tree[:, width:-1] = np.where((first >= 0) & live[:, 1:], (first << shift) | np.arange(width - 1), NONE)
    for k in range(width - 1, 0, -1):
        tree[:, k] = np.minimum(tree[:, 2 * k], tree[:, 2 * k + 1])

    def put(lane: np.ndarray, at: np.ndarray, value: np.ndarray) -> None:
        node = width + at
        tree[lane, node] = value
        for _ in range(shift):
            node = node >> 1
            tree[lane, node] = np.minimum(tree[lane, 2 * node], tree[lane, 2 * node + 1])

    def pair(lane: np.ndarray, at: np.ndarray) -> np.ndarray:
        nxt = after[lane, at]
        r = ranks.merged(token[lane, at], token[lane, np.minimum(nxt, width - 1)])
        return np.where((r >= 0) & (nxt < sizes[lane]), (r << shift) | at, NONE)

    lane = np.arange(m)
    while len(lane := lane[tree[lane, 1] != NONE]):
        root = tree[lane, 1]
        at = root & (width - 1)
        gone = after[lane, at]
        token[lane, at], token[lane, gone] = root >> shift, -1
        nxt = after[lane, gone]
        after[lane, at] = nxt
        has = nxt < sizes[lane]
        before[lane[has], nxt[has]] = at[has]
        put(lane, gone, np.full(len(lane), NONE))
        put(lane, at, pair(lane, at))
        prev = before[lane, at]
        has = prev >= 0
        put(lane[has], prev[has], pair(lane[has], prev[has]))
    kept = token >= 0
    flat, ends = token[kept].astype("<u4").tobytes(), np.cumsum(kept.sum(1)) * 4
    return [flat[a:b] for a, b in zip([0, *ends[:-1].tolist()], ends.tolist(), strict=True)] if m else []


def encode_pieces(pieces: list[bytes], ranks: Ranks) -> list[bytes]:
    """Ids of each match as little-endian unsigned 32-bit integers. A match that is a token is that token."""
    out: list[bytes] = [b""] * len(pieces)
    lanes: dict[int, list[int]] = {}
    for i, p in enumerate(pieces):
        if (whole := ranks.ids.get(p)) is not None:
            out[i] = whole.to_bytes(4, "little")
        else:
            lanes.setdefault(next((w for w in WIDTHS if len(p) <= w), 0), []).append(i)
    for width, rows in lanes.items():
        if width:
            for k in range(0, len(rows), some := max(1, (1 << 19) // width)):
                part = rows[k : k + some]
                for i, ids in zip(part, encode_lanes([pieces[i] for i in part], width, ranks), strict=True):
                    out[i] = ids
        else:
            for i in rows:
                out[i] = np.array(encode_one(pieces[i], ranks), "<u4").tobytes()
    return out


class Encoder:
    """Texts to ids, remembering the codes of matches."""

    def __init__(self, ranks: Ranks, pattern: str, entries: int | None = None):
        self.ranks, self.find, self.known, self.entries = ranks, compiled(pattern), {}, entries or CACHE_ENTRIES

    def blocks(self, text: str) -> Iterator[list[str]]:
        if len(text) <= BLOCK:
            yield self.find.findall(text)
        else:
            found = (m.group() for m in self.find.finditer(text))
            while block := list(islice(found, BLOCK)):
                yield block

    def learn(self, pieces: set[str]) -> dict[str, bytes]:
        """The codes of all `pieces`; the dictionary starts anew when it would grow over its bound."""
        known = self.known
        new = [p for p in pieces if p not in known]
        if len(known) + len(new) > self.entries:
            known.clear()
            new = list(pieces)
        codes = dict(zip(new, encode_pieces([p.encode() for p in new], self.ranks), strict=True))
        if any(len(p) > CACHE_BYTES for p in new):
            known.update((p, c) for p, c in codes.items() if len(p) <= CACHE_BYTES)
            return {p: codes.get(p) or known[p] for p in pieces}
        known.update(codes)
        return known

    def encode_all(self, texts: list[str]) -> list[bytes]:
        if sum(map(len, texts)) <= BLOCK * 4 and all(len(t) <= BLOCK for t in texts):
            split = [self.find.findall(t) for t in texts]
            codes = self.learn(set().union(*split))
            return [b"".join(map(codes.__getitem__, pieces)) for pieces in split]
        return [b"".join(b"".join(map(self.learn(set(block)).__getitem__, block)) for block in self.blocks(t)) for t in texts]


def bpe_encode(docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", decode: bool = False, cache_entries: int | None = None) -> DataFrame:
    """doc_id, n_tokens, ids for each row of `docs`: ids as little-endian unsigned 32-bit integers in one binary value.

    With `decode` also `decoded`, what bpe_decode makes of the ids, without sending them to another Python worker.

    Ids are those of the tiktoken library without special tokens; their strings in a text are ordinary text. Null and empty
    texts have no tokens. Repeated rows are encoded each; null ids stay null; other columns are ignored. `cache_entries` bounds
    the matches that a task remembers (default: CACHE_ENTRIES); it changes no id.
    """
    data = docs.sparkSession.sparkContext.broadcast(small_file(ranks_path))

    def make():
        encoder = Encoder(ranks_from(data.value), pattern, cache_entries)
        decoder = decoder_from(data.value) if decode else None

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            ids = encoder.encode_all(texts_of(batch))
            out = {"doc_id": batch.column("doc_id"), "n_tokens": pa.array([len(x) // 4 for x in ids], pa.int64()), "ids": pa.array(ids, pa.binary())}
            if decode:
                out["decoded"] = pa.array([decoder.decode_packed(x) for x in ids], pa.binary())
            return pa.RecordBatch.from_pydict(out)

        return step

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return map_slices(rows, make, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, n_tokens long, ids binary" + ", decoded binary" * decode)


def bpe_decode(encoded: DataFrame, ranks_path: str) -> DataFrame:
    """`encoded` (doc_id, n_tokens, ids) with `decoded`, the bytes that the ids stand for; null ids decode to none."""
    data = encoded.sparkSession.sparkContext.broadcast(small_file(ranks_path))

    def make():
        decoder = decoder_from(data.value)

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            decoded = [decoder.decode_packed(x or b"") for x in batch.column("ids").to_pylist()]
            return pa.RecordBatch.from_arrays([*batch.columns, pa.array(decoded, pa.binary())], [*batch.schema.names, "decoded"])

        return step

    rows = encoded.select("doc_id", "n_tokens", "ids")
    return map_slices(rows, make, ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema) + ", decoded binary", text="ids")
