"""Exact token counts at every prefix by dynamic programming.

The encoding of a prefix ends in one token, and what stands before that token is the encoding of a shorter prefix. A
token t can end the encoding of a prefix when it is a suffix of it and the pair (last token before t, t) is itself an
encoding: merging the two tokens' characters gives those two tokens back. Exactly one token qualifies, so
count[i] = count[i - len(t)] + 1 fills the table from left to right.

The table answers truncation and budget questions without another encoding: the tokens of any prefix, and the longest
prefix within a budget. No token crosses from a character into a following space mark, so tables are kept for each
space-led word and shared between texts; the words' totals are summed to prefixes of the text.
"""

from __future__ import annotations

import math
import re
import string
from bisect import bisect_right
from functools import lru_cache
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ravenna.llm._arrow import map_slices, small_file, texts_of

SPACE = "▁"
#: Words, pairs of tokens and beginnings of words remembered in a Python worker; characters of the longest such word and of a
#: beginning. The caches only save time.
CACHE_WORDS, CACHE_PAIRS, CACHE_HEADS, CACHE_CHARS, HEAD = 500_000, 500_000, 60_000, 64, 6


class PrefixCounter:
    """The DP tables of one SentencePiece BPE model."""

    def __init__(self, model: bytes):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_proto=model)
        n = sp.get_piece_size()
        self.score = {sp.id_to_piece(i): sp.get_score(i) for i in range(n) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i))}
        self.fallback = any(sp.is_byte(i) for i in range(n))
        if not self.fallback or any(sp.is_unused(i) for i in range(n)) or len(sp.encode(" a")) == len(sp.encode("a")):
            raise ValueError("a BPE model with byte fallback, a space prefix and no unused pieces is needed")
        probe = "ﬁ Ａ  é\t\n "
        if sp.decode(sp.encode(probe)) != probe:
            raise ValueError("a model that doesn't normalise texts is needed")
        long = [p for p in self.score if len(p) > 1]
        self.longest = max(map(len, long))
        if any(re.search(f"[^{SPACE}]{SPACE}", p) for p in long):
            raise ValueError("the model has pieces across spaces")
        lone = "".join(c for c in "\n\t\r" if not any(c in p for p in long))
        apart = "".join(c for c in string.punctuation if not any(re.search(rf"[^\W\d_]{re.escape(c)}", p) for p in long))
        inside, letter = f"[^{SPACE}{lone}]", r"[^\W\d_]"
        # Up to a letter before a mark that no piece has after a letter; else up to the next space mark or lone character.
        ends = f"(?=[{re.escape(apart)}{SPACE}{lone}]|$)"
        self.words = re.compile(rf"{SPACE}*{inside}*?{letter}{ends}|{SPACE}*{inside}+|{SPACE}+" + (f"|[{lone}]" if lone else ""))
        self.count, self.pairs, self.heads, self.ends = {}, {}, {}, {}

    def merged(self, text: str) -> list[str]:
        """Plain BPE of a short string: the best-scored pair merges first, the leftmost of equals."""
        parts, score = list(text), self.score
        while len(parts) > 1:
            best = max(((score[a + b], -i) for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False)) if a + b in score), default=None)
            if best is None:
                break
            i = -best[1]
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return parts

    def edges(self, token: str) -> tuple[bool, list[tuple[str, float]], list[tuple[str, float]]]:
        """Whether `token` is its own encoding, and the parts at its right and its left end while it is built.

        Each part comes with the score of the merge that ends it.
        """
        known = self.ends.get(token)
        if known is None:
            nodes: list[tuple] = [(c, None, None) for c in token]
            while len(nodes) > 1:
                best = max(((self.score[x[0] + y[0]], -i) for i, (x, y) in enumerate(zip(nodes, nodes[1:], strict=False)) if x[0] + y[0] in self.score), default=None)
                if best is None:
                    break
                i = -best[1]
                nodes[i : i + 2] = [(nodes[i][0] + nodes[i + 1][0], nodes[i], nodes[i + 1])]
            sides = []
            for side in (2, 1):
                found, node, ends = [], nodes[-1 if side == 2 else 0], -math.inf
                while node:
                    found.append((node[0], ends))
                    ends, node = self.score.get(node[0], 0.0), node[side]
                sides.append(found)
            known = self.ends[token] = (len(nodes) == 1, *sides)
        return known

    def follows(self, a: str, b: str) -> bool:
        """Whether token b can come straight after token a, which is empty at the start.

        It can unless a part at a's right end merges with one at b's left end before either is merged inward. Of equal scores
        the left merge comes first.
        """
        known = self.pairs.get((a, b))
        if known is None:
            if len(self.pairs) >= CACHE_PAIRS:
                self.pairs.clear()
            known, get = self.edges(b)[0], self.score.get
            if a and known:
                for x, x_ends in self.edges(a)[1]:
                    for y, y_ends in self.edges(b)[2]:
                        if (s := get(x + y)) is not None and s > x_ends and s >= y_ends:
                            known = False
            self.pairs[a, b] = known
        return known

    def table(self, word: str) -> list[int]:
        """The exact count of tokens of each prefix of `word`, by its length."""
        return self.filled(word)[0]

    def filled(self, word: str) -> tuple[list[int], list[str]]:
        """Counts and last tokens of the prefixes. Words that begin alike go on from the same rows of the table."""
        head = word[:HEAD]
        if len(word) > HEAD:
            known = self.heads.get(head)
            if known is None:
                if len(self.heads) >= CACHE_HEADS:
                    self.heads.clear()
                known = self.heads[head] = self.filled(head)
            count, last = known[0].copy(), known[1].copy()
        else:
            count, last = [0], [""]
        score, pairs, longest = self.score, self.pairs, self.longest
        for i in range(len(count), len(word) + 1):
            for j in range(max(0, i - longest), i):
                token = word[j:i]
                if token in score or j == i - 1:
                    fits = pairs.get((last[j], token))
                    if fits or (fits is None and self.follows(last[j], token)):
                        count.append(count[j] + (1 if token in score else len(token.encode())))
                        last.append(token)
                        break
            else:
                raise RuntimeError(f"no token ends the encoding of {word[:i]!r}")
        return count, last

    def of_word(self, word: str) -> int:
        known = self.count.get(word)
        if known is None:
            known = self.table(word)[-1]
            if len(word) <= CACHE_CHARS:
                if len(self.count) >= CACHE_WORDS:
                    self.count.clear()
                self.count[word] = known
        return known

    def split(self, text: str) -> list[str]:
        return self.words.findall(SPACE + text.replace(" ", SPACE)) if text else []

    def prefixes(self, text: str) -> tuple[list[int], list[int]]:
        """Ends of the text's prefixes at word ends, in characters, and the exact count of tokens of each."""
        words = self.split(text)
        ends = accumulate(map(len, words))
        return [e - 1 for e in ends], list(accumulate(map(self.of_word, words)))

    def total(self, text: str) -> int:
        get, of_word = self.count.get, self.of_word
        return sum(n if (n := get(w)) is not None else of_word(w) for w in self.split(text))

    def within(self, text: str, budget: int) -> int:
        """Characters of the longest prefix that has at most `budget` tokens and whose longer word ends don't."""
        ends, counts = self.prefixes(text)
        k = bisect_right(counts, budget)
        if k == len(counts):
            return len(text)
        start, before = (ends[k - 1], counts[k - 1]) if k else (-1, 0)
        inner = self.table(self.split(text)[k])
        return max(0, start + max(i for i, n in enumerate(inner) if before + n <= budget))


@lru_cache(maxsize=2)
def counter_from(model: bytes) -> PrefixCounter:
    return PrefixCounter(model)


def token_counts(docs: DataFrame, model_path: str, budget: int | None = None, prefixes: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_tokens for each row of `docs`, counted as the SentencePiece library does by default.

    With `budget`, also `cut`: the characters of the longest prefix with at most that many tokens. With `prefixes`, also
    `ends` and `counts`: the prefixes at word ends, in characters, and the exact count of tokens of each. Null and empty
    texts have none. Repeated rows are counted each; null ids stay null; other columns are ignored.
    """
    data = docs.sparkSession.sparkContext.broadcast(small_file(model_path))

    def make():
        counter = counter_from(data.value)

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            texts = texts_of(batch)
            out = {"doc_id": batch.column("doc_id"), "n_bytes": pa.array([len(t.encode()) for t in texts], pa.int64()), "n_tokens": pa.array(map(counter.total, texts), pa.int64())}
            if budget is not None:
                out["cut"] = pa.array([counter.within(t, budget) for t in texts], pa.int64())
            if prefixes:
                tables = [counter.prefixes(t) for t in texts]
                out["ends"] = pa.array([np.array(e, np.int64) for e, _ in tables], pa.list_(pa.int64()))
                out["counts"] = pa.array([np.array(c, np.int64) for _, c in tables], pa.list_(pa.int64()))
            return pa.RecordBatch.from_pydict(out)

        return step

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    schema = f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, n_bytes long, n_tokens long" + ", cut long" * (budget is not None) + ", ends array<long>, counts array<long>" * prefixes
    return map_slices(rows, make, schema)
