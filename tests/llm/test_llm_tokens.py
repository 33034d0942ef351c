"""Encoding, decoding and counting against the libraries."""

import base64
import hashlib

import numpy as np
import public_tokenizers as P
import pytest
import sentencepiece
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from ravenna.llm import bpe, token_counts
from ravenna.llm._arrow import small_file

RANKS, MODEL = P.path("byte_bpe_multi_50k.tiktoken"), P.path("piece_bpe_32k.model")
DATA = small_file(RANKS)
LIBRARY = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks={base64.b64decode(a): int(b) for a, b in map(bytes.split, DATA.splitlines())}, special_tokens={})
ODD = ["", " ", "  ", "a", "\x1c\x1d hello\x1c", "<|endoftext|> it's", " \n\n x  y\t\t", "日本語テキスト" * 60, "x" * 3000, "ab" * 400, " ​　 a", "😀👍🏽 é", "1234567890" * 40, "▁▁x a▁b", "<s> </s> <unk> <0x0A>", "a  b   c ", "trail "]


def ids(encoded: bytes) -> list[int]:
    return np.frombuffer(encoded, "<u4").tolist()


@pytest.fixture(scope="module")
def encoder():
    return bpe.Encoder(bpe.ranks_from(DATA), P.PATTERN)


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=MODEL)


def test_encode_matches_library_and_round_trips(encoder):
    for text, got in zip(ODD, encoder.encode_all(ODD), strict=True):
        assert ids(got) == LIBRARY.encode_ordinary(text)
        assert bpe.Decoder(DATA).decode(np.array(ids(got), np.int64)) == text.encode()


@settings(max_examples=150, deadline=None)
@given(st.text(max_size=300))
def test_any_text(text):
    encoder = bpe.Encoder(bpe.ranks_from(DATA), P.PATTERN)
    assert ids(encoder.encode_all([text])[0]) == LIBRARY.encode_ordinary(text)
    counter = token_counts.counter_from(small_file(MODEL))
    assert counter.total(text) == len(sentencepiece.SentencePieceProcessor(model_file=MODEL).encode(text)) if "\0" not in text else True


def test_lanes_and_single_trees_agree():
    ranks = bpe.ranks_from(DATA)
    pieces = [b"straightforwardness", b"abcabcabcabcabc", bytes(range(128, 250)), b"zz", b" antidisestablishmentarianism"]
    for p in pieces:
        assert ids(bpe.encode_lanes([p], 256, ranks)[0]) == bpe.encode_one(p, ranks)


def test_bounded_dictionary_starts_anew(encoder, monkeypatch):
    monkeypatch.setattr(bpe, "CACHE_ENTRIES", 8)
    texts = [f"word{i} other{i * 7} more" for i in range(30)]
    assert [ids(x) for x in encoder.encode_all(texts)] == [LIBRARY.encode_ordinary(t) for t in texts]


def test_very_long_text_in_blocks(encoder, monkeypatch):
    monkeypatch.setattr(bpe, "BLOCK", 50)
    text = "some words, and more of them. " * 40
    assert ids(encoder.encode_all([text])[0]) == LIBRARY.encode_ordinary(text)


def test_bpe_frames(spark):
    rows = [(1, None, "x"), (2, "", "x"), (3, "hello wörld", "x"), (3, "hello wörld", "y"), (None, "no id", "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    out = bpe.bpe_decode(bpe.bpe_encode(docs, RANKS, P.PATTERN), RANKS).collect()
    assert sorted((r.doc_id or 0, r.n_tokens, bytes(r.decoded).decode()) for r in out) == sorted((i or 0, len(LIBRARY.encode_ordinary(t or "")), t or "") for i, t, _ in rows)
    once = bpe.bpe_encode(docs, RANKS, P.PATTERN, decode=True).collect()
    assert sorted(map(str, once)) == sorted(map(str, out))
    assert bpe.bpe_encode(docs.limit(0), RANKS, P.PATTERN).count() == 0


def test_counts_match_library(library):
    counter = token_counts.counter_from(small_file(MODEL))
    for text in ODD:
        assert counter.total(text) == len(library.encode(text)), text
        ends, counts = counter.prefixes(text)
        for e, n in zip(ends, counts, strict=True):
            if e > 0:
                assert n == len(library.encode(text[:e]))


def test_pairs_agree_with_plain_merging(library):
    import random

    counter = token_counts.counter_from(small_file(MODEL))
    rng = random.Random(6)
    for text in ODD[2:]:
        counter.total(text)
    pieces = [p for p in counter.score if len(p) < 5]
    pairs = [*counter.pairs, *((rng.choice(pieces), rng.choice(pieces)) for _ in range(3000))]
    for a, b in pairs:
        assert not a or counter.merged(a) != [a] or counter.follows(a, b) == (counter.merged(a + b) == ([a, b] if a else [b])), (a, b)


def test_every_prefix_of_a_word(library):
    counter = token_counts.counter_from(small_file(MODEL))
    word = "antidisestablishmentarianism"
    assert counter.table("▁" + word)[2:] == [len(library.encode(word[:k])) for k in range(1, len(word) + 1)]


def test_budget_cut_is_the_longest_prefix(library):
    counter = token_counts.counter_from(small_file(MODEL))
    text = "Truncation answers follow from the table, without another encoding 日本 at all."
    for budget in (0, 1, 3, 7, 12, 100):
        cut = counter.within(text, budget)
        assert len(library.encode(text[:cut])) <= budget
        assert cut == len(text) or all(len(library.encode(text[: cut + k])) > budget for k in range(1, min(4, len(text) - cut) + 1))


def test_token_count_frames(spark):
    docs = spark.createDataFrame([(1, None, 0), (2, "", 0), (3, "two words", 0), (3, "two words", 0), (None, "x", 0)], "doc_id long, text string, n_tokens int")
    out = token_counts.token_counts(docs, MODEL, budget=1, prefixes=True).collect()
    assert sorted((r.doc_id or 0, r.n_bytes, r.n_tokens) for r in out) == [(0, 1, 1), (1, 0, 0), (2, 0, 0), (3, 9, 2), (3, 9, 2)]
    assert {tuple(r.counts) for r in out if r.doc_id == 3} == {(1, 2)}
    assert token_counts.token_counts(docs.limit(0), MODEL).count() == 0


def test_queries_match_libraries(spark, small, library):
    from ravenna.llm import queries

    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{small}/documents.parquet").collect()}
    for r in queries.op1_bpe_segment_tree(spark, small).collect():
        want = LIBRARY.encode_ordinary(texts[r.doc_id])
        assert (r.n_tokens, r.ids_sha256) == (len(want), hashlib.sha256(np.array(want, "<u4").tobytes()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()
    for r in queries.op8_prefix_token_counts(spark, small).collect():
        assert (r.n_bytes, r.n_tokens) == (len(texts[r.doc_id].encode()), len(library.encode(texts[r.doc_id])))
