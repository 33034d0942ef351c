"""Substring deduplication against the tables of earlier calls."""

import hashlib
import random

import pytest
from test_llm_copies import brute_removed

from ravenna.llm import substring_dedup


@pytest.mark.parametrize("part", [1 << 18, 64])
def test_a_passage_of_an_earlier_table_is_removed(spark, monkeypatch, part):
    monkeypatch.setattr(substring_dedup, "PART", part)
    rng = random.Random(3)
    some = lambda n: " ".join(rng.choices([f"w{i}" for i in range(300)], k=n))
    passage = some(50)
    old = {0: some(40) + " " + passage, 1: some(60), 2: some(20)}
    new = {10: passage + " " + some(30), 11: old[1], 12: some(70), 13: old[2]}
    index = substring_dedup.FingerprintIndex(spark)
    table = lambda d: spark.createDataFrame(list(d.items()), "doc_id long, text string")
    assert {r.n_removed for r in substring_dedup.substring_dedup(table(old), 1, index).collect()} == {0}
    want = brute_removed(old | new)
    rows = substring_dedup.substring_dedup(table(new), 1, index).collect()
    assert {r.doc_id: r.n_removed for r in rows} == {i: len(t.split()) - len(want[i]) for i, t in new.items()} and sum(r.n_removed for r in rows) >= 110
    assert all(r.kept_sha256 == hashlib.sha256(b" ".join(want[r.doc_id])).hexdigest() for r in rows)
