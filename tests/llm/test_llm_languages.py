"""Many languages, and what the reader takes from beyond a word."""

import numpy as np
from pyspark.sql import functions as F

from ravenna.llm import _sample, language


def test_every_labelled_language_is_learnt(spark, monkeypatch):
    rows = [(k * 10 + i, f"word{k} text{i}", f"l{k}") for k in range(70) for i in range(8)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    sample = _sample.labelled_sample(docs, docs, "lang", F.lit(True), 3, 1 << 15)
    assert len({y for _, y in sample}) == 70 and len(sample) == 210
    monkeypatch.setattr(_sample, "MOST_TEXTS", 140)
    assert len(_sample.labelled_sample(docs, docs, "lang", F.lit(True), 3, 1 << 15)) == 140
    out = language.identify_language(docs, steps=2).limit(1).collect()
    assert len(out[0].probabilities) == 70


def test_what_stands_apart_is_learnt():
    """Two languages with the same words, told apart only by a letter far from the text's start."""
    same = "x" * 3 * language.SEGMENT
    reader = language.fit_language([(f"{same}{'a' * 300}", "one"), (f"{same}{'b' * 300}", "two")], 80)
    p = reader.documents([(same + "a" * 300).encode(), (same + "b" * 300).encode()])
    assert list(p.argmax(1)) == [0, 1] and np.ptp(p[0]) > 0.1


def test_state_is_carried_over_white_space():
    """The same words in another order: only reading across spaces tells them apart."""
    reader = language.fit_language([("a b c " * 300, "one"), ("a c b " * 300, "two")], 400)
    p = reader.documents([b"a b c " * 50, b"a c b " * 50])
    assert list(p.argmax(1)) == [0, 1]
