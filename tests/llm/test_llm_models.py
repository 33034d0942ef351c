"""Quality, language and toxicity: held-out accuracy, gradients, and odd rows."""

import zlib

import numpy as np
import pytest

from ravenna.llm import language, quality, toxicity

ODD = [(None, "no id", "en"), (900001, None, "en"), (900002, "", None), (900003, "12 34 !?", "en"), (900004, "the " * 30000, "en")]
SF = "/root/testdata/sf0.1"


@pytest.fixture(scope="module")
def tables(spark):
    return {t: spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels")}


def held_out(rows, labels: dict) -> list[tuple]:
    return [(r, labels[r.doc_id]) for r in rows if r.held_out and r.doc_id in labels]


def labels_of(tables, name: str) -> dict:
    return {r.doc_id: r[name] for r in tables["labels"].collect()}


def test_quality_on_held_out_rows(tables):
    rows = quality.quality_scores(tables["documents"].select("doc_id", "text"), tables["labels"]).select("doc_id", "held_out", "score").collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and 0 <= r.score <= 1 for r in rows)
    pairs = held_out(rows, labels_of(tables, "quality"))
    assert np.mean([(r.score >= 0.5) == bool(y) for r, y in pairs]) > 0.98
    assert np.mean([r.score < 0.5 for r, y in pairs if not y]) > 0.95


def test_language_on_held_out_rows(tables):
    rows = language.identify_language(tables["documents"]).collect()
    truth = {r.doc_id: r.lang for r in tables["documents"].collect()}
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1 for r in rows)
    assert np.mean([r.lang_pred == y for r, y in held_out(rows, truth)]) > 0.98


def test_toxicity_on_held_out_rows(tables):
    rows = toxicity.toxicity_scores(tables["documents"], tables["labels"]).collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and 0 <= r.score <= 1 for r in rows)
    pairs = held_out(rows, labels_of(tables, "toxic"))
    assert np.mean([(r.score >= toxicity.DECISION) == bool(y) for r, y in pairs]) > 0.97
    lang = {r.doc_id: r.lang for r in tables["documents"].select("doc_id", "lang").collect()}
    for one in ("en", "de", "fr", "es"):  # of each language: caught, and left alone
        own = [(r.score >= toxicity.DECISION, y) for r, y in pairs if lang[r.doc_id] == one]
        assert np.mean([p for p, y in own if y]) > 0.8 and np.mean([p for p, y in own if not y]) < 0.1


def test_odd_rows(spark, tables):
    odd = spark.createDataFrame(ODD, "doc_id long, text string, lang string")
    docs = tables["documents"].select("doc_id", "text", "lang").limit(800).unionByName(odd).withColumnRenamed("doc_id", "doc_id")
    got = {r.doc_id: r for r in language.identify_language(docs, steps=20).collect()}
    assert got[900001].lang_pred == got[900002].lang_pred == got[900003].lang_pred == "und" and got[900001].score == 0
    assert not got[None].held_out and got[None].lang_pred != "und"
    assert quality.quality_scores(docs, tables["labels"], per_class=50).count() == 805
    scores = {r.doc_id: r.score for r in toxicity.toxicity_scores(docs, tables["labels"], per_class=50).collect()}
    assert len(scores) == 805 and scores[900001] == scores[900002]


def test_without_labels_or_rows(spark, tables):
    docs = tables["documents"].select("doc_id", "text", "lang").limit(5)
    none = tables["labels"].limit(0)
    assert {r.score for r in quality.quality_scores(docs, none).collect()} == {0.5}
    assert {r.score for r in toxicity.toxicity_scores(docs, none).collect()} == {0.0}
    assert {r.lang_pred for r in language.identify_language(docs, docs.limit(0)).collect()} == {"und"}
    assert quality.quality_scores(docs.limit(0), tables["labels"], per_class=20).count() == 0


def test_learns_from_no_held_out_row(spark, tables):
    from pyspark.sql import functions as F

    docs, labels = tables["documents"].select("doc_id", "text").limit(1500), tables["labels"]
    turned = labels.withColumn("quality", F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, 1 - F.col("quality")).otherwise(F.col("quality")))
    a, b = ({r.doc_id: r.score for r in quality.quality_scores(docs, x, per_class=100).collect()} for x in (labels, turned))
    assert a == b


def in_doubles(weights_of) -> None:
    """Numerical differences need more digits than the models keep."""
    for way in weights_of.ways:
        way.table, way.back = way.table.astype(np.float64), way.back.astype(np.float64)
    weights_of.out, weights_of.bias = weights_of.out.astype(np.float64), weights_of.bias.astype(np.float64)


def slope(loss, weights, at, e=1e-5) -> float:
    old = weights[at]
    weights[at] = old + e
    up = loss()
    weights[at] = old - e
    down = loss()
    weights[at] = old
    return (up - down) / (2 * e)


def test_gradients_of_the_recurrent_network():
    rng = np.random.default_rng(0)
    reader = language.ByteReader(["a", "b", "c"], hidden=3)
    in_doubles(reader)
    raw, y = rng.integers(97, 103, (5, 4)), rng.integers(0, 3, 4)
    _, grads = reader.gradients(raw, y)
    for weights, grad in zip(reader.weights(), grads, strict=True):
        places = [tuple(rng.integers(0, n) for n in weights.shape) for _ in range(8)]
        places += [(k, 98, 1) for k in range(3)] if weights.ndim == 3 and weights.shape[1] == 256 else []
        for at in places:
            assert abs(slope(lambda: reader.gradients(raw, y)[0], weights, at) - grad[at]) < 1e-6


def test_gradients_of_the_convolutional_network():
    rng = np.random.default_rng(1)
    net = toxicity.Network()
    net.table = net.table.astype(np.float64) * 5
    net.filters, net.shift = [f.astype(np.float64) for f in net.filters], [s.astype(np.float64) + 0.1 for s in net.shift]
    net.last, net.by_length = net.last.astype(np.float64), np.array([0.1, -0.2])
    rows = [toxicity.table_rows([f"w{k}" for k in rng.integers(0, 30, n)]) for n in (9, 4, 1, 0)]
    y, force = np.array([1.0, 0, 1, 0]), np.array([1.0, 2, 0.5, 1])
    loss = lambda: net.gradients(rows, y, force)[0]
    _, grads, at, moved = net.gradients(rows, y, force)
    for weights, grad in zip(net.weights(), grads, strict=True):
        for place in [tuple(rng.integers(0, n) for n in weights.shape) for _ in range(8)]:
            assert abs(slope(loss, weights, place) - grad[place]) < 1e-5
    for k in rng.integers(0, len(at), 12):
        assert abs(slope(loss, net.table, (at[k], 3)) - moved[k, 3]) < 1e-5


def plain_language(reader, text: bytes) -> np.ndarray:
    """Every stretch by itself, a byte at a time."""
    total = np.zeros(len(reader.languages))
    sigmoid = lambda x: 1 / (1 + np.exp(-x))

    def read(way, raw):
        h, out = np.zeros(way.back.shape[1]), []
        for b in raw:
            z, r = (sigmoid(way.table[k][b] + h @ way.back[k]) for k in (0, 1))
            h = h + z * (np.tanh(way.table[2][b] + (r * h) @ way.back[2]) - h)
            out.append(h)
        return out

    for start in range(0, len(text), language.SEGMENT):
        own = text[start : start + language.SEGMENT]
        before, after = text[max(0, start - language.CONTEXT) : start], text[start + language.SEGMENT : start + language.SEGMENT + language.CONTEXT]
        raw = before.rjust(language.CONTEXT) + own + after
        raw = raw.ljust(language.SEGMENT + 2 * language.CONTEXT)
        ahead, behind = read(reader.ways[0], raw), read(reader.ways[1], raw[::-1])[::-1]
        for t in range(language.CONTEXT, language.CONTEXT + len(own)):
            x = np.concatenate([ahead[t], behind[t]]) @ reader.out + reader.bias
            total += np.exp(x - x.max()) / np.exp(x - x.max()).sum()
    return total / max(1e-9, total.sum())


def test_stretches_are_read_as_one_by_one(monkeypatch):
    reader = language.ByteReader(["a", "b", "c"], hidden=4)
    texts = [b"", b"one two", bytes(range(1, 250)) * 4, b"x" * language.SEGMENT, b"y " * language.SEGMENT]
    monkeypatch.setattr(language, "SEGMENT", 40)
    whole = reader.documents(texts)
    monkeypatch.setattr(language, "LANES", 3)
    monkeypatch.setattr(language, "MOST_NUMBERS", 20)
    assert np.allclose(reader.documents(texts), whole, atol=1e-5) and whole[0].sum() == 0
    # the last lanes are cut after their own bytes, so what lies beyond a text's end is nothing rather than more spaces
    for t, p in zip(texts[2:3], whole[2:3], strict=True):
        assert np.allclose(plain_language(reader, t), p, atol=0.02)


def test_language_query_against_reading_one_by_one(spark, small):
    from pyspark.sql import functions as F

    from ravenna.llm import queries
    from ravenna.llm._sample import fold, labelled_sample

    docs = spark.read.parquet(f"{small}/documents.parquet")
    reader = language.fit_language(labelled_sample(docs, docs, "lang", fold(F.col("doc_id"), 4) != 2, language.PER_LANGUAGE, language.MAX_BYTES))
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    got = {r.doc_id: r for r in queries.op7_byte_language(spark, small).collect()}
    for i in [i for i, t in texts.items() if 200 < len(t.encode()) < 1500][:12]:
        p = plain_language(reader, texts[i].encode())
        assert reader.languages[int(p.argmax())] == got[i].lang_pred and abs(p.max() - got[i].score) < 0.02


def test_quality_query_against_all_cosines(spark, small):
    from pyspark.sql import functions as F

    from ravenna.llm import queries
    from ravenna.llm._sample import fold, labelled_sample

    docs, labels = spark.read.parquet(f"{small}/documents.parquet"), spark.read.parquet(f"{small}/labels.parquet")
    sample = labelled_sample(docs, labels, "quality", fold(F.col("doc_id"), 3) != 1, quality.PER_CLASS, quality.MAX_BYTES, [0, 1])
    votes = quality.fit_quality(sample)
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    for r in queries.op6_neighbour_quality(spark, small).collect():
        x = votes.weighted(quality.terms(texts[r.doc_id])[None])[0].astype(float) @ votes.axes.astype(float)
        cosines = [float(np.dot(x, v) / max(1e-9, np.linalg.norm(x))) for v in votes.vectors.astype(float)]
        last = sorted(cosines)[-min(quality.NEIGHBOURS, len(cosines))]
        force = [max(c, 1e-3) ** 8 * float(w) if c >= last - 1e-6 else 0.0 for c, w in zip(cosines, votes.balance, strict=True)]
        want = sum(f for f, y in zip(force, votes.labels, strict=True) if y) / sum(force)
        assert abs(want - r.score) < 0.02 and r.predicted == int(r.score >= 0.5)


def test_toxicity_query_against_every_place(spark, small):
    from ravenna.llm import queries

    docs, labels = spark.read.parquet(f"{small}/documents.parquet"), spark.read.parquet(f"{small}/labels.parquet")
    held: list = []
    fit = toxicity.fit_toxicity
    toxicity.fit_toxicity = lambda sample: held.append(fit(sample)) or held[-1]
    try:
        got = {r.doc_id: r for r in toxicity.toxicity_scores(docs, labels).collect()}
    finally:
        toxicity.fit_toxicity = fit
    model, net = held[0], held[0].network
    for r in docs.collect()[:40]:
        words = toxicity.split(r.text or "")
        e = [net.table[p].sum(0).astype(float) for p in toxicity.table_rows(words)] if words else []
        best = []
        for width, f, b in zip(toxicity.WIDTHS, net.filters, net.shift, strict=True):
            parts = f.astype(float).reshape(width, toxicity.WIDE, toxicity.FILTERS)
            at = [sum((e[i + k] @ parts[k] for k in range(width) if i + k < len(e)), b.astype(float)) for i in range(len(e))]
            best.append(np.max([*at, np.zeros(toxicity.FILTERS)], axis=0))
        x = float(np.concatenate(best) @ net.last + net.by_length[0] * np.log1p(len(e)) + net.by_length[1])
        p, t = 1 / (1 + np.exp(-x)), 1 / (1 + np.exp(-model.cuts[model.guess([r.text or ""])[0]]))
        want = p / t * 0.7 if p < t else 0.7 + (p - t) / (1 - t) * 0.3
        assert abs(want - got[r.doc_id].score) < 1e-3
    assert all(abs(r.score - got[r.doc_id].score) < 1e-9 and r.predicted == int(r.score >= 0.7) for r in queries.op10_toxicity_network(spark, small).collect())


def test_long_documents_are_pooled_in_blocks(monkeypatch):
    net = toxicity.Network()
    e = np.random.default_rng(2).standard_normal((100, toxicity.WIDE)).astype(np.float32)
    whole = net.pooled(e)
    for block in (1, 7, 99):
        monkeypatch.setattr(toxicity, "BLOCK", block)
        assert np.allclose(net.pooled(e), whole, atol=1e-6)


def test_both_hashes_must_agree():
    a, b = toxicity.table_rows(["Clown", "clown,"]), toxicity.table_rows(["clown"])
    assert (a[1] == b[0]).all() and toxicity.table_rows(["..."]).sum() == 0


def test_thresholds_lean_on_the_overall_one():
    logits, y = np.array([-2.0] * 30 + [1.0] * 30), np.array([0] * 30 + [1] * 30)
    assert -2 < toxicity.Model.cut(logits, y) < 1
    own, few = toxicity.Model.leaning(logits, y, 5.0), toxicity.Model.leaning(logits[29:31], y[29:31], 5.0)
    assert toxicity.Model.cut(logits, y) < own < few < 5 and toxicity.Model.leaning(logits[:9], y[:9], 5.0) == 5.0


def test_repeated_rows_ties_and_clashing_columns(spark, tables):
    some = tables["documents"].limit(30)
    docs = some.unionByName(some).selectExpr("doc_id", "text", "lang", "doc_id as score", "text as held_out", "1 as probabilities", "2 as i", "3 as label")
    for out in (quality.quality_scores(docs, tables["labels"], per_class=60), toxicity.toxicity_scores(docs, tables["labels"], per_class=60), language.identify_language(docs, tables["documents"].limit(200), steps=5)):
        by: dict = {}
        for r in out.collect():
            by.setdefault(r.doc_id, []).append(r.score)
        assert len(by) == 30 and all(len(x) == 2 and x[0] == x[1] and 0 <= x[0] <= 1 for x in by.values())
