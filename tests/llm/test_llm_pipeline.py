"""The pipeline against a plain version of each stage on its own input."""

import hashlib

import corpus_pipeline
from ravenna.llm import decontaminate, near_dedup


def test_stages_on_their_own_inputs(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = {r.doc_id: r.text for r in docs.collect()}
        out = stage(spark, docs, small)
        assert out.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        docs = spark.createDataFrame(out.collect(), out.schema)
        after = {r.doc_id for r in docs.collect()}
        assert after <= set(before)
        if name == "exact":
            first = {}
            for i in sorted(before):
                first.setdefault(" ".join(before[i].split()), i)
            assert after == set(first.values())
        if name == "near":
            sets = {i: near_dedup.shingles(near_dedup.words_of(t), 5) for i, t in before.items()}
            gone = set(before) - after
            assert all(any(j < i and near_dedup.linked(sets[i], sets[j], 80) for j in before) or any(near_dedup.linked(sets[i], sets[j], 80) for j in before if j != i) for i in gone)
            assert not any(near_dedup.linked(sets[i], sets[j], 80) for i in after for j in after if i < j)
        if name == "leaks":
            items = [decontaminate.plain(r.text) for r in spark.read.parquet(f"{small}/benchmark.parquet").collect()]
            assert set(before) - after >= {i for i, t in before.items() if any(x in decontaminate.plain(t) for x in items)}
        if name == "quality":
            labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{small}/labels.parquet").collect()}
            kept = [i in after for i in before if labels.get(i) == 1]
            assert sum(kept) >= 0.95 * len(kept)
    last = corpus_pipeline.STAGES[-1][1](spark, docs, small).collect()
    texts = {r.doc_id: r.text for r in docs.collect()}
    assert {r.doc_id: r.decoded_sha256 for r in last} == {i: hashlib.sha256(t.encode()).hexdigest() for i, t in texts.items()}
    assert sorted(r.doc_id for r in corpus_pipeline.run(spark, small).collect()) == sorted(texts)
