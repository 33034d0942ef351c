"""Stages on repeated rows, repeated ids and null ids."""

import corpus_pipeline
from ravenna.llm import exact_dedup, near_dedup

SCHEMA = "doc_id long, text string, source string"
A = " ".join(f"a{i}" for i in range(60))
NEAR = A + " end"
B = " ".join(f"b{i}" for i in range(60))
C = " ".join(f"c{i}" for i in range(60))


def left(df) -> list[tuple]:
    return sorted((r.doc_id is None, r.doc_id or 0, r.text or "") for r in df.collect())


def test_drop_copies_leaves_one_row_of_each_text(spark):
    rows = [(1, "a b c d", "x"), (1, "a  b c d", "y"), (1, "e f g h", "x"), (3, "i j", "x"), (5, "i j", "x"), (5, "k l", "x"), (None, "a b c d", "x"), (None, None, "x"), (2, None, "x"), (None, "m", "x"), (None, "m", "y")]
    docs = spark.createDataFrame(rows, SCHEMA)
    kept = exact_dedup.drop_copies(docs)
    assert kept.columns == docs.columns
    found = [(i, " ".join(t.split())) for _, i, t in left(kept)]
    assert found == [(1, "a b c d"), (1, "e f g h"), (2, ""), (3, "i j"), (5, "k l"), (0, "m")]
    assert exact_dedup.drop_copies(docs.limit(0)).count() == 0
    clash = exact_dedup.drop_copies(docs.withColumnRenamed("source", "__row"))
    assert clash.columns == ["doc_id", "text", "__row"] and {r["__row"] for r in clash.collect()} <= {"x", "y"}


def test_drop_near_copies_leaves_one_row_of_each_group(spark):
    rows = [(0, A, "x"), (5, NEAR, "x"), (5, B, "x"), (7, C, "x"), (7, C, "y"), (None, C + " end", "x"), (None, "n " * 9, "x"), (None, "n " * 9, "y"), (8, None, "x"), (None, "", "x")]
    docs = spark.createDataFrame(rows, SCHEMA)
    kept = near_dedup.drop_near_copies(docs)
    assert kept.columns == docs.columns
    assert left(kept) == [(False, 0, A), (False, 5, B), (False, 7, C), (False, 8, ""), (True, 0, ""), (True, 0, "n " * 9)]


def test_quality_stage_leaves_columns_of_its_names_alone(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet").limit(60).selectExpr("doc_id", "text", "lang", "source", "n_chars", "concat('s', doc_id) as score", "-doc_id as Held_Out")
    kept = corpus_pipeline.quality(spark, docs, small)
    assert kept.columns == docs.columns
    rows = kept.collect()
    assert rows and all((r.score, r["Held_Out"]) == (f"s{r.doc_id}", -r.doc_id) for r in rows)


def test_pipeline_on_odd_rows_and_none(spark, small, tmp_path):
    """Nulls, empty texts, repeated rows and ids, and columns that other stages use, through all stages."""
    import hashlib

    base = spark.read.parquet(f"{small}/documents.parquet").limit(40)
    odd = spark.createDataFrame([(None, "no id " * 9, None, None, None), (700, None, "en", "s", 0), (701, "", None, "s", 0), (702, A, "en", "s", 1), (702, A, "en", "s", 1), (702, B, "en", "s", 1), (703, NEAR, "en", "s", 1), (None, NEAR, "en", "s", 1)], base.schema)
    docs = base.unionByName(odd).selectExpr("*", "1 as score", "2 as held_out", "3 as __gone", "4 as __row", "5 as cid", "6 as item_id")
    for k, rows in enumerate((docs, docs.limit(0))):
        sf = tmp_path / str(k)
        rows.write.parquet(str(sf / "documents.parquet"))
        for t in ("labels", "benchmark"):
            spark.read.parquet(f"{small}/{t}.parquet").write.parquet(str(sf / f"{t}.parquet"))
        now = spark.read.parquet(str(sf / "documents.parquet"))
        for name, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, now, str(sf))
            assert out.columns == docs.columns
            kept = out.collect()
            now = spark.createDataFrame(kept, docs.schema)
            texts = [" ".join((r.text or "").split()) for r in kept]
            if name in ("exact", "near"):
                assert len(set(texts)) == len(texts) and (k == 1 or sum(t in (A, NEAR) for t in texts) == (2 if name == "exact" else 1))
            assert all((r.score, r.held_out, r["__gone"], r["__row"], r.cid, r.item_id) == (1, 2, 3, 4, 5, 6) for r in kept)
        last = corpus_pipeline.run(spark, str(sf)).collect()
        assert sorted(r.decoded_sha256 for r in last) == sorted(hashlib.sha256((r.text or "").encode()).hexdigest() for r in now.collect())
        assert (k == 1) == (not last)
