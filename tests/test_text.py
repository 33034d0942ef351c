import hashlib
import re
import unicodedata

import pytest
from pyspark.sql import functions as F

from ravenna.errors import ConfigError
from ravenna.functions import text as T
from ravenna.operators import chunking as C

ODD = ["", " ", "Olá, mundo_1!", "áb", "naïve x²", "x  y\n\tz ", "ﬁm Ａ９", "٣٤ e 日本", "  lead", "a.b,c"]


def frame(spark, texts):
    return spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, text string")


def column(df, value):
    return [r[0] for r in df.orderBy("i").select(value).collect()]


def test_lexical_tokens_are_unicode_words(spark):
    got = column(frame(spark, [*ODD, None]), T.lexical_tokens(F.col("text")))
    assert got == [re.findall(r"\w+", t.lower()) for t in ODD] + [[]]


def test_compatibility_form_comes_first(spark):
    got = column(frame(spark, ODD), T.lexical_tokens(F.col("text"), compatibility=True))
    assert got == [re.findall(r"\w+", unicodedata.normalize("NFKC", t).lower()) for t in ODD]


def test_reference_count(spark):
    assert column(frame(spark, ODD), T.token_count(F.col("text"))) == [len(re.findall(r"\w+|[^\w\s]", t)) for t in ODD]


def test_hashes_numbers_templates(spark):
    df = spark.createDataFrame([(0, "á", 1.23456, "{b}")], "i int, text string, x double, y string")
    row = df.select(T.sha256(F.col("text")).alias("h"), T.fixed(F.col("x")).alias("f"), T.fixed(F.lit(None).cast("double")).alias("n"), T.fixed(F.lit(float("nan")), 6).alias("q"), T.filled("{a}+{b}", a=F.col("y"), b=F.col("text")).alias("t"), T.short_hash(T.sha256(F.col("text"))).alias("s")).first()
    full = hashlib.sha256("á".encode()).hexdigest()
    assert (row.h, row.s, row.f, row.n, row.q) == (full, full[:12], "1.2346", "—", "—")
    assert row.t == "á+á"


HEADINGS = {
    "# Title": "Title",
    "### Deep ##": "Deep",
    "#tight": "tight",
    "2.1 Methods of work": "2.1 Methods of work",
    "12 patients were": "12 patients were",
    "12 patients were.": None,
    "1. " + "x" * 100: None,
    "Resumo": "Resumo",
    "RESULTADOS:": "RESULTADOS",
    "Related Work": "Related Work",
    "ALL CAPITALS HERE": "ALL CAPITALS HERE",
    "A" * 79: "A" * 79,
    "A" * 80: None,
    "Plain text line": None,
    "": None,
    "1234": None,
}


def test_headings(spark):
    assert column(frame(spark, list(HEADINGS)), T.heading(F.col("text"))) == list(HEADINGS.values())


def sliding(text: str, target: int, overlap: int) -> list[str]:
    spans = [m.span() for m in re.finditer(r"\w+|[^\w\s]", text)]
    if not spans:
        return []
    if len(spans) <= target:
        return [text]
    out, start = [], 0
    while True:
        end = min(start + target, len(spans))
        out.append(text[spans[start][0] : spans[end - 1][1]])
        if end == len(spans):
            return out
        start = end - overlap


@pytest.mark.parametrize("target,overlap", [(7, 2), (5, 0), (3, 2), (1, 0)])
def test_windows(spark, target, overlap):
    texts = [" ".join(map(str, range(n))) + "  " for n in range(25)] + ODD + ["wörd, " * 30]
    rows = C.with_windows(frame(spark, texts), "text", target, overlap)
    got = column(rows, F.transform("pieces", lambda p: p["piece"]))
    assert got == [sliding(t, target, overlap) for t in texts]
    assert column(rows, F.transform("pieces", lambda p: p["tokens"])) == column(rows, F.transform("pieces", lambda p: T.token_count(p["piece"])))


def test_chunks_are_tokenised_once(spark):
    plan = C.chunk_blocks(blocks(spark, ("one two", "text")), 2, 0)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_extract_all(") == 1 and "regexp_extract_all" not in plan[plan.index("lambdafunction") : plan.index("lambdafunction") + 400]


def test_overlap_must_be_less(spark):
    with pytest.raises(ConfigError):
        C.with_windows(frame(spark, [""]), "text", 5, 5)


def blocks(spark, *texts):
    rows = [("d", f"d-b{i:04d}", 1, None, m, t, "h") for i, (t, m) in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id string, block_id string, page int, section string, modality string, text string, source_block_hash string")


def test_chunk_ids_keep_gaps_and_widen(spark):
    out = C.chunk_blocks(blocks(spark, ("one two three", "text"), ("a b c d e", "table"), ("", "visual")), 2, 0).orderBy("chunk_id").collect()
    assert [r.chunk_id for r in out] == ["d-b0000-c000", "d-b0000-c001", "d-b0001-c000", "d-b0001-c001", "d-b0001-c002"]
    assert [r.token_count_ref for r in out] == [2, 1, 2, 2, 1] and out[2].modality == "table"
    assert spark.range(1).select(F.format_string("%s-c%03d", F.lit("x"), F.lit(12345))).first()[0] == "x-c12345"


def test_whole_block_is_split_anew_at_the_limit(spark):
    words = lambda text: [m.span() for m in re.finditer(r"\S+", text)]
    tight = C.Limit("tight", 5, words, "t t {text}")
    free = C.Limit("free", None, words)
    wide = C.Limit("wide", 50, words)
    assert C.binding([free, wide, tight]).name == "tight" and C.binding([free]) is None
    assert C.binding([wide, C.Limit("w2", 50, words)]).name == "wide"
    ten = " ".join("abcdefghij")
    assert C.split_to_limit(ten, tight, 0) == ["a b c", "d e f", "g h i", "j"]
    out = C.fit_to_limit(blocks(spark, (ten, "text"), ("a b", "text")), [free, wide, tight], 20, 0)
    assert [r.text for r in out.orderBy("chunk_id").collect()] == ["a b c", "d e f", "g h i", "j", "a b"]
    assert [r.token_count_ref for r in out.orderBy("chunk_id").collect()] == [3, 3, 3, 1, 2]
    assert [tuple(r) for r in C.subdivided_blocks(blocks(spark, (ten, "text"), ("a b", "text")), [free, wide, tight], 20, 0).collect()] == [("d", "d-b0000")]
    assert C.subdivided_blocks(blocks(spark, (ten, "text")), [free]).count() == 0
    assert C.overflow(out, [tight, wide]).count() == 0
    over = C.overflow(C.chunk_blocks(blocks(spark, (ten, "text"))), [tight, wide])
    assert [(r.model, r.tokens) for r in over.collect()] == [("tight", 12)]
    known = spark.createDataFrame([("tight", 5), ("free", None)], "model string, limit int")
    assert {(r.model, r.limit_known, r.overflow_chunks) for r in C.overflow_summary(over, known).collect()} == {("tight", True, 1), ("free", False, 0)}
    summary = C.overflow_summary(over, known)
    assert {tuple(r) for r in C.merged_reports(summary.unionByName(summary)).collect()} == {("tight", 5, True, 2), ("free", None, False, 0)}


def test_limit_of_a_tokenizer_file():
    import pickle

    offsets = pickle.loads(pickle.dumps(C.FileTokenizer("/opt/tokenizers/byte_bpe_50k.json")))
    text = "Olá, mundo! " * 3
    spans = offsets(text)
    assert spans[0][0] == 0 and "".join(text[a:b] for a, b in spans) == text.strip() + " " and offsets.special() == 0
    model = C.Limit("m", 6, offsets, "{text}", 2)
    assert model.count("") == 2 and all(model.count(p) <= 6 for p in C.split_to_limit(text, model, 0))


def test_corpus_version_is_that_of_canonical_json(spark):
    from ravenna.artifacts import hash_json

    rows = [("c2", "d", 'quote " and \\'), ("c1", "d", "açã\n")]
    df = spark.createDataFrame(rows, "chunk_id string, doc_id string, text string")
    want = hash_json([{"chunk_id": c, "doc_id": d, "text": t} for c, d, t in sorted(rows)])
    assert C.corpus_version(df).first()[0] == want
    digests = {C.corpus_digest(df.repartition(n)).first()[0] for n in (1, 3)}
    assert len(digests) == 1 and digests != {C.corpus_digest(df.limit(1)).first()[0]}
