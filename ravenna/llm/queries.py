"""The registered queries of this subpackage, each a thin digest of its operator's output, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_bpe_segment_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids and decoded bytes of every text, as digests."""
    import public_tokenizers

    from ravenna.llm.bpe import bpe_encode

    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    out = bpe_encode(table(spark, sf_dir, "documents"), path, public_tokenizers.PATTERN, decode=True)
    return out.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op2_fingerprint_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ravenna.llm.substring_dedup import substring_dedup

    return substring_dedup(table(spark, sf_dir, "documents")).select("doc_id", "n_words", "n_removed", "kept_sha256")


def op3_ring_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shards 0 to 7 under the law `rows`: counts at most one apart."""
    from ravenna.llm.sharding import bounded_load_shards

    out = bounded_load_shards(table(spark, sf_dir, "documents"), shards=8)
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op4_minmax_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents whose sets of two-word shingles have a similarity of 0.8 or more."""
    from ravenna.llm.near_dedup import near_dedup

    return near_dedup(table(spark, sf_dir, "documents"), shingle_words=2, percent=80)


def op5_pigeonhole_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with passages of the benchmark, and which items."""
    from ravenna.llm.decontaminate import find_leaks

    return find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).select("doc_id", "item_id", "distance")


def op6_neighbour_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ravenna.llm.quality import quality_scores

    out = quality_scores(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels"))
    return out.select("doc_id", "held_out", "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"))


def op7_byte_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ravenna.llm.language import identify_language

    return identify_language(table(spark, sf_dir, "documents")).select("doc_id", "held_out", "lang_pred", "score")


def op8_prefix_token_counts(spark: SparkSession, sf_dir: str, limit: int = 4096) -> DataFrame:
    import public_tokenizers

    from ravenna.llm.token_counts import token_counts

    out = token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))
    return out.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ravenna.llm.exact_dedup import exact_dedup

    return exact_dedup(table(spark, sf_dir, "documents"))


def op10_toxicity_network(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ravenna.llm.toxicity import DECISION, toxicity_scores

    out = toxicity_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return out.select("doc_id", "held_out", "score", F.when(F.col("score") >= DECISION, 1).otherwise(0).alias("predicted"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, f in sorted(globals().items()) if name.startswith("op") and callable(f)}


#: A document's words, unchanged; and its lower-case words, of which only A to Z are changed.
WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"
LOWER = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+')"

SQL = {
    "op2_fingerprint_runs": f"""
        with d as (select row_number() over () as r, doc_id, {WORDS} as w from documents),
        starts as (select r, w, unnest(range(1, len(w) - 33)) as p from d where len(w) >= 35),
        windows as (select r, p, array_to_string(w[p:p + 34], ' ') as words from starts),
        repeated as (select words from windows group by words having count(*) > 1),
        gone as (select distinct r, unnest(range(p, p + 35)) as p from windows semi join repeated using (words)),
        each as (select r, unnest(w) as word, unnest(range(1, len(w) + 1)) as p from d),
        kept as (select r, string_agg(word, ' ' order by p) as text from each anti join gone using (r, p) group by r),
        lost as (select r, count(*) as n from gone group by r)
        select doc_id, len(w) as n_words, coalesce(n, 0) as n_removed, sha256(coalesce(kept.text, '')) as kept_sha256
        from d left join kept using (r) left join lost using (r)""",
    "op4_minmax_near_dedup": f"""
        with recursive d as (select doc_id, {LOWER} as w from documents),
        sets as (select doc_id, list_distinct(case when len(w) = 0 then []::varchar[] when len(w) = 1 then w else list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) end) as s from d),
        each as (select doc_id, len(s) as n, unnest(s) as shingle from sets),
        pairs as (select a.doc_id as x, b.doc_id as y, a.n as n, b.n as m, count(*) as shared from each a join each b on a.shingle = b.shingle and a.doc_id < b.doc_id and 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n) group by 1, 2, 3, 4),
        links as (select x, y from pairs where 100 * shared >= 80 * (n + m - shared)),
        edges as (select x, y from links union all select y, x from links),
        reach as (select doc_id as x, doc_id as y from sets union select r.x, e.y from reach r join edges e on e.x = r.y),
        least_of as (select x, min(y) as component_id from reach group by x)
        select doc_id, len(s) as n_shingles, component_id, doc_id = component_id as kept from sets join least_of on x = doc_id""",
    "op9_exact_dedup": r"""
        with d as (select doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') as t from documents),
        g as (select t, min(doc_id) as keep_id, count(*) as group_size from d group by t)
        select d.doc_id, g.keep_id, g.group_size, d.doc_id = g.keep_id as kept, sha256(d.t) as text_sha256
        from d join g on d.t = g.t""",
}


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
