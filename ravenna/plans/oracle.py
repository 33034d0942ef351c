"""SQL of the registered queries, independent of the DataFrame plans, for a second engine over the same tables."""

from __future__ import annotations

#: Fixed values, stated here once more so that the plans are checked against them.
K1, B, TOP_N, K_VALUES, MRR_K = 1.2, 0.75, 50, (1, 5, 10), 10
COMMON_SECTIONS = (
    "resumo", "abstract", "introdução", "introducao", "introduction",
    "métodos", "metodos", "methods", "materiais e métodos",
    "materiais e metodos", "materials and methods", "resultados", "results",
    "discussão", "discussao", "discussion", "conclusão", "conclusao",
    "conclusion", "conclusões", "conclusoes", "referências", "referencias",
    "references", "bibliografia", "agradecimentos", "acknowledgements",
    "trabalhos relacionados", "related work", "avaliação", "avaliacao",
    "experimentos", "experiments", "limitações", "limitacoes",
)
READY = "READY_FOR_HUMAN_REVIEW"

WORD = r"[\p{L}\p{N}_]+"
TILE = r"[\s\pZ]*(?:[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s\pZ])"

CHUNKS = "chunks as (select cast(doc_id as varchar) as chunk_id, text, source as doc_id from documents)"
QUESTIONS = "questions as (select cast(item_id as varchar) as question_id, text, 'src' || (item_id % 25) as origin_doc_id, substr(text, 1, 20) as expected_answer, item_id as n from benchmark)"
QRELS = "qrels as (select question_id, chunk_id from chunks, questions where contains(chunks.text, questions.text))"
GOLD = "gold as (select question_id, count(*) as n_relevant from qrels group by 1)"
TOKENS = f"tokens as (select chunk_id, unnest(regexp_extract_all(lower(text), '{WORD}')) as term from chunks)"
POSTINGS = "postings as (select chunk_id, term, count(*) as tf from tokens group by 1, 2)"
LENGTHS = f"lengths as (select chunk_id, len(regexp_extract_all(lower(text), '{WORD}')) as doc_len from chunks)"
TERMS = "terms as (select term, count(*) as df from postings group by 1)"
STATS = "stats as (select count(*) as n_docs, avg(doc_len) as avgdl, sum(doc_len) as total_tokens from lengths)"
BASE = ", ".join((CHUNKS, QUESTIONS, TOKENS, POSTINGS, LENGTHS, TERMS, STATS))


def _bm25(k1: float = K1, b: float = B, top: int = TOP_N) -> str:
    return f"""{BASE},
        asked as (select question_id, term, count(*) as times from (select question_id, unnest(regexp_extract_all(lower(trim(text)), '{WORD}')) as term from questions) group by 1, 2),
        bm25_scores as (
            select question_id, p.chunk_id, round(sum(ln((n_docs - df + 0.5::double) / (df + 0.5::double) + 1) * times * tf * ({k1}::double + 1) / (tf + {k1}::double * (1 - {b}::double + {b}::double * doc_len / avgdl))), 9) as score
            from asked join postings p using (term) join terms using (term) join lengths using (chunk_id), stats group by 1, 2),
        bm25 as (select * from (select *, row_number() over (partition by question_id order by score desc, chunk_id) as rank from bm25_scores where score <> 0) where rank <= {top})"""


VECTORS = """raw as (select cast(vec_id as varchar) as chunk_id, list_transform(embedding, lambda x: x::double) as v from embeddings),
        vectors as (select chunk_id, v, sqrt(list_sum(list_transform(v, lambda x: x * x))) as norm from raw)"""


def _dense(queries: str, top: int = TOP_N) -> str:
    return f"""{VECTORS},
        dense_scores as (select q.chunk_id as question_id, d.chunk_id, list_inner_product(q.v, d.v) / q.norm / d.norm as score from vectors q, vectors d where {queries}),
        dense as (select * from (select *, row_number() over (partition by question_id order by score desc, chunk_id) as rank from dense_scores) where rank <= {top})"""


QUESTION_VECTORS = "q.chunk_id in (select question_id from questions)"


def _rrf(wb: float = 1.0, wd: float = 1.0, c: float = 60, top: int = TOP_N) -> str:
    return f"""rrf as (
            select question_id, chunk_id, b.rank as bm25_rank, d.rank as dense_rank,
                round(coalesce({wb}::double / ({c}::double + b.rank), 0) + coalesce({wd}::double / ({c}::double + d.rank), 0), 9) as score
            from bm25 b full join dense d using (question_id, chunk_id)),
        united as (select *, row_number() over (partition by question_id order by score desc, chunk_id) as rank from rrf),
        fused as (select * from united where rank <= {top})"""


def _hybrid(**weights: float) -> str:
    return f"with {_bm25()}, {_dense(QUESTION_VECTORS)}, {_rrf(**weights)}"


def _reranked(name: str, base: str) -> str:
    """CTE of the rows of `base` ordered by the share of the question's words that a text has."""
    return f"""{name} as (
            select question_id, chunk_id, base_rank, score, row_number() over (partition by question_id order by score desc, chunk_id) as rank
            from (select question_id, chunk_id, base_rank, round(case when len(qw) = 0 then 0 else len(list_intersect(qw, cw)) / len(qw) end, 9) as score
                from (select b.question_id, b.chunk_id, b.rank as base_rank, list_distinct(regexp_extract_all(lower(trim(q.text)), '{WORD}')) as qw, regexp_extract_all(lower(coalesce(c.text, '')), '{WORD}') as cw from {base} b join questions q using (question_id) left join chunks c on c.chunk_id = b.chunk_id)))"""


OTHER = f"with {_bm25(2.0, 0.5, 20)}, {_dense(QUESTION_VECTORS, 20)}, {_rrf(2.0, 0.5, 10.0, 20)}, {_reranked('bm25_again', 'bm25')}, {_reranked('dense_again', 'dense')}, {_reranked('hybrid_again', 'fused')}"


def _stages() -> str:
    """All stages of the six configurations of one embedding: (config_id, question_id, stage, rank, chunk_id, ranks, scores)."""
    kinds = {
        "bm25": ("rank::int, null::int", "score, null, null"),
        "dense": ("null::int, rank::int", "score, null, null"),
        "united": ("bm25_rank::int, dense_rank::int", "score, score, null"),
        "fused": ("bm25_rank::int, dense_rank::int", "score, score, null"),
    }
    part = lambda config, stage, name: f"select '{config}' as config_id, question_id, '{stage}' as stage, rank::int as rank, chunk_id, {kinds[name][0]}, {kinds[name][1]} from {name}"
    out = []
    for config, base, lists in (("bm25", "bm25", ["bm25"]), ("dense_e5", "dense", ["dense"]), ("hybrid_e5", "fused", ["bm25", "dense", "united", "fused"])):
        names = {"united": "rrf_union", "fused": "rrf_topn"}
        for again in ("", "_rerank"):
            out += [part(config + again, names.get(x, x), x) for x in lists]
        out += [part(config, "final", base), part(config + "_rerank", "to_rerank", base)]
        ranks = {"bm25": "base_rank::int, null::int", "dense": "null::int, base_rank::int", "fused": "f.bm25_rank::int, f.dense_rank::int"}[base]
        scores = "a.score, f.score, a.score" if base == "fused" else "a.score, null, a.score"
        join = " join fused f using (question_id, chunk_id)" if base == "fused" else ""
        table = {"bm25": "bm25_again", "dense": "dense_again", "fused": "hybrid_again"}[base]
        out.append(f"select '{config}_rerank', question_id, 'final', a.rank::int, chunk_id, {ranks}, {scores} from {table} a{join}")
    return f"stages(config_id, question_id, stage, rank, chunk_id, bm25_rank, dense_rank, score, rrf_score, rerank_score) as ({' union all '.join(out)})"


RANKED = "question_id, chunk_id, rank, round(score, 6) as score"


def _metrics(lists: str = "select 'bm25' as config_id, question_id, rank, chunk_id from bm25") -> str:
    """CTEs up to `metrics` of the lists (config_id, question_id, rank, chunk_id)."""
    sums = ", ".join(f"coalesce(sum(case when hit and rank <= {k} then 1 else 0 end), 0) as hits_{k}, coalesce(sum(case when hit and rank <= {k} then 1 / log2(rank + 1) else 0 end), 0) as dcg_{k}" for k in K_VALUES)
    each = ", ".join(
        f"""hits_{k} / n_relevant as "recall@{k}", case when hits_{k} > 0 then 1.0 else 0.0 end::double as "hit@{k}",
            case when n_results = 0 then 0.0 else hits_{k} / least({k}, n_results) end::double as "precision@{k}",
            dcg_{k} / list_sum(list_transform(range(1, least({k}, n_relevant)::bigint + 1), lambda i: 1 / log2(i + 1))) as "ndcg@{k}\""""
        for k in K_VALUES
    )
    return f"""{QRELS}, {GOLD}, lists as ({lists}),
        marked as (select l.*, q.chunk_id is not null as hit from lists l left join qrels q using (question_id, chunk_id)),
        asked_all as (select config_id, question_id from (select distinct config_id from lists), questions),
        summed as (select config_id, question_id, count(rank) as n_results, min(case when hit and rank <= {MRR_K} then rank end) as first_hit, {sums} from asked_all left join marked using (config_id, question_id) group by 1, 2),
        metrics as (select config_id, question_id, n_relevant, {each}, coalesce(1.0 / first_hit, 0.0)::double as "mrr@{MRR_K}" from summed join gold using (question_id))"""


METRICS = [f"{m}@{k}" for k in K_VALUES for m in ("recall", "hit", "precision", "ndcg")] + [f"mrr@{MRR_K}"]
ROUNDED = ", ".join(f'round("{m}", 6) as "{m}"' for m in METRICS)
MEANS = ", ".join(f'round(avg("{m}"), 6) as "{m}"' for m in METRICS)
THREE = "select 'bm25' as config_id, question_id, rank, chunk_id from bm25 union all select 'dense_e5', question_id, rank, chunk_id from dense union all select 'hybrid_e5', question_id, rank, chunk_id from fused"

GROUPS = """groups as (
            select question_id || '-own' as group_id, question_id, n % 3 <> 0 as required, [question_id] as chunk_ids from questions
            union all select question_id || '-gold', question_id, true, list(chunk_id order by chunk_id) from qrels group by question_id)"""
COVERAGE = """needed as (select group_id, question_id, unnest(chunk_ids) as chunk_id from groups where required),
        totals as (select question_id, count(distinct group_id) as total from needed group by 1),
        got as (select question_id, count(distinct group_id) as covered, string_agg(distinct group_id, ',' order by group_id) as covered_ids from needed join bm25 using (question_id, chunk_id) group by 1),
        coverage as (
            select question_id, coalesce(covered, 0) as covered, coalesce(total, 0) as total, case when total > 0 then coalesce(covered, 0) / total else 0 end::double as fraction,
                coalesce(covered_ids, '') as covered_ids, coalesce(covered, 0) = coalesce(total, 0) as all_covered
            from questions left join totals using (question_id) left join got using (question_id))"""

STRIP = r"^[\s\pZ]+|[\s\pZ]+$"
SECTIONS = ", ".join(f"'{s}'" for s in COMMON_SECTIONS)
HEADING = rf"""case when s = '' then null
            when s like '#%' then case when regexp_extract(s, '^#{{1,6}}\s+(.+?)\s*#*$', 1) <> '' then trim(regexp_extract(s, '^#{{1,6}}\s+(.+?)\s*#*$', 1)) else trim(regexp_replace(s, '^#+', '')) end
            when regexp_matches(s, '^\d+(\.\d+)*\.?\s+\S') and length(s) < 100 and not regexp_matches(s, '[.,;:]$') then s
            when lower(regexp_replace(s, ':+$', '')) in ({SECTIONS}) then regexp_replace(s, ':+$', '')
            when length(s) < 80 and length(regexp_replace(s, '[^\p{{L}}]', '', 'g')) > 0
                and length(regexp_replace(s, '[^\p{{Lu}}]', '', 'g')) / length(regexp_replace(s, '[^\p{{L}}]', '', 'g')) > 0.6 then s end"""
LINES = rf"""numbered as (select doc_id, unnest(parts) as line, unnest(range(0, len(parts))) as n from (select doc_id, string_split_regex(text, '\r\n|[\n\x0b\x0c\r\x1c-\x1e\x{{85}}\x{{2028}}\x{{2029}}]') as parts from documents)),
        lines as (select doc_id, n, regexp_replace(line, '{STRIP}', '', 'g') as s from numbered),
        headed as (select doc_id, n, s, {HEADING} as heading from lines)"""


def _split(target: int, overlap: int) -> str:
    step = target - overlap
    return rf"""tiled as (select cast(doc_id as varchar) as doc_id, text, regexp_extract_all(text, '{TILE}') as tiles from documents),
        cut as (select doc_id, text, tiles, unnest(case when len(tiles) = 0 then []::bigint[] else range(0, 1 + greatest(0, cast(ceil((len(tiles) - {target}) / {step}) as bigint))) end) as place from tiled),
        pieces as (select doc_id, place, text as whole, case when len(tiles) <= {target} then text else regexp_replace(list_aggregate(tiles[place * {step} + 1 : place * {step} + {target}], 'string_agg', ''), '{STRIP}', '', 'g') end as piece from cut),
        split as (select *, len(regexp_extract_all(piece, '{TILE}')) as n_tokens from pieces where regexp_replace(piece, '{STRIP}', '', 'g') <> '')"""


EVIDENCE = """evidence as (
            select question_id, 'e' || question_id as evidence_id, origin_doc_id as doc_id, case when n % 4 <> 0 then n % 9 + 1 end as page, case when n % 6 = 0 then ' ' else expected_answer end as quote,
                case when n % 7 = 0 then [] when n % 7 = 1 then [question_id, question_id] when n % 7 = 2 then ['missing'] else [question_id] end as chunk_ids,
                case when n % 5 = 0 then question_id || case when n % 10 = 0 then '-own' else '-none' end end as required_group, n, origin_doc_id,
                case when n % 3 = 0 then 'approved' when n % 3 = 1 then 'draft' else 'rejected' end as review_status, case when n % 2 = 0 then 'multi_evidence' else 'factual' end as question_type
            from questions)"""
ARTICLES = "articles as (select distinct doc_id, 7 as pages from chunks)"
SEVERE = "case when review_status = 'approved' then 'error' else 'warning' end"
VIOLATIONS = f"""cited as (select distinct question_id, review_status, evidence_id, doc_id as evidence_doc, unnest(chunk_ids) as chunk_id from evidence),
        grouped as (select g.question_id, group_id, unnest(list_distinct(chunk_ids)) as chunk_id from groups g),
        found as (
            select 'V12' as rule, 'error' as severity, null as category from grouped where chunk_id not in (select chunk_id from chunks)
            union all select 'V13', 'error', null from grouped g where chunk_id in (select chunk_id from chunks) and not exists (select 1 from qrels q where q.question_id = g.question_id and q.chunk_id = g.chunk_id)
            union all select 'V14', 'warning', 'draft' from evidence where review_status = 'draft'
            union all select 'V15', 'error', null from evidence where origin_doc_id not in (select doc_id from articles)
            union all select 'V16', 'error', null from evidence where doc_id not in (select doc_id from articles)
            union all select 'V17', {SEVERE}, 'missing_quote' from evidence where trim(quote) = ''
            union all select 'V18', {SEVERE}, 'missing_page' from evidence where page is null
            union all select 'V19', 'error', null from evidence where page > 7 and doc_id in (select doc_id from articles)
            union all select 'V20', {SEVERE}, 'missing_evidence_chunks' from evidence where len(chunk_ids) = 0
            union all select 'V21', 'error', null from evidence where len(chunk_ids) > len(list_distinct(chunk_ids))
            union all select 'V22', 'error', null from cited where chunk_id not in (select chunk_id from chunks)
            union all select 'V23', 'error', null from cited join chunks using (chunk_id) where chunks.doc_id <> evidence_doc
            union all select 'V25', {SEVERE}, 'evidence_without_qrel' from cited c where not exists (select 1 from qrels q where q.question_id = c.question_id and q.chunk_id = c.chunk_id)
            union all select 'V26', 'error', null from evidence where required_group is not null and required_group not in (select group_id from groups)
            union all select 'V27', 'error', null from evidence e join groups g on g.group_id = e.required_group where len(list_filter(e.chunk_ids, lambda x: not list_contains(g.chunk_ids, x))) > 0
            union all select 'V28', {SEVERE}, 'missing_qrels' from evidence where question_id not in (select question_id from qrels)
            union all select 'V29', {SEVERE}, 'missing_required_groups' from evidence where question_type = 'multi_evidence' and question_id not in (select question_id from groups where required)),
        violations as (select rule, severity, case when severity = 'warning' then category end as category from found)"""
ANNOTATED = f"with {CHUNKS}, {QUESTIONS}, {QRELS}, {GROUPS}, {EVIDENCE}, {ARTICLES}, {VIOLATIONS}"

STRUCTURED = f"""with {CHUNKS}, {QUESTIONS},
        s_articles as (select distinct doc_id from chunks),
        all_articles as (select doc_id from s_articles union all select doc_id from s_articles where length(doc_id) % 2 = 0),
        s_questions as (select * from questions union all select * from questions where n % 11 = 0),
        paged as (select chunk_id, doc_id, cast(chunk_id as bigint) % 9 + 1 as page, cast(chunk_id as bigint) as c from chunks),
        moved as (select chunk_id, case when c % 50 = 43 then 'nowhere' else doc_id end as doc_id, page, c from paged),
        s_chunks as (select * from moved union all select * from moved where c % 40 = 21),
        s_evidence as (select q.question_id, q.origin_doc_id, 'e' || q.question_id as evidence_id, p.doc_id, p.page + q.n % 2 as page, q.question_id as chunk_id from s_questions q join paged p on p.chunk_id = q.question_id where q.n % 3 = 0),
        s_qrels as (
            select question_id, question_id as chunk_id from questions union all select question_id, question_id from questions where n % 7 = 0
            union all select 'none' || question_id, question_id from questions where n % 6 = 0 union all select question_id, 'lost' || question_id from questions where n % 9 = 0),
        s_groups as (
            select question_id || '-g' as group_id, question_id, true as required, [question_id] as chunk_ids from questions union all select question_id || '-g', question_id, true, [question_id] from questions where n % 8 = 0
            union all select 'x' || question_id || '-g', 'gone' || question_id, false, [question_id] from questions where n % 10 = 0 union all select question_id || '-e', question_id, true, [] from questions where n % 4 = 1
            union all select question_id || '-r', question_id, false, [question_id, question_id] from questions where n % 12 = 5 union all select question_id || '-m', question_id, false, ['no' || question_id] from questions where n % 13 = 2),
        known as (select distinct chunk_id, doc_id, page from s_chunks),
        structural as (
            select 'V1' as rule, 'error' as severity, null::varchar as category, null::varchar as question_id, doc_id as subject from all_articles group by doc_id having count(*) > 1
            union all select 'V2', 'error', null, question_id, question_id from s_questions group by question_id having count(*) > 1
            union all select 'V3', 'error', null, null, chunk_id from s_chunks group by chunk_id having count(*) > 1
            union all select 'V4', 'error', null, null, chunk_id from s_chunks where doc_id not in (select doc_id from s_articles)
            union all select 'V5', 'error', null, question_id, chunk_id from s_qrels where question_id not in (select question_id from questions)
            union all select 'V6', 'error', null, question_id, chunk_id from s_qrels where chunk_id not in (select chunk_id from known)
            union all select 'V7', 'error', null, question_id, chunk_id from s_qrels group by question_id, chunk_id having count(*) > 1
            union all select 'V8', 'error', null, null, group_id from s_groups group by group_id having count(*) > 1
            union all select 'V9', 'error', null, question_id, group_id from s_groups where question_id not in (select question_id from questions)
            union all select 'V10', case when q.n % 2 = 0 then 'error' else 'warning' end, case when q.n % 2 = 0 then null else 'empty_required_group' end, question_id, group_id from s_groups g join questions q using (question_id) where g.required and len(chunk_ids) = 0
            union all select 'V11', 'error', null, question_id, group_id from s_groups where len(chunk_ids) > len(list_distinct(chunk_ids))
            union all select 'V12', 'error', null, question_id, group_id || ' ' || chunk_id from (select question_id, group_id, unnest(list_distinct(chunk_ids)) as chunk_id from s_groups) where chunk_id not in (select chunk_id from known)
            union all select 'V24', 'error', null, question_id, evidence_id || ' ' || e.chunk_id from s_evidence e join known k on k.chunk_id = e.chunk_id where k.doc_id = e.doc_id and k.page <> e.page)"""

ENTRY = "'[ID: ' || chunk_id || ' | doc=' || doc_id || coalesce(' | página ' || page, '') || chr(93) || chr(10) || regexp_replace(text, '" + STRIP + "', '', 'g')"


def _values(rows: list[tuple]) -> str:
    show = lambda v: "null" if v is None else str(v).lower() if isinstance(v, bool | int) else f"'{v}'"
    return ", ".join("(" + ", ".join(show(v) for v in r) + ")" for r in rows)


def _matrix_rows() -> list[tuple]:
    kinds = [("bm25", "bm25", None)] + [(f"{kind}_{e}", kind, e) for e in ("colibri", "qwen_embedding", "e5") for kind in ("dense", "hybrid")]
    return [(2 * i + again, name + "_rerank" * again, kind, e, bool(again), name) for i, (name, kind, e) in enumerate(kinds) for again in (0, 1)]


def _comparison_rows() -> list[tuple]:
    out = []
    for e in ("colibri", "qwen_embedding", "e5"):
        d, h = f"dense_{e}", f"hybrid_{e}"
        out += [("pipeline_total", f"{h}_rerank", d), ("hibridizacao", h, d), ("rerank_dense", f"{d}_rerank", d), ("rerank_hybrid", f"{h}_rerank", h), ("hibridizacao_com_rerank", f"{h}_rerank", f"{d}_rerank")]
    return out


def oracle_sql() -> dict[str, str]:
    hybrid, bm25 = _hybrid(), f"with {_bm25()}"
    one, three = f"{bm25}, {_metrics()}", f"{hybrid}, {_metrics(THREE)}"
    sql = {
        "lex_token_counts": f"with {CHUNKS} select chunk_id, len(regexp_extract_all(lower(text), '{WORD}')) as n_tokens, len(list_distinct(regexp_extract_all(lower(text), '{WORD}'))) as n_distinct, len(regexp_extract_all(text, '{TILE}')) as n_reference from chunks",
        "lex_postings": f"with {BASE} select * from postings",
        "lex_term_df": f"with {BASE} select * from terms",
        "lex_corpus_stats": f"with {BASE} select n_docs, round(avgdl, 6) as avgdl, cast(total_tokens as bigint) as total_tokens from stats",
        "bm25_topn": f"{bm25} select {RANKED} from bm25",
        "bm25_params_b0": f"with {_bm25(2.0, 0.0)} select {RANKED} from bm25",
        "dense_topn": f"with {_dense('cast(q.chunk_id as bigint) % 50 = 0')} select {RANKED} from dense",
        "dense_vector_problems": f"""with {VECTORS}, n as (select chunk_id, cast(chunk_id as bigint) % 10 as d from vectors)
            select chunk_id, case d when 0 then 'not finite' when 1 then 'dimension' when 2 then 'null' else 'not of unit length' end as problem from n where d <= 4
            union all select chunk_id, 'repeated id' from n where d = 5""",
        "rrf_union_all": f"{hybrid} select question_id, chunk_id, bm25_rank, dense_rank, round(score, 6) as score from rrf",
        "rrf_topn": f"{hybrid} select {RANKED}, bm25_rank, dense_rank from fused",
        "rrf_weighted": f"{_hybrid(wb=2.0, wd=0.5)} select {RANKED}, bm25_rank, dense_rank from fused",
        "rerank_permutation": f"{bm25}, {_reranked('again', 'bm25')} select {RANKED}, base_rank from again",
        "bm25_nfkc": f"{bm25} select {RANKED} from bm25",
        "bm25_stored_index": f"with {_bm25(top=10)} select {RANKED} from bm25",
        "matrix_stages": f"{OTHER}, {_stages()} select config_id, question_id, stage, rank, chunk_id, bm25_rank, dense_rank, round(score, 6) as score, round(rrf_score, 6) as rrf_score, round(rerank_score, 6) as rerank_score from stages",
        "matrix_available": f"""{OTHER}, {_stages()}, configs as (select distinct config_id from stages),
            counts as (select config_id, question_id, count(*) as n from stages where stage = 'final' group by 1, 2)
            select config_id, question_id, coalesce(n, 0) as n_available from configs cross join (select question_id from questions) left join counts using (config_id, question_id)""",
        "chunk_table": f"with {_split(350, 50)} select doc_id || '-b0000-c' || printf('%03d', place) as chunk_id, doc_id, doc_id || '-b0000' as block_id, n_tokens as token_count_ref, length(piece) as char_count, sha256(piece) as text_hash, sha256(whole) as source_block_hash from split",
        "chunk_token_stats": f"with {_split(100, 20)} select doc_id, count(*) as n_chunks, cast(sum(n_tokens) as bigint) as n_tokens, max(n_tokens) as most from split group by 1",
        "heading_detect": f"with {LINES} select doc_id, n, heading from headed where heading is not null",
        "blocks_paragraphs": f"""with {LINES},
            state as (select *, sum(case when heading is not null or s = '' then 1 else 0 end) over w as para, last_value(heading ignore nulls) over w as section from headed window w as (partition by doc_id order by n rows unbounded preceding)),
            paras as (select doc_id, para, min(n) as pos, any_value(section) as section, string_agg(s, chr(10) order by n) as text from state where heading is null and s <> '' group by 1, 2)
            select doc_id || '-b' || printf('%04d', row_number() over (partition by doc_id order by pos) - 1) as block_id, cast(doc_id as varchar) as doc_id, section, 'text' as modality, length(text) as n_chars, sha256(text) as source_block_hash from paras""",
        "blocks_marked": r"""with d as (select doc_id as n, 'd' || doc_id as doc_id, doc_id % 5 + 1 as page, 'alpha ' || regexp_replace(lower(substr(text, 1, 90)), '[^a-z]+', ' ', 'g') || ' omega' as body from documents),
            b as (
                select n, 0 as k, doc_id, page::int as page, 'text' as modality, '' as caption, body as text from d
                union all select n, 1, doc_id, (page + 3)::int, 'table', case when n % 3 = 2 then '' else '** cap ' || n end, '| a | b |' || chr(10) || '| ' || n || ' | x |' from d
                union all select n, 2, doc_id, page::int, 'text', '', 'before ' || n from d
                union all select n, 3, doc_id, (page + 1)::int, 'text', '', 'after ' || n from d)
            select doc_id || '-b000' || k as block_id, doc_id, page, '1. Intro' as section, modality, caption, sha256(text) as text_hash from b""",
        "qrel_relevance": f"with {CHUNKS}, {QUESTIONS}, {QRELS} select question_id, chunk_id, case when cast(chunk_id as bigint) % 3 = 0 then 0 else 1 end as relevance from qrels",
        "qrels_index": f"with {CHUNKS}, {QUESTIONS}, {QRELS} select question_id, count(*) as n_relevant, string_agg(chunk_id, ',' order by chunk_id) as chunk_ids from qrels group by 1",
        "metrics_bundle": f"{one} select question_id, n_relevant is null as blocked, {ROUNDED} from questions left join metrics using (question_id)",
        "blocked_questions": f"with {CHUNKS}, {QUESTIONS}, {QRELS} select question_id from questions where question_id not in (select question_id from qrels)",
        "config_mean_metrics": f"{three} select config_id, count(*) as n_questions_evaluated, (select count(*) from questions) - count(*) as n_blocked, {MEANS} from metrics group by 1",
        "article_mean_metrics": f"{three} select config_id, origin_doc_id, count(*) as n, {MEANS} from metrics join questions using (question_id) group by 1, 2",
        "paired_delta_ndcg": f"""{three}, pairs as (select * from (values {_values(_comparison_rows()[10:])}) t(label, a, b)),
            joined as (select label, pairs.a, pairs.b, x."ndcg@10" - y."ndcg@10" as delta from pairs left join metrics x on x.config_id = pairs.a left join metrics y on y.config_id = pairs.b and y.question_id = x.question_id)
            select label, a, b, count(delta) as n, round(avg(delta), 6) as mean_delta from joined group by 1, 2, 3""",
        "stage_recalls": f"""{OTHER}, {_stages()}, {QRELS}, {GOLD}
            select stage, s.question_id, round(count(distinct q.chunk_id) / any_value(n_relevant), 6) as recall
            from stages s join gold using (question_id) left join qrels q on q.question_id = s.question_id and q.chunk_id = s.chunk_id where config_id = 'hybrid_e5_rerank' group by 1, 2""",
        "group_coverages": f"{bm25}, {QRELS}, {GROUPS}, {COVERAGE} select question_id, covered, total, round(fraction, 6) as fraction, covered_ids, all_covered from coverage",
        "group_coverage_summary": f"{bm25}, {QRELS}, {GROUPS}, {COVERAGE} select 'bm25' as config_id, round(avg(fraction), 6) as mean_fraction, count(*) as questions_with_groups, cast(sum(case when all_covered then 1 else 0 end) as bigint) as questions_all_covered from coverage where total > 0 and question_id in (select question_id from qrels)",
        "leakage_check": f"with {QUESTIONS} select question_id, 'expected_answer' as leaked from questions where trim(expected_answer) <> '' and contains(lower(trim(text)), lower(trim(expected_answer))) union all select question_id, 'origin_doc_id' from questions where contains(lower(trim(text)), lower(origin_doc_id))",
        "validate_rules": f"{ANNOTATED} select rule, severity, category, count(*) as n from violations group by 1, 2, 3",
        "validate_warning_counts": f"{ANNOTATED} select category, count(*) as n from violations where severity = 'warning' group by 1",
        "validate_structure": f"{STRUCTURED} select rule, severity, category, question_id, subject from structural",
        "audit_rules": f"""{STRUCTURED}
            select 'A1' as rule, question_id, evidence_id as subject from s_evidence where doc_id <> origin_doc_id
            union all select 'A2', r.question_id, r.chunk_id from s_qrels r join questions q on q.question_id = r.question_id join (select distinct chunk_id, doc_id from s_chunks) c on c.chunk_id = r.chunk_id where c.doc_id <> q.origin_doc_id
            union all select 'A3', g.question_id, g.group_id from s_groups g join questions q on q.question_id = g.question_id where g.required and q.n % 4 <> 0 and q.n % 5 <> 0""",
        "gold_counts": f"""{STRUCTURED}, asked as (select n, n % 2 = 0 as approved from s_questions)
            select (select count(*) from asked) as total, (select count(*) from asked where approved) as approved, 0::bigint as draft_ready, (select count(*) from asked where not approved) as draft_pending, 0::bigint as rejected,
                (select count(*) from s_evidence) as evidence_refs, (select count(*) from s_evidence) as evidence_with_quote, (select count(*) from s_evidence) as evidence_with_quote_and_page, (select count(*) from s_evidence) as evidence_with_chunks,
                (select count(*) from s_qrels) as qrels, (select count(*) from s_qrels) as positive_qrels, (select count(distinct question_id) from s_qrels) as questions_with_positive_qrels,
                (select count(*) from s_groups where required) as required_groups, (select count(*) from s_groups where required and len(chunk_ids) = 0) as empty_required_groups""",
        "gold_pending": f"with {QUESTIONS} select question_id, case when n % 8 = 2 then 'UNSURE' else 'UNCLASSIFIED' end as classification from questions where n % 3 = 1 and n % 8 <> 1",
        "review_status_counts": f"""with {QUESTIONS}, s as (select case when n % 3 = 0 then 'approved' when n % 3 = 1 then 'draft' else 'rejected' end as status, n % 8 = 1 as ready from questions)
            select count(*) as total, count(*) filter (status = 'approved') as approved, count(*) filter (status = 'draft' and ready) as draft_ready, count(*) filter (status = 'draft' and not ready) as draft_pending, count(*) filter (status = 'rejected') as rejected from s""",
        "mapped_chunk_ids": f"with {CHUNKS}, {QUESTIONS}, {QRELS}, {GROUPS}, {EVIDENCE} select question_id, unnest(chunk_ids) as chunk_id from evidence union select question_id, chunk_id from qrels union select question_id, unnest(chunk_ids) from groups",
        "config_matrix": f"select * from (values {_values(_matrix_rows())}) t(position, config_id, initial_retrieval, embedding, rerank, base_id)",
        "config_selection": f"select position, config_id from (values {_values(_matrix_rows())}) t(position, config_id, initial_retrieval, embedding, rerank, base_id) where not rerank and (config_id like '%dense\\_%' escape '\\' or contains(config_id, 'hybrid_e5'))",
        "config_comparisons": f"select * from (values {_values(_comparison_rows())}) t(label, a, b)",
        "context_entries": f"with {CHUNKS}, paged as (select *, case when cast(chunk_id as int) % 2 = 0 then cast(chunk_id as int) % 11 + 1 end as page from chunks) select chunk_id, sha256({ENTRY}) as entry_hash, length({ENTRY}) as n_chars from paged",
        "context_assembly": rf"""with recursive {_bm25()},
            paged as (select *, null as page from chunks),
            entries as (select question_id, rank, b.chunk_id, len(regexp_extract_all({ENTRY.replace("chunk_id", "b.chunk_id")} || chr(10), '{TILE}')) as cost from bm25 b join paged on paged.chunk_id = b.chunk_id where rank <= 5),
            walk as (
                select question_id, 0::bigint as rank, 0::bigint as used, []::varchar[] as inside, []::varchar[] as outside from questions
                union all select w.question_id, e.rank, case when used + cost <= 900 then used + cost else used end, case when used + cost <= 900 then list_append(inside, chunk_id) else inside end, case when used + cost <= 900 then outside else list_append(outside, chunk_id) end
                from walk w join entries e on e.question_id = w.question_id and e.rank = w.rank + 1),
            ends as (select question_id, max(rank) as rank from walk group by 1)
            select question_id, coalesce(array_to_string(inside, ','), '') as included, coalesce(array_to_string(outside, ','), '') as excluded, used as context_tokens, len(regexp_extract_all(text, '{TILE}')) as prompt_tokens, used + len(regexp_extract_all(text, '{TILE}')) + 512 as total_tokens
            from walk join ends using (question_id, rank) join questions using (question_id)""",
        "doc_hashes": f"with {CHUNKS} select chunk_id, sha256(text) as text_hash from chunks",
        "corpus_identity": f"with {CHUNKS} select sha256('[' || string_agg(cast(to_json({{'chunk_id': chunk_id, 'doc_id': doc_id, 'text': text}}) as varchar), ',' order by chunk_id) || ']') as corpus_version from chunks",
    }
    for m in ("recall", "hit", "mrr", "precision", "ndcg"):
        columns = ", ".join(f'round("{x}", 6) as "{x}"' for x in METRICS if x.startswith(m))
        sql[f"metric_{m}"] = f"{one} select question_id, {columns} from metrics"
    return sql
