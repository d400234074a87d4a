"""The corpus queries and, where SQL can express them, their DuckDB forms."""

from __future__ import annotations

from inkflow.llm import ann, audit, bpe, extraction, infilling, licences, mixing, neardup, packing, quality, secrets, topk, toxicity

QUERIES = {
    "op1_mixing": mixing.op1_mixing,
    "op2_packing": packing.op2_packing,
    "op3_bpe": bpe.op3_bpe,
    "op4_neardup": neardup.op4_neardup,
    "op5_toxicity": toxicity.op5_toxicity,
    "op6_topk": topk.op6_topk,
    "op7_licences": licences.op7_licences,
    "op8_secrets": secrets.op8_secrets,
    "op9_extraction": extraction.op9_extraction,
    "op10_ann": ann.op10_ann,
    "op11_infilling": infilling.op11_infilling,
    "op12_audit": audit.op12_audit,
    "op13_quality": quality.op13_quality,
}

ORACLE_SQL: dict[str, str] = {
    "op4_neardup": r"""
        with recursive words as (
            select doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda w: w <> '') as w
            from documents
        ), sets as (
            select doc_id, list_distinct(case when len(w) >= 5 then list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) when len(w) > 0 then [array_to_string(w, ' ')] else [] end) as g
            from words
        ), shingle as (select doc_id, len(g) as n, unnest(g) as s from sets),
        link as (
            select a.doc_id as a, b.doc_id as b from shingle a join shingle b on a.s = b.s and a.doc_id <> b.doc_id
            group by a.doc_id, b.doc_id, a.n, b.n having 100 * count(*) >= 85 * (a.n + b.n - count(*))
        ), reach as (
            select doc_id, doc_id as other from sets
            union
            select reach.doc_id, link.b from reach join link on link.a = reach.other
        ), component as (select doc_id, min(other) as component_id from reach group by doc_id)
        select doc_id, len(g)::bigint as n_shingles, component_id, doc_id = component_id as kept from sets join component using (doc_id)
    """,
    "op7_licences": licences.oracle(),
    "op11_infilling": infilling.ORACLE,
    "op12_audit": audit.ORACLE,
    "op6_topk": """
        with v as (
            select vec_id, list_transform(embedding, lambda x: floor(1024 * x::double)) as e from embeddings
            where vec_id is not null and embedding is not null and len(embedding) > 0
              and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
        ), s as (
            select q.vec_id as query_id, c.vec_id, list_inner_product(q.e, c.e)::bigint as score
            from v q join v c on c.vec_id <> q.vec_id and len(c.e) = len(q.e) where q.vec_id % 100 = 0
        )
        select query_id, (row_number() over (partition by query_id order by score desc, vec_id))::int as rank, vec_id, score
        from s qualify rank <= 10
    """,
}
