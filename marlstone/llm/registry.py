"""Queries of this subpackage and their SQL, by name."""

from __future__ import annotations

from . import audit, bpe, fingerprints, jaccard, language, lexical, packing, quality, topk, toxicity, training_order, urls, warc

QUERIES = {
    "op1_training_order": training_order.op1_training_order,
    "op2_bpe_roundtrip": bpe.op2_bpe_roundtrip,
    "op3_url_filter": urls.op3_url_filter,
    "op4_exact_top_k": topk.op4_exact_top_k,
    "op5_document_fingerprints": fingerprints.op5_document_fingerprints,
    "op6_best_fit_packing": packing.op6_best_fit_packing,
    "op7_language_id": language.op7_language_id,
    "op8_jaccard_join": jaccard.op8_jaccard_join,
    "op9_warc": warc.op9_warc,
    "op10_toxicity": toxicity.op10_toxicity,
    "op11_filter_audit": audit.op11_filter_audit,
    "op12_quality": quality.op12_quality,
    "op13_ranked_search": lexical.op13_ranked_search,
}

#: What SQL can express of the results, in plain SQL; the others are held against brute force in tests/llm.
ORACLE_SQL: dict[str, str] = {
    "op4_exact_top_k": """
WITH v AS (SELECT DISTINCT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
u AS (SELECT vec_id, unnest(v) AS x, generate_subscripts(v, 1) AS i FROM v),
s AS (SELECT q.vec_id AS query_id, c.vec_id, sum(q.x * c.x)::BIGINT AS score FROM u q JOIN u c ON q.i = c.i AND q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0 GROUP BY 1, 2),
r AS (SELECT query_id, vec_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5""",
    "op8_jaccard_join": """
WITH RECURSIVE w AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT doc_id, list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS s FROM w),
x AS (SELECT doc_id, len(s) AS n, unnest(s) AS g FROM s),
l AS (SELECT a.doc_id AS a, b.doc_id AS b FROM x a JOIN x b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2, a.n, b.n HAVING 100 * count(*) >= 75 * (a.n + b.n - count(*))),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r(a, b) AS (SELECT doc_id, doc_id FROM s UNION SELECT r.a, e.b FROM r JOIN e ON e.a = r.b),
c AS (SELECT a AS doc_id, min(b) AS component_id FROM r GROUP BY 1)
SELECT doc_id, len(s)::BIGINT AS n_shingles, component_id FROM s JOIN c USING (doc_id)""",
    "op9_warc": """
WITH d AS (SELECT page_id, strlen(coalesce(html, ''))::BIGINT AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
f AS (SELECT payload_digest, min(page_id) AS first FROM d WHERE payload_bytes >= 100 GROUP BY 1)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id > first THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN page_id > first THEN first END AS refers_to FROM d LEFT JOIN f USING (payload_digest)""",
    "op11_filter_audit": audit.ORACLE,
    "op13_ranked_search": lexical.ORACLE,
}
