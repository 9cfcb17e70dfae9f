"""The corpus operators' queries over whole tables, and SQL for those that SQL can express."""

from __future__ import annotations

from . import ann_codes, bpe, language_id, line_dedup, packing, pii, pivot_search, simhash_dedup, substring_dedup, url_filter

QUERIES = {
    "op1_one_bit_ann": ann_codes.op1_one_bit_ann,
    "op2_hierarchical_language_id": language_id.op2_hierarchical_language_id,
    "op3_ffd_packing": packing.op3_ffd_packing,
    "op4_line_dedup": line_dedup.op4_line_dedup,
    "op5_cover_anchor_dedup": substring_dedup.op5_cover_anchor_dedup,
    "op6_simhash_near_dedup": simhash_dedup.op6_simhash_near_dedup,
    "op7_folded_bpe": bpe.op7_folded_bpe,
    "op8_boosted_pii": pii.op8_boosted_pii,
    "op9_pivot_top_k": pivot_search.op9_pivot_top_k,
    "op10_url_filter": url_filter.op10_url_filter,
}

#: Brute force in SQL: every query against all rows.
_EXACT_TOP_K = """
WITH v AS (SELECT DISTINCT vec_id, list_transform(embedding, lambda x: cast(floor(256 * cast(x AS DOUBLE)) AS BIGINT)) AS e FROM embeddings
           WHERE embedding IS NOT NULL AND vec_id IS NOT NULL AND len(embedding) > 0
             AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = len(embedding)),
s AS (SELECT DISTINCT q.vec_id AS query_id, c.vec_id, cast(list_dot_product(cast(q.e AS DOUBLE[]), cast(c.e AS DOUBLE[])) AS BIGINT) AS score
      FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.e) = len(c.e) WHERE q.vec_id % 50 = 0),
r AS (SELECT *, cast(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""

ORACLES = {
    "op5_cover_anchor_dedup": substring_dedup.ORACLE,
    "op9_pivot_top_k": _EXACT_TOP_K,
    "op10_url_filter": url_filter.ORACLE,
}
