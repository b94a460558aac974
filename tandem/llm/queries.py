"""The queries of this subpackage and their SQL, where SQL can express them."""

from __future__ import annotations

from tandem.llm import byte_bpe, chat_format, hard_negatives, jaccard_join, language_id, packing, quality_rules, secret_scan, token_output, topk_search, toxicity, turn_repair, warc_derivatives

QUERIES = {
    "op1_grammar_token_output": token_output.op1_grammar_token_output,
    "op2_grammar_round_trip": chat_format.op2_grammar_round_trip,
    "op3_risk_controlled_quality": quality_rules.op3_risk_controlled_quality,
    "op4_tree_bpe": byte_bpe.op4_tree_bpe,
    "op5_factorization_machine": toxicity.op5_factorization_machine,
    "op6_segmentation_marginalised_language": language_id.op6_segmentation_marginalised_language,
    "op7_cost_balanced_packing": packing.op7_cost_balanced_packing,
    "op8_block_max_top_k": topk_search.op8_block_max_top_k,
    "op9_parity_sketch_join": jaccard_join.op9_parity_sketch_join,
    "op10_warc_derivatives": warc_derivatives.op10_warc_derivatives,
    "op11_assignment_secrets": secret_scan.op11_assignment_secrets,
    "op12_tight_arc_repair": turn_repair.op12_tight_arc_repair,
    "op13_dual_tree_negatives": hard_negatives.op13_dual_tree_negatives,
}

ORACLES: dict[str, str] = {
    "op12_tight_arc_repair": turn_repair.ORACLE,
    "op13_dual_tree_negatives": hard_negatives.ORACLE,
    "op10_warc_derivatives": warc_derivatives.ORACLE,
    "op2_grammar_round_trip": chat_format.ORACLE,
    "op8_block_max_top_k": r"""WITH v AS (
  SELECT vec_id, [floor(256 * x::DOUBLE)::BIGINT FOR x IN embedding] AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scores AS (
  SELECT q.vec_id AS query_id, d.vec_id, coalesce(list_sum([q.v[i] * d.v[i] FOR i IN range(1, len(d.v) + 1)]), 0)::BIGINT AS score
  FROM v q JOIN v d ON q.vec_id <> d.vec_id AND len(q.v) = len(d.v) WHERE q.vec_id % 50 = 0),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS r FROM scores)
SELECT query_id, r::INTEGER AS rank, vec_id, score FROM ranked WHERE r <= 5
""",
    "op9_parity_sketch_join": r"""WITH RECURSIVE words AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w
  FROM documents),
sets AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
    ELSE list_distinct([w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] || ' ' || w[i + 3] FOR i IN range(1, len(w) - 2)]) END AS s
  FROM words),
items AS (SELECT doc_id, len(s) AS n, unnest(s) AS g FROM sets),
pairs AS (
  SELECT a.doc_id AS a, b.doc_id AS b, any_value(a.n) AS na, any_value(b.n) AS nb, count(*) AS shared
  FROM items a JOIN items b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
edges AS (SELECT a, b FROM pairs WHERE 100 * shared >= 85 * (na + nb - shared)),
sides AS (SELECT a, b FROM edges UNION ALL SELECT b, a FROM edges),
reach AS (SELECT doc_id AS node, doc_id AS seen FROM documents UNION SELECT r.node, e.b FROM reach r JOIN sides e ON r.seen = e.a)
SELECT s.doc_id, len(s.s)::BIGINT AS n_shingles, (SELECT min(seen) FROM reach WHERE node = s.doc_id) AS component_id FROM sets s
""",
}
