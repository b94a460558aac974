"""The catalogue's queries in SQL for DuckDB, written apart from the DataFrame code."""

from __future__ import annotations

import re

from tandem.functions.fixed import SPACE, SPACES
from tandem.plans import flow_oracles

# Patterns, limits and wordings must be those of the DataFrame code.
TRIM = r"regexp_replace({}, '^\s+|\s+$', '', 'g')"


def trim(x: str) -> str:
    return TRIM.format(x)


def bare(x: str) -> str:
    once = f"regexp_replace({trim(x)}, '^(ans|answer|question|qn|q)\\.?\\s*', '', 'i')"
    s = trim(f"regexp_replace({once}, '^q\\.?\\s*', '', 'i')")
    return trim(f"regexp_replace(regexp_replace({s}, '^[.\\-:]+', ''), '[.\\-:)]+$', '')")


SUB = r"'^(\d+)\s*[.(\-\s]*\(?\s*([a-zA-Z0-9])\)?\s*$'"


def canonical(x: str) -> str:
    s = bare(x)
    return f"(CASE WHEN {x} IS NULL OR {trim(x)} = '' THEN NULL WHEN regexp_matches({s}, {SUB}) THEN regexp_extract({s}, {SUB}, 1) || '(' || lower(regexp_extract({s}, {SUB}, 2)) || ')' ELSE lower({s}) END)"


def sort_key(c: str) -> str:
    """From a canonical label."""
    return (
        f"(CASE WHEN regexp_matches({c}, '^\\d+\\([a-z]\\)$') THEN regexp_extract({c}, '^\\d+')::BIGINT * 100 + ascii(regexp_extract({c}, '\\((.)\\)$', 1)) - 96 "
        f"WHEN regexp_matches({c}, '^\\d+\\(.\\)$') THEN regexp_extract({c}, '^\\d+')::BIGINT * 100 + 50 + ascii(regexp_extract({c}, '\\((.)\\)$', 1)) "
        f"WHEN regexp_matches({c}, '^\\d+$') THEN {c}::BIGINT * 100 ELSE 9007199254740991 END)::BIGINT"
    )


ANSWERS = """
lines AS (
  SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_shipdate, l_partkey, l_suppkey, l_linenumber, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus) - 1 AS seq
  FROM lineitem),
answers AS (
  SELECT l_orderkey AS session_id, l_orderkey || '-a' || seq AS answer_id, seq,
    CASE l_partkey % 8 WHEN 0 THEN CASE WHEN l_suppkey % 4 = 0 THEN 'Ans' || chr(160) ELSE 'Ans ' END || l_linenumber WHEN 1 THEN CASE WHEN l_suppkey % 4 = 0 THEN 'Q.' || chr(8201) ELSE 'Q.' END || l_linenumber
      WHEN 2 THEN CASE WHEN l_suppkey % 4 = 0 THEN chr(65279) ELSE '' END || l_linenumber || '.' WHEN 6 THEN CASE WHEN l_suppkey % 4 = 0 THEN chr(160) END WHEN 3 THEN 'Question ' || l_linenumber
      WHEN 4 THEN l_linenumber || '(a)' WHEN 5 THEN l_linenumber || '(o)' WHEN 7 THEN 'Ans ' || (l_linenumber + 10) END AS raw_label,
    repeat('x', l_quantity::INT * 5) || CASE WHEN l_partkey % 3 = 0 THEN ' about subject' || (l_suppkey % 7) ELSE chr(160) END AS text, l_suppkey % 3 + 1 AS page, l_returnflag = 'R' AS crossed_out,
    l_linestatus = 'F' AND l_suppkey % 5 = 0 AS low_confidence, l_suppkey % 11 = 0 AS has_diagram,
    (l_linenumber - 1) / 8.0::DOUBLE AS y, l_quantity / 200.0::DOUBLE AS h, l_tax AS x, l_discount + 0.5::DOUBLE AS w
  FROM lines)"""
QUESTIONS = """
questions AS (
  SELECT o_orderkey AS session_id, o_orderkey || '-q' || n AS question_id, n AS ordinal, CASE WHEN n <= 7 THEN 'Q' || n ELSE (n - 7) || '(a)' END AS label,
    CASE WHEN (o_orderkey + n) % 5 <> 0 THEN (o_orderkey + n) % 5 + 1 END AS marks, (o_orderkey + n) % 13 = 0 AS low_confidence,
    'describe subject' || ((o_orderkey + n) % 7) || ' briefly' AS text
  FROM orders, range(1, 11) t(n))"""
GROUPS = f"""
answer_labels AS MATERIALIZED (SELECT raw_label, {canonical('raw_label')} AS canonical FROM (SELECT DISTINCT raw_label FROM answers WHERE raw_label IS NOT NULL)),
labelled AS (SELECT a.*, c.canonical FROM answers a LEFT JOIN answer_labels c ON a.raw_label = c.raw_label),
ranked AS (
  SELECT *, seq - lag(seq) OVER g AS gap, length({trim('text')}) * CASE WHEN crossed_out THEN 0.3::DOUBLE ELSE 1 END * CASE WHEN low_confidence THEN 0.7::DOUBLE ELSE 1 END AS worth, row_number() OVER g AS first
  FROM labelled WHERE canonical IS NOT NULL WINDOW g AS (PARTITION BY session_id, canonical ORDER BY seq)),
bested AS (
  SELECT *, row_number() OVER (PARTITION BY session_id, canonical ORDER BY worth DESC, seq) AS best,
    bool_or(has_diagram) OVER p OR coalesce(max(gap) OVER p, 0) <= 3 AS merged
  FROM ranked WINDOW p AS (PARTITION BY session_id, canonical)),
resolved AS MATERIALIZED (
  SELECT *, CASE WHEN merged THEN CASE WHEN first = 1 THEN 'primary' ELSE 'additional' END ELSE CASE WHEN best = 1 THEN 'primary' ELSE 'duplicate' END END AS role FROM bested),
groups AS MATERIALIZED (
  SELECT session_id, canonical, min(seq) AS first_seq, max(answer_id) FILTER (role = 'primary') AS answer_id, bool_or(role = 'primary' AND crossed_out) AS a_crossed,
    bool_or(role = 'primary' AND low_confidence) AS a_low, max(length({trim('text')})) FILTER (role = 'primary') AS a_length, count(*) FILTER (role = 'additional') AS n_additional,
    string_agg(text, chr(10) || chr(10) ORDER BY seq) FILTER (role <> 'duplicate') AS full_text
  FROM resolved GROUP BY 1, 2)"""


def score(base: str) -> str:
    return (
        f"greatest(0::DOUBLE, least(1::DOUBLE, {base} - CASE WHEN q_low THEN 0.1::DOUBLE ELSE 0 END - CASE WHEN a_low THEN 0.1::DOUBLE ELSE 0 END - CASE WHEN a_crossed THEN 0.05::DOUBLE ELSE 0 END "
        f"- CASE WHEN marks >= 3 AND a_length < 15 THEN 0.08::DOUBLE ELSE 0 END))"
    )


def similarity(a: str, b: str) -> str:
    # levenshtein counts bytes here; the one label beyond ASCII is a no-break space.
    x, y = (f"replace(coalesce({canonical(v)}, {v}), chr(160), chr(26))" for v in (a, b))
    return f"(CASE WHEN {x} = {y} THEN 1::DOUBLE ELSE 1 - levenshtein({x}, {y}) / greatest(length({x}), length({y}), 1)::DOUBLE END)"


def greedy(i: int) -> str:
    """The pick of question i of every session: its best answer that none before it took."""
    before = f"SELECT session_id, answer_id FROM taken{i - 1}" if i > 1 else "SELECT NULL::BIGINT AS session_id, NULL::VARCHAR AS answer_id WHERE false"
    return f"""
free{i} AS MATERIALIZED (SELECT c.* FROM content c WHERE c.ordinal = {i} AND NOT EXISTS (SELECT 1 FROM ({before}) t WHERE t.session_id = c.session_id AND t.answer_id = c.answer_id)),
pick{i} AS MATERIALIZED (SELECT session_id, question_id, answer_id, ratio FROM free{i} QUALIFY row_number() OVER (PARTITION BY session_id ORDER BY ratio DESC, seq) = 1),
taken{i} AS MATERIALIZED (SELECT session_id, answer_id FROM pick{i} UNION ALL {before})"""


TOKENS = r"list_distinct(list_filter(regexp_split_to_array(regexp_replace(lower({}), '[^a-z0-9\s]', ' ', 'g'), '\s+'), lambda w: length(w) > 2 AND w NOT IN ('the', 'a', 'an', 'of', 'to', 'and', 'in', 'is', 'for', 'on', 'with')))"
QUESTIONS_OF_A_SESSION = 10

MAPPINGS = f"""
question_labels AS MATERIALIZED (SELECT label, {canonical('label')} AS canonical FROM (SELECT DISTINCT label FROM questions)),
keyed AS MATERIALIZED (SELECT q.*, c.canonical, q.low_confidence AS q_low FROM questions q LEFT JOIN question_labels c ON q.label = c.label),
exact AS MATERIALIZED (
  SELECT k.session_id, k.question_id, k.ordinal, k.marks, k.canonical, k.q_low, k.text, g.answer_id, g.a_crossed, g.a_low, g.a_length, g.n_additional, g.full_text
  FROM keyed k LEFT JOIN groups g ON k.session_id = g.session_id AND k.canonical = g.canonical),
free AS (SELECT g.* FROM groups g WHERE NOT EXISTS (SELECT 1 FROM keyed k WHERE k.session_id = g.session_id AND k.canonical = g.canonical)),
met AS MATERIALIZED (
  SELECT e.session_id, e.question_id, e.q_low, e.marks, e.canonical, f.canonical AS near, f.answer_id, f.a_crossed, f.a_low, f.a_length, f.n_additional, f.full_text, f.first_seq
  FROM exact e JOIN free f ON e.session_id = f.session_id WHERE e.answer_id IS NULL),
alike AS MATERIALIZED (SELECT a, b, {similarity('a', 'b')} AS similarity FROM (SELECT DISTINCT canonical AS a, near AS b FROM met)),
near AS (SELECT m.*, a.similarity FROM met m JOIN alike a ON m.canonical = a.a AND m.near = a.b),
fuzzy AS (
  SELECT *, {score('0.6::DOUBLE + 0.3::DOUBLE * similarity')} AS confidence
  FROM near WHERE similarity >= 0.72 QUALIFY row_number() OVER (PARTITION BY session_id, question_id ORDER BY similarity DESC, first_seq) = 1),
numbered AS MATERIALIZED (
  SELECT e.session_id, e.question_id, e.ordinal, e.marks, e.canonical, e.q_low, e.text, coalesce(e.answer_id, f.answer_id) AS answer_id,
    CASE WHEN e.answer_id IS NOT NULL THEN 'number-exact' WHEN f.answer_id IS NOT NULL THEN 'number-fuzzy' END AS method,
    CASE WHEN e.answer_id IS NOT NULL THEN {score('0.95::DOUBLE').replace('q_low', 'e.q_low').replace('a_low', 'e.a_low').replace('a_crossed', 'e.a_crossed').replace('marks', 'e.marks').replace('a_length', 'e.a_length')} ELSE f.confidence END AS confidence,
    f.near, f.similarity, coalesce(e.n_additional, f.n_additional) AS n_additional, coalesce(e.full_text, f.full_text) AS full_text
  FROM exact e LEFT JOIN fuzzy f ON e.session_id = f.session_id AND e.question_id = f.question_id),
by_number AS MATERIALIZED (
  SELECT DISTINCT r.session_id, r.answer_id FROM resolved r JOIN (SELECT DISTINCT session_id, coalesce(near, canonical) AS canonical FROM numbered WHERE answer_id IS NOT NULL) m
  ON r.session_id = m.session_id AND r.canonical = m.canonical WHERE r.role <> 'duplicate'),
unused AS MATERIALIZED (SELECT a.*, {TOKENS.format('a.text')} AS tok FROM answers a WHERE NOT EXISTS (SELECT 1 FROM by_number c WHERE c.session_id = a.session_id AND c.answer_id = a.answer_id)),
content AS MATERIALIZED (
  SELECT * FROM (SELECT n.session_id, n.question_id, n.ordinal, u.answer_id, u.seq, len(list_intersect(n.tok, u.tok)) / greatest(len(n.tok), 1)::DOUBLE AS ratio
    FROM (SELECT *, {TOKENS.format('text')} AS tok FROM numbered WHERE answer_id IS NULL) n JOIN unused u ON n.session_id = u.session_id)
  WHERE ratio > 0.08 AND least(ratio * 1.5, 0.6) > 0.25),
{",".join(greedy(i) for i in range(1, QUESTIONS_OF_A_SESSION + 1))},
picked AS MATERIALIZED ({" UNION ALL ".join(f"SELECT * FROM pick{i}" for i in range(1, QUESTIONS_OF_A_SESSION + 1))}),
rest_q AS (SELECT session_id, count(*) AS n, max(question_id) AS question_id FROM numbered q WHERE answer_id IS NULL AND NOT EXISTS (SELECT 1 FROM picked p WHERE p.session_id = q.session_id AND p.question_id = q.question_id) GROUP BY 1),
rest_a AS (SELECT session_id, count(*) AS n, max(answer_id) AS answer_id FROM unused a WHERE NOT EXISTS (SELECT 1 FROM picked p WHERE p.session_id = a.session_id AND p.answer_id = a.answer_id) GROUP BY 1),
more AS MATERIALIZED (
  SELECT session_id, question_id, answer_id, 'semantic' AS method, least(ratio * 1.5::DOUBLE, 0.6::DOUBLE) AS base FROM picked
  UNION ALL SELECT q.session_id, q.question_id, a.answer_id, 'sequence-fallback', 0.35::DOUBLE FROM rest_q q JOIN rest_a a ON q.session_id = a.session_id WHERE q.n = 1 AND a.n = 1),
scored AS (
  SELECT m.session_id, m.question_id, m.answer_id, m.method, m.base, u.text AS full_text, u.crossed_out AS a_crossed, u.low_confidence AS a_low, length({trim('u.text')}) AS a_length, n.q_low, n.marks
  FROM more m JOIN unused u ON m.session_id = u.session_id AND m.answer_id = u.answer_id JOIN numbered n ON m.session_id = n.session_id AND m.question_id = n.question_id),
added AS (SELECT *, {score('base')} AS confidence FROM scored),
mappings AS MATERIALIZED (
  SELECT n.session_id, n.question_id, n.ordinal, n.marks, n.canonical, coalesce(n.answer_id, s.answer_id) AS answer_id, coalesce(n.method, s.method) AS method, coalesce(n.confidence, s.confidence, 0::DOUBLE) AS confidence,
    n.near, n.similarity, coalesce(n.n_additional, 0) AS n_additional, coalesce(n.full_text, s.full_text) AS full_text, n.answer_id IS NOT NULL AS by_number
  FROM numbered n LEFT JOIN added s ON n.session_id = s.session_id AND n.question_id = s.question_id),
consumed AS MATERIALIZED (SELECT session_id, answer_id FROM by_number UNION ALL SELECT session_id, answer_id FROM more)"""
GRADES = r"""
grades AS (
  SELECT *, coalesce(marks, 5)::DOUBLE AS total_marks, answer_id IS NULL AS ungraded,
    CASE WHEN answer_id IS NULL THEN 0::DOUBLE ELSE floor(least(length(regexp_replace(full_text, '^\s+|\s+$', '', 'g')) / 200::DOUBLE, 1::DOUBLE) * coalesce(marks, 5)::DOUBLE * 2 + 0.5) / 2::DOUBLE END AS marks_awarded
  FROM mappings)"""

LINK = f"WITH {ANSWERS}, {QUESTIONS}, {GROUPS}, {MAPPINGS}"
QA = r"""
qa AS (SELECT *, list_distinct(list_filter(regexp_split_to_array(regexp_replace(lower(text), '[^a-z0-9\s]', ' ', 'g'), '\s+'), lambda w: length(w) > 2 AND w NOT IN ('the', 'a', 'an', 'of', 'to', 'and', 'in', 'is', 'for', 'on', 'with'))) AS tok FROM conversations),
q AS (SELECT conv_id AS session_id, conv_id || '-q' || turn AS question_id, turn AS ordinal, tok, text FROM qa WHERE role = 'user'),
a AS (SELECT conv_id AS session_id, conv_id || '-a' || turn AS answer_id, turn AS seq, tok, text FROM qa WHERE role = 'assistant'),
pairs AS (SELECT q.session_id, question_id, ordinal, answer_id, seq, len(list_intersect(q.tok, a.tok)) / greatest(len(q.tok), 1)::DOUBLE AS ratio FROM q JOIN a ON q.session_id = a.session_id)"""
WALK = """
steps AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY ordinal) AS i FROM q),
walk(session_id, i, used, question_id, answer_id, ratio) AS (
  SELECT session_id, 0::BIGINT, []::VARCHAR[], NULL::VARCHAR, NULL::VARCHAR, NULL::DOUBLE FROM (SELECT DISTINCT session_id FROM q)
  UNION ALL
  SELECT w.session_id, s.i, CASE WHEN b.answer_id IS NULL THEN w.used ELSE list_append(w.used, b.answer_id) END, s.question_id, b.answer_id, b.ratio
  FROM walk w JOIN steps s ON s.session_id = w.session_id AND s.i = w.i + 1
  LEFT JOIN LATERAL (
    SELECT * FROM (SELECT p.answer_id, p.ratio FROM pairs p WHERE p.session_id = s.session_id AND p.question_id = s.question_id AND NOT list_contains(w.used, p.answer_id) ORDER BY p.ratio DESC, p.seq LIMIT 1)
    WHERE ratio > 0.08 AND least(ratio * 1.5, 0.6) > 0.25) b ON true),
picks AS (SELECT session_id, question_id, answer_id, ratio FROM walk WHERE answer_id IS NOT NULL)"""
REC = "WITH RECURSIVE " + QA + "," + WALK

HISTORY = "WITH placed AS (SELECT o_custkey AS owner, o_orderkey AS session_id, o_orderdate AS saved_at, floor(o_totalprice)::BIGINT % 101 AS percent, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey) AS place FROM orders)"

SAVES = """saves AS (
  SELECT o_custkey AS owner, o_orderkey AS session_id, o_orderdate AS saved_at, floor(o_totalprice)::BIGINT % 101 AS percent FROM orders
  UNION ALL SELECT o_custkey, o_orderkey, o_orderdate + INTERVAL 2 DAY, (floor(o_totalprice)::BIGINT % 101 + 7) % 101 FROM orders WHERE o_orderkey % 3 = 0)"""

INSERTIONS = f"""WITH {ANSWERS}, e AS (SELECT session_id, page, answer_id, min(y) * 2000::DOUBLE AS top, max(y + h) * 2000::DOUBLE AS bottom FROM answers GROUP BY 1, 2, 3),
n AS (SELECT *, 50::DOUBLE - (lead(top) OVER (PARTITION BY session_id, page ORDER BY top, answer_id) - bottom) AS amount FROM e),
ins AS (SELECT *, floor(amount * 1000 + 0.5)::BIGINT AS amount_e3 FROM n WHERE amount > 0)"""
BROKEN = r"""WITH broken AS (SELECT event_id, CASE event_id % 8 WHEN 0 THEN props WHEN 1 THEN '```json' || chr(10) || props || chr(10) || '```' WHEN 2 THEN regexp_replace(props, '}$', ',}')
  WHEN 3 THEN 'Here it is: ' || props || ' as asked.' WHEN 4 THEN '{"items": [' || props || ', ' || props || ', ' WHEN 5 THEN '{“note”: ”it‘s it’s“, “p”: [' || props || ', ] }'
  WHEN 6 THEN '{"a": "\ud800", "p": ' || props || '}' ELSE chr(65279) || '{"a": [1e400, -9], "p": ' || props || '}' || chr(160) END AS raw FROM events)"""

ORACLES = {
    "normalize_label": f"WITH {ANSWERS}, c AS (SELECT *, {canonical('raw_label')} AS canonical FROM answers) SELECT answer_id, raw_label, canonical, {sort_key('canonical')} AS sort_key FROM c",
    "label_similarity": f"WITH {ANSWERS}, {QUESTIONS}, d AS (SELECT DISTINCT q.label AS a, r.raw_label AS b FROM questions q JOIN answers r ON q.session_id = r.session_id WHERE r.raw_label IS NOT NULL) SELECT a, b, {similarity('a', 'b')} AS similarity FROM d",
    "same_label": f"WITH {ANSWERS} SELECT answer_id, coalesce({canonical('raw_label')} = {canonical(chr(39) + 'Q3' + chr(39))}, false) AS same FROM answers",
    "question_order": f"WITH {QUESTIONS}, c AS (SELECT *, {canonical('label')} AS canonical FROM questions) SELECT session_id, question_id, row_number() OVER (PARTITION BY session_id ORDER BY {sort_key('canonical')}, ordinal)::BIGINT AS place FROM c",
    "assign_sequence": f"WITH {ANSWERS} SELECT session_id, answer_id, page, row_number() OVER (PARTITION BY session_id ORDER BY page, seq) - 1 AS sequence_index FROM answers",
    "answer_groups": f"WITH {ANSWERS}, {GROUPS} SELECT session_id, canonical, count(*) AS n, string_agg(answer_id, ',' ORDER BY seq) AS answer_ids FROM resolved GROUP BY 1, 2",
    "seq_gaps": f"WITH {ANSWERS}, {GROUPS} SELECT answer_id, canonical, gap FROM resolved",
    "duplicate_rank": f"WITH {ANSWERS}, {GROUPS} SELECT answer_id, canonical, worth, best AS place FROM resolved",
    "resolve_groups": f"WITH {ANSWERS}, {GROUPS} SELECT answer_id, canonical, role FROM resolved",
    "map_exact": f"{LINK} SELECT session_id, question_id, answer_id, confidence FROM mappings WHERE method = 'number-exact'",
    "map_fuzzy": f"{LINK} SELECT session_id, question_id, answer_id, near, similarity, confidence FROM mappings WHERE method = 'number-fuzzy'",
    "score_mapping": f"{LINK} SELECT question_id, method, floor(confidence * 10000 + 0.5)::BIGINT AS confidence_e4 FROM mappings WHERE answer_id IS NOT NULL",
    "needs_review": f"{LINK} SELECT question_id, answer_id IS NOT NULL AND (method = 'sequence-fallback' OR confidence < 0.55) AS needs_review FROM mappings",
    "reasoning": f"""{LINK} SELECT question_id, CASE method
        WHEN 'number-exact' THEN 'Matched by exact question-number label "' || canonical || '"' || CASE WHEN n_additional > 0 THEN ' (merged ' || n_additional || ' additional page block(s) as a multi-page answer)' ELSE '' END || '.'
        WHEN 'number-fuzzy' THEN 'Matched by fuzzy label similarity (' || floor(similarity * 100 + 0.5)::BIGINT || '%) between "' || canonical || '" and the student''s written "' || near || '", likely OCR or numbering noise.'
        WHEN 'semantic' THEN 'No matching question number found on the answer sheet; matched by content similarity. Keyword-overlap fallback (Gemini unavailable): matched on shared vocabulary.'
        WHEN 'sequence-fallback' THEN 'Exactly one question and one answer block remained unmatched after number and semantic matching, so they were paired as a last resort. Please verify.'
        ELSE 'No answer found for this question.' END AS reasoning FROM mappings""",
    "consumed_ids": f"{LINK} SELECT session_id, answer_id FROM consumed",
    "unanswered": f"{LINK} SELECT session_id, question_id FROM mappings WHERE answer_id IS NULL",
    "orphans": f"""{LINK}, claimed AS (SELECT * FROM mappings WHERE method = 'number-exact' QUALIFY row_number() OVER (PARTITION BY session_id, canonical ORDER BY ordinal) = 1)
        SELECT a.session_id, a.answer_id, a.seq, CASE WHEN m.question_id IS NULL THEN 'no-question-match' ELSE 'duplicate-of-mapped' END AS reason, m.question_id AS guess_question_id, m.confidence AS guess_confidence
        FROM answers a LEFT JOIN resolved r ON a.session_id = r.session_id AND a.answer_id = r.answer_id AND r.role = 'duplicate' LEFT JOIN claimed m ON r.session_id = m.session_id AND r.canonical = m.canonical
        WHERE NOT EXISTS (SELECT 1 FROM consumed c WHERE c.session_id = a.session_id AND c.answer_id = a.answer_id)""",
    "method_counts": f"{LINK} SELECT coalesce(method, 'none') AS method, count(*) AS n FROM mappings GROUP BY 1",
    "grade_length": f"{LINK}, {GRADES} SELECT question_id, total_marks, marks_awarded FROM grades",
    "grade_lookup": f"{LINK}, {GRADES} SELECT question_id, answer_id, marks_awarded, CASE WHEN ungraded THEN 1 ELSE 0.2 END::DOUBLE AS grade_confidence, ungraded FROM grades",
    "summary": f"""{LINK}, {GRADES}, s AS (SELECT session_id, sum(marks_awarded) AS aw, sum(total_marks) AS po, count(*) AS n, count(answer_id) AS att, (sum(floor(confidence * 10000 + 0.5)) FILTER (answer_id IS NOT NULL))::BIGINT AS c FROM grades GROUP BY 1),
        o AS (SELECT session_id, count(*) AS orphans FROM answers a WHERE NOT EXISTS (SELECT 1 FROM consumed c WHERE c.session_id = a.session_id AND c.answer_id = a.answer_id) GROUP BY 1)
        SELECT s.session_id, aw AS marks_awarded, po AS marks_possible, CASE WHEN po > 0 THEN floor(aw / po * 1000 + 0.5) / 10 ELSE 0 END::DOUBLE AS percentage, att AS attempted, n - att AS unanswered, n AS total_questions,
          coalesce(orphans, 0) AS orphans, CASE WHEN att > 0 THEN ((2 * c + 100 * att) // (200 * att)) / 100::DOUBLE ELSE 0 END::DOUBLE AS mean_confidence FROM s LEFT JOIN o ON s.session_id = o.session_id""",
    "strong_weak": f"""{LINK}, {GRADES}, r AS (SELECT g.session_id, g.ordinal, q.label, marks_awarded / total_marks AS ratio FROM grades g JOIN questions q ON g.question_id = q.question_id WHERE NOT ungraded)
        SELECT session_id, coalesce(string_agg('Q' || label, ',' ORDER BY ordinal) FILTER (ratio >= 0.75), '') AS strong, coalesce(string_agg('Q' || label, ',' ORDER BY ordinal) FILTER (ratio < 0.5), '') AS weak FROM r GROUP BY 1""",
    "badge_tiers": f"{LINK}, {GRADES} SELECT question_id, CASE WHEN marks_awarded / total_marks >= 0.7 THEN 'success' WHEN marks_awarded / total_marks >= 0.3 THEN 'warning' ELSE 'danger' END AS tier FROM grades",
    "result_cards": f"{LINK}, {GRADES} SELECT g.session_id, g.question_id, row_number() OVER (PARTITION BY g.session_id ORDER BY g.ordinal) AS card, q.label, g.answer_id, a.seq AS answer_seq, g.marks_awarded, g.answer_id IS NULL AS unanswered FROM grades g JOIN questions q ON g.question_id = q.question_id LEFT JOIN answers a ON g.answer_id = a.answer_id",
    "tokenize": f"WITH {QA} SELECT conv_id, turn, array_to_string(list_sort(tok), ' ') AS tokens FROM qa",
    "keyword_overlap": f"WITH {QA} SELECT question_id, answer_id, ratio, least(ratio * 1.5, 0.6)::DOUBLE AS confidence FROM pairs",
    "map_semantic": f"{REC} SELECT session_id, question_id, answer_id, ratio FROM picks",
    "map_residual": f"""{REC}, oq AS (SELECT session_id, count(*) AS n, max(question_id) AS question_id FROM q WHERE question_id NOT IN (SELECT question_id FROM picks) GROUP BY 1), oa AS (SELECT session_id, count(*) AS n, max(answer_id) AS answer_id FROM a WHERE answer_id NOT IN (SELECT answer_id FROM picks) GROUP BY 1)
        SELECT oq.session_id, question_id, answer_id FROM oq JOIN oa ON oq.session_id = oa.session_id WHERE oq.n = 1 AND oa.n = 1""",
    "merge_text": "SELECT conv_id, string_agg(text, chr(10) || chr(10) ORDER BY turn) AS merged FROM conversations WHERE role = 'assistant' GROUP BY 1",
    "clamp_marks": "SELECT l_orderkey, l_linenumber, l_quantity, greatest(0::DOUBLE, least(l_linenumber::DOUBLE, floor((l_quantity / 7 - 1) * 2 + 0.5) / 2))::DOUBLE AS marks FROM lineitem",
    "split_labels": r"""WITH b AS (SELECT doc_id AS block_id, doc_id % 9 + 1 AS n, 'Ans ' || (doc_id % 9 + 1) || '.' AS raw_label, (doc_id % 9 + 1)::VARCHAR AS number, ' ' || replace(text, chr(10), ' ')
          || CASE doc_id % 3 WHEN 0 THEN ' Diagram for Answer ' || (doc_id % 9 + 2) || ': fig' WHEN 1 THEN ' Q' || (doc_id % 9 + 1) || '. again' ELSE '' END AS body, doc_id % 2 = 0 AS has_diagram FROM documents),
        m AS (SELECT *, regexp_extract(body, '(?is)^(.*?)(\b(?:diagram|figure|table|chart)?\s*(?:for\s+)?(?:ans(?:wer)?|q(?:uestion)?)\.?\s*(\d+[a-zA-Z]?)\s*[:.\-]?\s*)', ['before', 'match', 'ref']) AS x FROM b),
        d AS (SELECT *, x.before AS before, x.match AS match, regexp_replace(x.ref, '[^0-9]', '', 'g') AS ref FROM m),
        c AS (SELECT *, match <> '' AND before <> '' AND ref <> '' AND ref <> number AS cut FROM d)
        SELECT block_id, 0 AS part, raw_label, number, CASE WHEN cut THEN raw_label || ' ' || regexp_replace(before, '^\s+|\s+$', '', 'g') ELSE raw_label || body END AS body_text, has_diagram AND NOT cut AS has_diagram FROM c
        UNION ALL SELECT block_id, 1, regexp_replace(match, '^\s+|\s+$', '', 'g'), ref, regexp_replace(substr(body, length(before) + 1), '^\s+|\s+$', '', 'g'), has_diagram FROM c WHERE cut""",
    "segment_lines": r"""WITH n AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS pos FROM documents),
        l AS (SELECT doc_id, pos, regexp_replace(CASE WHEN pos % 3 = 0 THEN (pos // 3 + 1) || '. ' || line ELSE line END, '^\s+|\s+$', '', 'g') AS line FROM n),
        s AS (SELECT *, regexp_matches(line, '^\s*(\d{1,2}\s*\.?\s*\(?[a-d]?\)?)\s*[.).:-]?\s+') AS starts FROM l WHERE line <> ''),
        i AS (SELECT *, sum(starts::INT) OVER (PARTITION BY doc_id ORDER BY pos) AS item FROM s)
        SELECT doc_id, item::BIGINT AS item, max(CASE WHEN starts THEN regexp_replace(regexp_extract(line, '^\s*(\d{1,2}\s*\.?\s*\(?[a-d]?\)?)\s*[.).:-]?\s+', 1), '\s+', '', 'g') END) AS label,
          string_agg(CASE WHEN starts THEN regexp_replace(regexp_replace(line, '^\s*(\d{1,2}\s*\.?\s*\(?[a-d]?\)?)\s*[.).:-]?\s+', ''), '^\s+|\s+$', '', 'g') ELSE line END, ' ' ORDER BY pos) AS body FROM i WHERE item > 0 GROUP BY 1, 2""",
    "box_clip": f"""WITH {ANSWERS}, n AS (SELECT *, lead(y) OVER p AS ny, lead(answer_id) OVER p AS na FROM answers WINDOW p AS (PARTITION BY session_id, page ORDER BY y, seq))
        SELECT session_id, page, answer_id, y, CASE WHEN na <> answer_id AND y + h > ny AND ny > y THEN ny - y ELSE h END AS h FROM n""",
    "block_extent": f"WITH {ANSWERS} SELECT session_id, page, answer_id, min(y) AS top, max(y + h) AS bottom FROM answers GROUP BY 1, 2, 3",
    "gap_insertions": f"""WITH {ANSWERS}, e AS (SELECT session_id, page, answer_id, min(y) * 2000::DOUBLE AS top, max(y + h) * 2000::DOUBLE AS bottom FROM answers GROUP BY 1, 2, 3),
        n AS (SELECT *, 50::DOUBLE - (lead(top) OVER (PARTITION BY session_id, page ORDER BY top, answer_id) - bottom) AS amount FROM e)
        SELECT session_id, page, answer_id, floor(bottom * 1000 + 0.5)::BIGINT AS at_e3, floor(amount * 1000 + 0.5)::BIGINT AS amount_e3 FROM n WHERE amount > 0""",
    "answer_span": f"WITH {ANSWERS}, {GROUPS} SELECT session_id, canonical, array_to_string(list_sort(list_distinct(list(page))), ',') AS pages, count(DISTINCT page) > 1 AS several FROM resolved GROUP BY 1, 2",
    "page_count": f"WITH {ANSWERS} SELECT session_id, greatest(max(page), 1) AS pages FROM answers GROUP BY 1",
    "history_topk": f"{HISTORY} SELECT owner, session_id, percent, place FROM placed WHERE place <= 20",
    "history_window": f"{HISTORY} SELECT owner, session_id, percent FROM placed WHERE saved_at > TIMESTAMP '1995-12-25 00:00:00'",
    "history_page": f"{HISTORY}, k AS (SELECT *, ((count(*) OVER (PARTITION BY owner)) + 5) // 6 AS pages FROM placed WHERE place <= 20) SELECT owner, session_id, place, pages FROM k WHERE (place + 5) // 6 = least(2, pages)",
    "most_recent": f"{HISTORY} SELECT owner, session_id, percent FROM placed WHERE place = 1",
    "history_stats": f"{HISTORY} SELECT owner, count(*) AS n, ((2 * sum(percent) + count(*)) // (2 * count(*)))::BIGINT AS mean_percent, max(percent) AS best_percent FROM placed GROUP BY 1",
    "history_tiers": f"{HISTORY} SELECT session_id, percent, CASE WHEN percent >= 80 THEN 'Excellent' WHEN percent >= 50 THEN 'Average' ELSE 'Needs work' END AS tier FROM placed",
    "history_upsert": f"WITH {SAVES} SELECT owner, session_id, arg_max(percent, saved_at) AS percent, min(saved_at) = max(saved_at) AS saved_once FROM saves GROUP BY 1, 2",
    "progress_latest": """SELECT user_id AS session_id, CASE event_type WHEN 'signup' THEN 'idle' WHEN 'view' THEN 'extracting-questions' WHEN 'click' THEN 'extracting-answers' WHEN 'purchase' THEN 'done' ELSE 'error' END AS stage,
        json_extract_string(props, '$.k')::BIGINT AS percent, event_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1""",
    "json_props": "SELECT event_id, json_extract_string(props, '$.k')::BIGINT AS k FROM events",
    "format_bytes": """WITH d AS (SELECT DISTINCT floor(l_extendedprice * l_quantity)::BIGINT AS n FROM lineitem), t AS (SELECT n, floor(n / 1024::DOUBLE / 1024 * 10 + 0.5)::BIGINT AS m FROM d)
        SELECT n, CASE WHEN n < 1024 THEN n || 'B' WHEN n / 1024::DOUBLE < 1024 THEN floor(n / 1024::DOUBLE + 0.5)::BIGINT || 'KB' ELSE (m // 10) || '.' || (m % 10) || 'MB' END AS shown FROM t""",
    "format_marks": """WITH d AS (SELECT DISTINCT floor(l_quantity * 2) / 4::DOUBLE AS x FROM lineitem), t AS (SELECT x, floor(x * 10 + 0.5)::BIGINT AS m FROM d)
        SELECT x, CASE WHEN x = floor(x) THEN x::BIGINT::VARCHAR ELSE (m // 10) || '.' || (m % 10) END AS shown FROM t""",
    "upload_validation": """WITH u AS (SELECT page_id, url || CASE page_id % 4 WHEN 0 THEN '.pdf' WHEN 1 THEN '.PNG' WHEN 2 THEN '.jpeg' ELSE '' END AS name, CASE WHEN page_id % 7 = 0 THEN 0 ELSE length(html) * CASE WHEN page_id % 5 = 0 THEN 10000 ELSE 1 END END AS size FROM pages)
        SELECT page_id, CASE WHEN page_id % 3 <> 0 AND NOT regexp_matches(name, '\\.(pdf|png|jpe?g)$', 'i') THEN 'type' WHEN size > 10485760 THEN 'too-large' WHEN size = 0 THEN 'empty' END AS error FROM u""",
    "mime_resolution": """WITH u AS (SELECT page_id, url || CASE page_id % 4 WHEN 0 THEN '.pdf' WHEN 1 THEN '.PNG' WHEN 2 THEN '.jpeg' ELSE '' END AS name, CASE page_id % 3 WHEN 0 THEN 'image/jpg' WHEN 1 THEN 'text/plain' END AS declared FROM pages)
        SELECT page_id, CASE WHEN declared = 'image/jpg' THEN declared WHEN regexp_matches(name, '\\.pdf$', 'i') THEN 'application/pdf' WHEN regexp_matches(name, '\\.png$', 'i') THEN 'image/png' WHEN regexp_matches(name, '\\.jpe?g$', 'i') THEN 'image/jpeg' ELSE coalesce(declared, 'application/octet-stream') END AS mime FROM u""",
    "box_pad": f"""WITH {ANSWERS}, g AS (SELECT a.session_id, a.page, a.answer_id, a.seq, a.x, a.y, a.w, a.h, min(a.y - (b.y + b.h)) FILTER (b.y + b.h <= a.y AND a.answer_id <> b.answer_id) AS above, min(b.y - (a.y + a.h)) FILTER (b.y >= a.y + a.h AND a.answer_id <> b.answer_id) AS below
          FROM answers a JOIN answers b ON a.session_id = b.session_id AND a.page = b.page GROUP BY ALL)
        SELECT session_id, page, answer_id, seq, greatest(0::DOUBLE, x - 0.01::DOUBLE) AS left, least(1::DOUBLE, x + w + 0.01::DOUBLE) AS right, greatest(0::DOUBLE, y - least(0.012::DOUBLE, coalesce(above / 2, 0.012::DOUBLE))) AS top,
          least(1::DOUBLE, y + h + least(0.012::DOUBLE, coalesce(below / 2, 0.012::DOUBLE))) AS bottom FROM g""",
    "page_growth": f"{INSERTIONS} SELECT session_id, page, ceil(2000 + sum(amount_e3) / 1000::DOUBLE)::BIGINT AS pixels FROM ins GROUP BY 1, 2",
    "gap_remap": f"{INSERTIONS} SELECT a.session_id, a.page, a.answer_id, coalesce(sum(i.amount_e3), 0)::BIGINT AS shift_e3 FROM answers a LEFT JOIN ins i ON a.session_id = i.session_id AND a.page = i.page AND i.bottom <= a.y * 2000::DOUBLE GROUP BY 1, 2, 3",
    "page_boxes": f"WITH {ANSWERS} SELECT session_id, answer_id, y * 100 AS top_percent, h * 100 AS height_percent FROM answers WHERE page = 1",
    "strip_fences": BROKEN + r" SELECT event_id, regexp_replace(regexp_replace(regexp_replace(raw, '^```(?:json)?\s*', '', 'i'), '```\s*$', ''), '^\s+|\s+$', '', 'g') AS clean FROM broken",
    "fix_commas": BROKEN + r" SELECT event_id, regexp_replace(translate(raw, '“”‘’', '" + '""' + "''''" + r"'), ',\s*([}\]])', '\1', 'g') AS clean FROM broken",
    "progress_percent": "SELECT event_id, 5 + floor(30 * (event_id % 7) / (event_id % 5 + 7)::DOUBLE + 0.5)::BIGINT AS questions_percent, 35 + floor(30 * (event_id % 7) / (event_id % 5 + 7)::DOUBLE + 0.5)::BIGINT AS answers_percent FROM events",
    "ttl_sweep": "SELECT user_id AS session_id, max(ts) - min(ts) > INTERVAL 120 MINUTE AS expired FROM events GROUP BY 1",
    "session_latest": "SELECT user_id AS session_id, (arg_max(json_extract_string(props, '$.k')::BIGINT, {'a': ts, 'b': event_id}) FILTER (event_type = 'purchase')) AS done_percent, count(*) AS updates FROM events GROUP BY 1",
    "guard_index": "SELECT event_id, CASE WHEN json_extract_string(props, '$.k')::BIGINT BETWEEN 0 AND 49 THEN json_extract_string(props, '$.k')::BIGINT END AS index FROM events",
    "union_pages": "SELECT 'customer' AS source, c_custkey AS key, c_name AS name, c_nationkey AS nation FROM customer UNION ALL SELECT 'supplier', s_suppkey, s_name, s_nationkey FROM supplier",
    "array_ops": """WITH g AS (SELECT l_orderkey, list(l_linenumber ORDER BY l_linenumber) AS a FROM lineitem GROUP BY 1)
        SELECT l_orderkey, len(list_distinct(a))::BIGINT AS n_distinct, list_min(a) > 1 AS all_above_1, list_contains(a, 3) AS has_3, array_to_string(a[2:], ',') AS rest, coalesce(list_position(a, 2), 0)::BIGINT AS at_2 FROM g""",
}
ORACLES["orphan_caption"] = f"""SELECT o.session_id, o.answer_id, 'Page ' || l.page || ' • ' || CASE
      WHEN o.reason = 'duplicate-of-mapped' THEN 'Looks like a duplicate/extra attempt at Q' || (SELECT any_value(CASE WHEN n <= 7 THEN 'Q' || n ELSE (n - 7) || '(a)' END) FROM range(1, 11) t(n) WHERE o.guess_question_id = o.session_id || '-q' || n)
      WHEN l.raw_label IS NULL THEN 'No question number could be identified' ELSE 'Student wrote "' || l.raw_label || '" but no matching question was found' END AS caption
    FROM ({ORACLES['orphans']}) o JOIN (WITH {ANSWERS} SELECT answer_id, page, raw_label FROM answers) l ON l.answer_id = o.answer_id"""
ORACLES["merge_answers"] = f"""{LINK} SELECT session_id, question_id, full_text AS merged FROM mappings WHERE answer_id IS NOT NULL"""
ORACLES["display_labels"] = f"""{LINK}, named AS (SELECT m.session_id, m.answer_id, q.label FROM mappings m JOIN questions q ON m.question_id = q.question_id WHERE m.answer_id IS NOT NULL)
    SELECT a.session_id, a.answer_id, CASE WHEN n.answer_id IS NULL THEN 'Unmapped' ELSE 'Q' || n.label END AS shown FROM answers a LEFT JOIN named n ON a.session_id = n.session_id AND a.answer_id = n.answer_id"""
ORACLES["warnings"] = f"""WITH {ANSWERS}, n AS (
      SELECT session_id, page, seq, 0 AS k, 'low confidence: ' || answer_id AS note FROM answers WHERE low_confidence UNION ALL SELECT session_id, page, seq, 1, 'crossed out: ' || answer_id FROM answers WHERE crossed_out)
    SELECT s.session_id, coalesce(string_agg(n.note, '; ' ORDER BY n.page, n.seq, n.k), '') AS warnings FROM (SELECT DISTINCT session_id FROM answers) s LEFT JOIN n ON s.session_id = n.session_id GROUP BY 1"""
ORACLES["json_repair"] = BROKEN + r""", p AS (SELECT e.event_id, replace(e.props, ' ', '') AS one FROM events e)
    SELECT event_id, CASE WHEN event_id % 8 < 4 THEN one WHEN event_id % 8 = 4 THEN '{"items":[' || one || ',' || one || ']}' WHEN event_id % 8 = 5 THEN '{"note":"it''s it''s","p":[' || one || ']}'
      WHEN event_id % 8 = 6 THEN '{"a":"\ud800","p":' || one || '}' ELSE '{"a":[null,-9],"p":' || one || '}' END AS value FROM p"""
ORACLES["entry_formats"] = f"""WITH {SAVES}, u AS (SELECT session_id, min(saved_at) AS created_at, max(saved_at) AS last_saved, arg_max(percent, saved_at) AS percent FROM saves GROUP BY session_id)
    SELECT session_id, strftime(last_saved, '%-d %b %Y, %I:%M %p') AS saved, last_saved - created_at > INTERVAL 60 SECOND AS opened_later, floor(percent / 101.0::DOUBLE * 100 + 0.5)::BIGINT || '%' AS confidence,
      CASE WHEN percent % 10 = 0 THEN '—' WHEN percent % 2 = 0 THEN (percent // 2) || '/50' ELSE (percent // 2) || '.5/50' END AS score, 100 - greatest(0, least(100, percent * 2 - 20)) AS offset FROM u"""
RUNS = f"""{ANSWERS}, runs AS (
      SELECT session_id, page, x, y, w, h / 8 AS h, 'ans ' || (seq % 4 + 1) || '. words' AS text, seq * 2 AS run FROM answers UNION ALL SELECT session_id, page, x / 2, y + h / 8, w, h / 8, 'more words', seq * 2 + 1 FROM answers),
    placed AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY page, y, run) - 1 AS place FROM runs),
    claims AS (SELECT session_id, place, row_number() OVER (PARTITION BY session_id, split_part(text, '.', 1) ORDER BY place) AS r, split_part(text, '.', 1) AS label FROM placed WHERE text LIKE 'ans %'),
    asked AS (SELECT session_id, answer_id, seq, 'ans ' || (seq % 4 + 1) AS label, row_number() OVER (PARTITION BY session_id, seq % 4 ORDER BY seq) AS r FROM answers WHERE seq % 5 <> 4),
    anchors AS MATERIALIZED (SELECT a.session_id, a.answer_id, a.seq, c.place FROM asked a JOIN claims c ON a.session_id = c.session_id AND a.label = c.label AND a.r = c.r)"""
ORACLES["anchor_runs"] = f"WITH {RUNS} SELECT session_id, answer_id, place FROM anchors"
ORACLES["run_spans"] = f"""WITH {RUNS}, starts AS (SELECT a.*, p.page, p.y FROM anchors a JOIN placed p ON a.session_id = p.session_id AND a.place = p.place),
    spans AS (SELECT s.*, lead(place) OVER (PARTITION BY session_id, page ORDER BY place) AS stop, lead(y) OVER (PARTITION BY session_id, page ORDER BY place) AS below FROM starts s),
    extent AS (SELECT s.session_id, s.answer_id, s.seq, s.page, any_value(s.below) AS below, min(p.x) AS l, max(p.x + p.w) AS r, min(p.y) AS top, max(p.y + p.h) AS b
      FROM spans s JOIN placed p ON p.session_id = s.session_id AND p.page = s.page AND p.place >= s.place AND (s.stop IS NULL OR p.place < s.stop) GROUP BY 1, 2, 3, 4),
    seen AS (SELECT e.*, a.has_diagram AS d, CASE WHEN a.seq % 3 <> 2 THEN a.page END AS rough_page, a.x AS rx, a.w AS rw FROM extent e JOIN answers a ON e.session_id = a.session_id AND e.answer_id = a.answer_id),
    tight AS (SELECT session_id, answer_id, seq, page, CASE WHEN d AND rough_page = page THEN least(l, rx) ELSE l END AS "left", CASE WHEN d AND rough_page = page THEN greatest(r, rx + rw) ELSE r END AS "right", top,
      CASE WHEN d THEN coalesce(below, 1::DOUBLE) ELSE b END AS bottom FROM seen),
    capped AS (SELECT t.*, (SELECT arg_min(a.y + 0.01::DOUBLE, a.seq) FROM answers a WHERE a.session_id = t.session_id AND a.page = t.page AND a.seq > t.seq AND a.seq % 3 <> 2) AS ceiling FROM tight t)
    SELECT session_id, answer_id, page, "left", "right", top, CASE WHEN ceiling > top THEN least(bottom, ceiling) ELSE bottom END AS bottom FROM capped"""
ORACLES["render_dims"] = """WITH s AS (SELECT p_partkey, p_size * 30.0::DOUBLE AS w, p_retailprice AS h, 200::DOUBLE / 72 AS f, p_size * 40 AS iw, floor(p_retailprice)::BIGINT AS ih FROM part),
    k AS (SELECT *, CASE WHEN greatest(w, h) * f > 2200 THEN f * (2200::DOUBLE / (greatest(w, h) * f)) ELSE f END AS scale FROM s)
    SELECT p_partkey, ceil(w * scale)::BIGINT AS width, ceil(h * scale)::BIGINT AS height, CASE WHEN least(iw, ih) < 900 THEN floor(iw * (1200::DOUBLE / least(iw, ih)) + 0.5)::BIGINT ELSE iw END AS image_width FROM k"""
ORACLES["sse_parse"] = """SELECT user_id AS session_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS pos, event_id,
    CASE event_type WHEN 'signup' THEN 'idle' WHEN 'view' THEN 'extracting-questions' WHEN 'click' THEN 'extracting-answers' WHEN 'purchase' THEN 'done' ELSE 'error' END AS stage, json_extract_string(props, '$.k')::BIGINT AS percent FROM events"""
ORACLES["highlight_boxes"] = f"""{LINK}, used AS (SELECT *, row_number() OVER (PARTITION BY session_id, canonical ORDER BY seq) - 1 AS pos FROM resolved WHERE role <> 'duplicate')
    SELECT m.session_id, m.question_id, u.pos, u.answer_id, u.page, u.y, u.h FROM mappings m JOIN used u ON m.session_id = u.session_id AND coalesce(m.near, m.canonical) = u.canonical WHERE m.by_number
    UNION ALL SELECT m.session_id, m.question_id, 0, a.answer_id, a.page, a.y, a.h FROM mappings m JOIN answers a ON m.session_id = a.session_id AND m.answer_id = a.answer_id WHERE m.answer_id IS NOT NULL AND NOT m.by_number"""
# The same rules over turns: other blocks, which bear a label of their own.
_blocks, _rules = ORACLES["split_labels"].split(" FROM documents),", 1)
ORACLES["split_labels_whole"] = (
    r"""WITH b AS (SELECT conv_id || '-' || turn AS block_id, 'Q' || turn || ':' AS raw_label, turn::VARCHAR AS number,
          ' ' || replace(text, chr(10), ' ') || CASE WHEN turn % 2 = 1 THEN ' figure for question ' || (turn - 1) || 'b' ELSE '' END AS body, role = 'assistant' AS has_diagram FROM conversations),"""
    + _rules
)
ORACLES |= flow_oracles.ORACLES | flow_oracles.late_oracles(ANSWERS, canonical, HISTORY)


def any_space(sql: str) -> str:
    """White space in patterns, spelled out: ``\\s`` is ASCII in DuckDB."""
    return re.sub(r"(?<=[-9])\\s(?=\])", lambda _: SPACES, sql).replace(r"\s", SPACE)


ORACLES = {name: any_space(sql) for name, sql in ORACLES.items()}
