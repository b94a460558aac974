"""SQL for DuckDB of the queries of stores, streams and files, written apart from the DataFrame code."""

from __future__ import annotations

from tandem.functions.fixed import BLANKS

CALLS = "c AS (SELECT user_id AS session_id, event_id, epoch_us(ts) // 10000000 AS at_ms, event_type IN ('error', 'click') AS failed, event_type = 'error' AS limited FROM events)"
STAGE = "CASE event_type WHEN 'signup' THEN 'idle' WHEN 'view' THEN 'extracting-questions' WHEN 'click' THEN 'extracting-answers' WHEN 'purchase' THEN 'done' ELSE 'error' END"
K = "json_extract_string(props, '$.k')"


def last(value: str, given: str) -> str:
    """The value of the latest of the events that give one, null if it is."""
    return f"(max({{'t': ts, 'i': event_id, 'v': {value}}}) FILTER (event_type IN ({given}))).v"


SNAPSHOTS = f"""
SELECT user_id AS session_id, min(ts) AS created_at, coalesce({last(STAGE, "'view', 'click', 'purchase', 'error'")}, 'idle') AS stage, {last(f"CASE event_type WHEN 'purchase' THEN {K}::BIGINT END", "'purchase', 'click'")} AS percent,
  {last(f"CASE event_type WHEN 'error' THEN 'e' || {K} END", "'purchase', 'error'")} AS error, {last(f"{K}::BIGINT", "'view'")} AS questions, {last(f"{K}::BIGINT", "'click'")} AS answers
FROM events GROUP BY 1
"""
EVENTS = f"SELECT user_id AS session_id, event_id, {STAGE} AS stage, {K}::BIGINT AS percent FROM events"

ORACLES = {
    "call_spacing": f"""WITH {CALLS}, n AS (SELECT *, 4000 * (row_number() OVER (PARTITION BY session_id ORDER BY at_ms, event_id) - 1) AS g FROM c),
s AS (SELECT *, g + max(at_ms - g) OVER (PARTITION BY session_id ORDER BY at_ms, event_id ROWS UNBOUNDED PRECEDING) AS start_ms FROM n)
SELECT session_id, event_id, start_ms::BIGINT AS start_ms, (start_ms - at_ms)::BIGINT AS wait_ms FROM s""",
    "call_backoff": f"""WITH RECURSIVE {CALLS}, n AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY at_ms, event_id) AS i FROM c),
s AS (
  SELECT session_id, event_id, i, failed, 1 AS attempt, CASE WHEN limited THEN 2000 WHEN failed THEN 500 ELSE 0 END AS backoff_ms, at_ms AS start_ms FROM n WHERE i = 1
  UNION ALL
  SELECT n.session_id, n.event_id, n.i, n.failed, a.attempt, CASE WHEN n.limited THEN 2000 * a.attempt WHEN n.failed THEN 500 * a.attempt ELSE 0 END, greatest(n.at_ms, s.start_ms + greatest(4000, s.backoff_ms))
  FROM s JOIN n ON n.session_id = s.session_id AND n.i = s.i + 1, LATERAL (SELECT CASE WHEN s.failed THEN s.attempt % 3 + 1 ELSE 1 END AS attempt) a)
SELECT session_id, event_id, attempt::BIGINT AS attempt, backoff_ms::BIGINT AS backoff_ms, start_ms::BIGINT AS start_ms FROM s""",
    "session_snapshots": SNAPSHOTS,
    "snapshot_store": SNAPSHOTS,
    "event_sink": EVENTS,
    "resumed_sink": EVENTS,
    "delivered_events": f"""WITH c AS (SELECT c_custkey AS subscriber, c_custkey * 7 % 100 AS session_id, TIMESTAMP '2024-01-01 12:00:00' + INTERVAL 1 DAY * (c_custkey % 20) AS since FROM customer),
t AS (SELECT subscriber, session_id, since, since + INTERVAL 5 DAY AS until FROM c UNION ALL SELECT subscriber, session_id, since + INTERVAL 8 DAY, NULL FROM c WHERE subscriber % 3 = 0)
SELECT t.subscriber, e.user_id AS session_id, e.event_id, {STAGE} AS stage FROM events e JOIN t ON e.user_id = t.session_id AND e.ts >= t.since AND (t.until IS NULL OR e.ts < t.until)""",
    "landed_uploads": """WITH u AS (
  SELECT 's' || page_id % 50 AS session_id, CASE WHEN page_id % 9 = 0 THEN 'cover' WHEN page_id % 2 = 0 THEN 'questionPaper' ELSE 'answerSheet' END AS kind,
    page_id || '-' || url || CASE page_id % 4 WHEN 0 THEN '.pdf' WHEN 1 THEN '.PNG' WHEN 2 THEN '.jpeg' ELSE '' END AS name, CASE page_id % 3 WHEN 0 THEN 'image/jpg' WHEN 1 THEN 'text/plain' END AS declared,
    CASE WHEN page_id % 7 = 0 THEN '' ELSE html END AS content FROM pages),
m AS (
  SELECT *, strlen(content) AS size, CASE WHEN kind = 'cover' THEN 'request' WHEN coalesce(declared, '') <> 'image/jpg' AND NOT regexp_matches(name, '(?i)\\.(pdf|png|jpe?g)$') THEN 'type' WHEN strlen(content) > 8000 THEN 'too-large' WHEN content = '' THEN 'empty' END AS error,
    CASE WHEN declared = 'image/jpg' THEN declared WHEN name ILIKE '%.pdf' THEN 'application/pdf' WHEN name ILIKE '%.png' THEN 'image/png' WHEN name ILIKE '%.jpeg' THEN 'image/jpeg' ELSE coalesce(declared, 'application/octet-stream') END AS mime FROM u)
SELECT session_id, kind, name, error, mime, size, CASE WHEN error IS NULL THEN session_id || '/' || kind || '/' || left(sha256(name || chr(10) || sha256(content)), 10) || '.'
    || CASE mime WHEN 'application/pdf' THEN 'pdf' WHEN 'image/png' THEN 'png' WHEN 'image/jpeg' THEN 'jpg' WHEN 'image/jpg' THEN 'jpg' ELSE 'bin' END END AS stored_path, CASE WHEN error IS NULL THEN sha256(content) END AS content_sha256 FROM m""",
    "page_lookup": """WITH r AS (
  SELECT DISTINCT l_orderkey AS s, CASE l_linenumber % 4 WHEN 0 THEN 'questionPaper' WHEN 3 THEN 'cover' ELSE 'answerSheet' END AS kind, ['1', ' 2.0 ', '3', '0', '1.5', 'x'][l_suppkey % 6 + 1] AS page FROM lineitem),
a AS (
  SELECT *, CASE WHEN kind = 'cover' THEN 'Invalid document kind.' WHEN page IN ('0', '1.5', 'x') THEN 'Invalid page number.' END AS bad, CASE page WHEN '1' THEN 1 WHEN ' 2.0 ' THEN 2 ELSE 3 END AS n FROM r),
f AS (
  SELECT a.*, CASE WHEN o_orderkey IS NULL THEN NULL WHEN s % 3 = 0 AND n < 3 THEN 'img/' || s || '/' || kind || '/' || n
      WHEN s % 5 < 2 THEN CASE WHEN kind = 'answerSheet' OR s % 5 = 0 THEN 'mem/' || s END
      WHEN s % 7 <> 0 THEN CASE WHEN kind = 'answerSheet' THEN 'sheet/' || s WHEN s % 4 <> 0 THEN 'paper/' || s END END AS found
  FROM a LEFT JOIN orders ON o_orderkey = s)
SELECT s AS session_id, kind, page, CASE WHEN bad IS NOT NULL THEN 400 WHEN found IS NULL THEN 404 ELSE 302 END::INTEGER AS status, CASE WHEN bad IS NULL THEN found END AS location,
  coalesce(bad, CASE WHEN found IS NULL THEN 'Page image not found.' END) AS error FROM f""",
    "blob_files": "SELECT (page_id % 10)::VARCHAR AS session_id, 'p ' || page_id AS file_id, strlen(html) AS length, sha256(html) AS content_sha256 FROM pages WHERE page_id % 10 NOT IN (3, 7)",
    "wrapped_text": rf"""WITH RECURSIVE t AS (SELECT doc_id, trim(regexp_replace(text, '{BLANKS}', ' ', 'g'), ' ') AS rest FROM documents),
steps AS (
  SELECT doc_id, 0 AS i, NULL::VARCHAR AS line, rest FROM t
  UNION ALL
  SELECT doc_id, i + 1, left(rest, cut), substr(rest, cut + 2)
  FROM (SELECT *, CASE WHEN length(rest) <= 82 THEN length(rest) WHEN instr(left(rest, 83), ' ') > 0 THEN length(regexp_extract(left(rest, 83), '^(.+) [^ ]*$', 1))
      WHEN instr(rest, ' ') > 0 THEN instr(rest, ' ') - 1 ELSE length(rest) END AS cut FROM steps WHERE rest <> '')),
l AS (SELECT doc_id, count(*) AS n_lines, max(length(line)) AS longest, sha256(string_agg(line, chr(10) ORDER BY i)) AS lines_sha256 FROM steps WHERE i > 0 GROUP BY 1)
SELECT t.doc_id, CASE WHEN t.rest IS NOT NULL THEN coalesce(l.n_lines, 0) ELSE -1 END::BIGINT AS n_lines, l.longest, CASE WHEN t.rest IS NOT NULL THEN coalesce(l.lines_sha256, sha256('')) END AS lines_sha256 FROM t LEFT JOIN l ON l.doc_id = t.doc_id""",
    "nested_orders": """SELECT l_orderkey AS session_id, strftime(o_orderdate, '%Y-%m-%d') AS placed, l_linenumber::BIGINT AS number, l_quantity AS quantity, l_returnflag AS label
FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE (l_orderkey // 500) % 7 <> 3""",
}


def late_oracles(answers: str, canonical, history: str) -> dict[str, str]:
    """SQL that is built on the fixtures of the catalogue."""
    hyp = lambda x, y: f"sqrt({x} * {x} + {y} * {y})"
    e9 = lambda x, n: f"floor(({x}) * 1000000000 + 0.5)::BIGINT AS {n}_e9"
    return {
        "question_records": """WITH r AS (
  SELECT o_orderkey AS s, o_orderkey % 3 + 1 AS page, n, 10 - n AS pos, CASE WHEN n <= 7 THEN 'Q' || n ELSE (n - 7) || '(a)' END AS label, CASE WHEN n <= 7 THEN n * 100 ELSE (n - 7) * 100 + 1 END AS k FROM orders, range(1, 11) t(n) WHERE o_orderkey % 11 <> 0)
SELECT s AS session_id, s || '-q' || page || '-0-' || pos AS question_id, row_number() OVER (PARTITION BY s ORDER BY k, pos) AS place, k::BIGINT AS sort_key, label, 'describe ' || n AS text, page, CASE WHEN (s + n) % 5 <> 0 THEN (s + n) % 5 + 1 END::DOUBLE AS marks,
  CASE WHEN (s + n) % 3 <> 0 THEN page END AS region_page, CASE WHEN (s + n) % 3 <> 0 THEN n / 32.0::DOUBLE END AS region_y, (s + n) % 13 = 0 AND (s + n) % 4 <> 0 AS low_confidence FROM r""",
        "answer_records": f"""WITH {answers}, r AS (SELECT *, unnest(CASE WHEN has_diagram THEN [0, 1] ELSE [0] END) AS pos FROM answers)
SELECT session_id, session_id || '-a' || page || '-' || seq || '-' || pos AS answer_id, row_number() OVER (PARTITION BY session_id ORDER BY page, seq, pos) - 1 AS sequence_index, {canonical('raw_label')} AS canonical,
  CASE pos WHEN 0 THEN 'text ' || seq ELSE 'drawn' END AS text, CASE WHEN seq % 5 = 0 THEN seq + 1 ELSE page END AS page, (seq % 4 <> 3)::BIGINT AS n_boxes, CASE WHEN seq % 4 <> 3 THEN CASE WHEN seq % 5 = 0 THEN seq + 1 ELSE page END END AS box_page,
  has_diagram AS contains_diagram, false AS contains_table, crossed_out, low_confidence FROM r""",
        "run_fractions": f"""WITH m AS (
  SELECT *, CASE WHEN l_suppkey % 5 = 0 THEN 5.0::DOUBLE ELSE 12.0 END AS wide, 'Ans ' || l_linenumber AS text, 32.0::DOUBLE * l_linenumber AS e, 64.0::DOUBLE * l_linenumber AS f FROM lineitem WHERE l_suppkey % 7 <> 0),
h AS (SELECT *, CASE WHEN l_suppkey % 3 <> 0 THEN 10.0::DOUBLE + l_suppkey % 2 ELSE wide END AS high FROM m)
SELECT l_orderkey, l_linenumber, l_suppkey, text, {e9('e / 612::DOUBLE', 'x')}, {e9('(792::DOUBLE - (f + high * 0.82::DOUBLE)) / 792::DOUBLE', 'y_top')}, {e9('(792::DOUBLE - (f - high * 0.28::DOUBLE)) / 792::DOUBLE', 'y_bottom')},
  {e9('CASE WHEN l_suppkey % 4 <> 0 THEN l_quantity ELSE wide * length(text) END / 612::DOUBLE', 'width')} FROM h""",
        "word_fractions": """SELECT l_orderkey, l_linenumber, l_suppkey, (l_suppkey % 100) / 256::DOUBLE AS x, l_linenumber * 10 / 128::DOUBLE AS y, floor(l_quantity) / 256::DOUBLE AS width, 8 / 128::DOUBLE AS height FROM lineitem""",
        "box_style": f"""WITH {answers}, s AS (SELECT session_id, answer_id, floor(x * 64) / 64 * 100 AS l, floor(y * 64) / 64 * 100 AS t, floor(h * 64) / 64 * 100 AS h FROM answers)
SELECT session_id, answer_id, l::VARCHAR || '%' AS "left", t::VARCHAR || '%' AS top, '50.0%' AS width, h::VARCHAR || '%' AS height FROM s""",
        "file_pages": f"""WITH {answers}, a AS (SELECT session_id, max(page) AS highest FROM answers GROUP BY 1)
SELECT coalesce(a.session_id, o_orderkey) AS session_id, greatest(coalesce(CASE WHEN o_orderkey % 4 <> 0 THEN o_orderkey % 4 END, 1), coalesce(highest, 1), 1)::BIGINT AS pages FROM a FULL JOIN orders ON a.session_id = o_orderkey""",
        "history_showing": f"""{history}, k AS (SELECT owner, count(*) AS n FROM placed WHERE place <= 20 GROUP BY 1), p AS (SELECT *, least(2, (n + 5) // 6) AS nr FROM k)
SELECT owner, CASE WHEN n > 6 THEN 'Showing ' || ((nr - 1) * 6 + 1) || '–' || least(nr * 6, n) || ' of ' || n || ' exams' END AS showing FROM p""",
        "guarded_matches": """SELECT event_id, CASE WHEN json_extract_string(props, '$.k')::BIGINT % 4 = 0 AND json_extract_string(props, '$.k')::BIGINT // 4 BETWEEN 0 AND 6 THEN json_extract_string(props, '$.k')::BIGINT // 4 END AS index,
  CASE WHEN event_id % 9 = 0 THEN 0 ELSE greatest(0::DOUBLE, least(1::DOUBLE, value / 100 - 0.25::DOUBLE)) END::DOUBLE AS confidence FROM events""",
    }
