"""DuckDB SQL for the queries that SQL can express."""

#: Upper and lower case of letters beyond ASCII stay; words, lines and windows as in quality_rules.
OP8 = r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT rid, unnest(regexp_extract_all(t, '[^\x20\x09-\x0D]+')) AS word, generate_subscripts(regexp_extract_all(t, '[^\x20\x09-\x0D]+'), 1) AS pos FROM d),
g AS (SELECT rid, pos, word, lead(word, 1) OVER o AS b, lead(word, 2) OVER o AS c FROM w WINDOW o AS (PARTITION BY rid ORDER BY pos)),
r AS (SELECT rid, pos, count(*) OVER (PARTITION BY rid, word, b, c) > 1 AND c IS NOT NULL AS twice FROM g),
v AS (SELECT rid, count(*) AS n_words, count(*) FILTER (hit) AS n_repeat_words FROM (
  SELECT rid, twice OR coalesce(lag(twice, 1) OVER o, false) OR coalesce(lag(twice, 2) OVER o, false) AS hit FROM r WINDOW o AS (PARTITION BY rid ORDER BY pos)) GROUP BY rid),
l AS (SELECT rid, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n_dup_lines FROM (SELECT rid, unnest(string_split(t, chr(10))) AS line FROM d) WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY rid),
m AS (SELECT d.rid, d.doc_id, coalesce(v.n_words, 0) AS n_words, length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g')) AS word_chars,
  length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g')) AS n_symbols, coalesce(l.n_dup_lines, 0) AS n_dup_lines, coalesce(v.n_repeat_words, 0) AS n_repeat_words,
  coalesce(l.n_lines, 0) AS n_lines, length(regexp_replace(t, '[^A-Za-z]+', '', 'g')) AS n_letters, length(regexp_replace(t, '[^A-Z]+', '', 'g')) AS n_upper
  FROM d LEFT JOIN v USING (rid) LEFT JOIN l USING (rid)),
b AS (SELECT *, (CASE WHEN n_words < 50 THEN 1 ELSE 0 END) + (CASE WHEN 100 * n_repeat_words > 50 * n_words THEN 2 ELSE 0 END) + (CASE WHEN 10 * n_symbols > n_words THEN 4 ELSE 0 END)
  + (CASE WHEN n_words > 0 AND (word_chars < 2 * n_words OR word_chars > 20 * n_words) THEN 8 ELSE 0 END) + (CASE WHEN 10 * n_dup_lines > 3 * n_lines THEN 16 ELSE 0 END)
  + (CASE WHEN 10 * n_upper > 6 * n_letters AND n_letters > 0 THEN 32 ELSE 0 END) AS failed FROM m)
SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols, n_dup_lines::BIGINT AS n_dup_lines, n_repeat_words::BIGINT AS n_repeat_words,
  (failed & 3) <> 0 AS base_failed, (failed & 47) = 0 AS kept, failed::BIGINT AS failed_bits FROM b
"""

OP7 = r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
i AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark WHERE item_id IS NOT NULL),
s AS (SELECT *, least(len(ws), 13) AS k, unnest(range(1, greatest(len(ws) - 13, 0) + 2)) AS p FROM i WHERE len(ws) > 0),
f AS (SELECT DISTINCT item_id, k, array_to_string(ws[p:p + k - 1], ' ') AS phrase FROM s),
k AS (SELECT DISTINCT k FROM f),
g AS (SELECT rid, ws, k, unnest(range(1, len(ws) - k + 2)) AS p FROM d, k WHERE len(ws) >= k),
h AS (SELECT g.rid, g.k, g.p, f.item_id FROM g JOIN f ON f.k = g.k AND f.phrase = array_to_string(g.ws[g.p:g.p + g.k - 1], ' ')),
c AS (SELECT rid, count(DISTINCT pos) AS n_hit FROM (SELECT rid, unnest(range(p, p + k)) AS pos FROM h) GROUP BY rid),
t AS (SELECT rid, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids FROM (SELECT DISTINCT rid, item_id::VARCHAR AS id FROM h) GROUP BY rid)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(ws) AS contaminated
FROM d LEFT JOIN c USING (rid) LEFT JOIN t USING (rid)
"""

OP1 = r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(ws[p:p + 3], ' ') AS shingle FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 4, 0) + 2)) AS p FROM d WHERE len(ws) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
o AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS same FROM s a JOIN s b ON a.shingle = b.shingle AND a.doc_id <> b.doc_id GROUP BY 1, 2),
l AS (SELECT x, y FROM o JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * same >= 85 * (a.n + b.n - same)),
r AS (SELECT doc_id AS x, doc_id AS y FROM d UNION SELECT r.x, l.y FROM r JOIN l ON l.x = r.y)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, m.c AS component_id
FROM d LEFT JOIN n USING (doc_id) JOIN (SELECT x AS doc_id, min(y) AS c FROM r GROUP BY x) m USING (doc_id)
"""

OP9 = r"""
WITH p AS (SELECT page_id, coalesce(html, '') AS t FROM pages),
f AS (SELECT t, min(page_id) AS first FROM p WHERE strlen(t) >= 100 GROUP BY t)
SELECT page_id, strlen(p.t)::BIGINT AS payload_bytes, sha256(p.t) AS payload_digest, CASE WHEN f.first IS NULL OR page_id = f.first THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> f.first THEN f.first END AS refers_to FROM p LEFT JOIN f ON p.t = f.t
"""

OP6 = r"""
WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS line_no FROM documents WHERE text IS NOT NULL),
z AS (SELECT *, regexp_extract_all(lower(line), '[^ \t\x0B\f\r]+') AS w FROM l),
e AS (SELECT doc_id, line, line_no, CASE WHEN len(w) = 0 THEN [] ELSE list_distinct(list_transform(range(1, greatest(len(w) - 4, 1) + 1), lambda i: array_to_string(w[i:i + 4], ' '))) END AS ws FROM z),
s AS (SELECT *, row_number() OVER (ORDER BY doc_id, line_no) AS id FROM e WHERE len(ws) > 0),
f AS (SELECT w, count(*) AS c FROM (SELECT unnest(ws) AS w FROM s) GROUP BY w),
o AS (SELECT id, n, w, row_number() OVER (PARTITION BY id ORDER BY c, w) AS r FROM (SELECT id, len(ws) AS n, unnest(ws) AS w FROM s) JOIN f USING (w)),
x AS (SELECT id, n, w FROM o WHERE r <= n - (4 * n + 4) // 5 + 1),
c AS (SELECT DISTINCT a.id AS later, b.id AS earlier FROM x a JOIN x b ON a.w = b.w AND b.id < a.id AND 4 * a.n <= 5 * b.n AND 4 * b.n <= 5 * a.n),
v AS (SELECT later, len(a.ws) AS n, len(b.ws) AS m, len(list_intersect(a.ws, b.ws)) AS o FROM c JOIN s a ON a.id = later JOIN s b ON b.id = earlier),
g AS (SELECT DISTINCT s.doc_id, s.line_no FROM v JOIN s ON s.id = v.later WHERE 5 * o >= 4 * (n + m - o)),
k AS (SELECT e.doc_id, count(g.line_no) AS n_gone, string_agg(line, chr(10) ORDER BY e.line_no) FILTER (g.line_no IS NULL) AS kept FROM e LEFT JOIN g ON g.doc_id = e.doc_id AND g.line_no = e.line_no GROUP BY e.doc_id)
SELECT d.doc_id, coalesce(n_gone, 0)::BIGINT AS n_lines_removed, CASE WHEN d.text IS NULL THEN NULL ELSE sha256(coalesce(kept, '')) END AS text_sha256 FROM documents d LEFT JOIN k USING (doc_id)
"""

def _cheapest(*options: str) -> str:
    """The least of (cost, audit, text) structs."""
    return f"list_sort([{', '.join(options)}])[1]"


def _edit(initial: str, cost: str, line: str, then: str) -> str:
    return f"{{'c': {then}.c + {cost}, 'a': '{initial}' || {then}.a, 'x': {line} || {then}.x}}"


def _scanned(state: str, kept: dict[str, str], role: str, then: str) -> str:
    """Delete, rerole or keep a row before what ``state`` awaits; kept: the state that follows each initial."""
    more = 1_000_000_000
    keep = " ".join(f"WHEN r.init = '{i}' THEN {_edit('K', 'r.more', 'r.line', t)}" for i, t in kept.items())
    never = f"{{'c': {more}, 'a': '', 'x': ''}}"
    return _cheapest(_edit("D", "4", "''", state), f"CASE WHEN r.gone THEN {never} {keep} ELSE {never} END", f"CASE WHEN r.gone THEN {never} ELSE {_edit('R', '3 + r.more', f"'{role}:' || r.text || chr(10)", then)} END")


#: s, p, q, t: what a conversation may still be before its first row, after a system turn, after a user's and after an assistant's.
OP13 = rf"""
WITH RECURSIVE b AS (SELECT list_transform(range(256), lambda v: list_reduce([v, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, z: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t),
a AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS key FROM conversations),
k AS (SELECT a.*, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(key, ''), lambda ch: ascii(ch)::BIGINT)), lambda c, z: xor(c >> 8, b.t[(xor(c, z) & 255) + 1])), 4294967295) % 20 AS code FROM a, b),
g AS (SELECT conv_id, turn, CASE WHEN code = 4 THEN 'user' ELSE role END AS role, CASE code WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text, unnest(range(CASE code WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)) AS copy FROM k),
o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS pos, count(*) OVER (PARTITION BY conv_id) AS n FROM g),
f AS (SELECT *, left(role, 1) AS init, trim(text, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS inner_, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY pos) AS nth, lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY pos) AS before FROM o),
h AS (SELECT *, CASE WHEN inner_ = '' THEN 'blank' WHEN nth > 1 THEN 'duplicate' WHEN right(inner_, 1) NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault FROM f),
r AS (SELECT conv_id, n - pos + 1 AS back, init, text, fault IN ('blank', 'duplicate') AS gone, CASE WHEN fault = 'truncated' THEN 3 ELSE 0 END AS more, role || ':' || text || chr(10) AS line FROM h),
v AS (SELECT DISTINCT conv_id, 0::BIGINT AS back, {{'c': 0::BIGINT, 'a': '', 'x': ''}} AS s, {{'c': 6::BIGINT, 'a': 'II', 'x': 'user:' || chr(10) || 'assistant:' || chr(10)}} AS p, {{'c': 3::BIGINT, 'a': 'I', 'x': 'assistant:' || chr(10)}} AS q, {{'c': 0::BIGINT, 'a': '', 'x': ''}} AS t FROM r
  UNION ALL
  SELECT conv_id, back, {_cheapest('s', _edit('I', '3', "'user:' || chr(10)", 'qq'))}, {_cheapest('p', _edit('I', '3', "'user:' || chr(10)", 'qq'))}, qq, tt FROM (
    SELECT *, {_cheapest('q', _edit('I', '3', "'assistant:' || chr(10)", 't'))} AS qq, {_cheapest('t', _edit('I', '3', "'user:' || chr(10)", 'q'))} AS tt FROM (
      SELECT v.conv_id, r.back, {_scanned('v.s', {'s': 'v.p', 'u': 'v.q'}, 'user', 'v.q')} AS s, {_scanned('v.p', {'u': 'v.q'}, 'user', 'v.q')} AS p, {_scanned('v.q', {'a': 'v.t'}, 'assistant', 'v.t')} AS q, {_scanned('v.t', {'u': 'v.q'}, 'user', 'v.q')} AS t
      FROM v JOIN r ON r.conv_id IS NOT DISTINCT FROM v.conv_id AND r.back = v.back + 1))),
e AS (SELECT conv_id, arg_max(s, back) AS s FROM v GROUP BY conv_id),
u AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated,
  count(*) FILTER (pos > 1 AND before || init NOT IN ('su', 'ua', 'au')) AS illegal FROM h GROUP BY conv_id)
SELECT c.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate, coalesce(truncated, 0)::BIGINT AS truncated, coalesce(illegal, 0)::BIGINT AS illegal,
  coalesce(e.s.c, 0)::BIGINT AS cost, coalesce(e.s.a, '') AS audit, sha256(coalesce(left(e.s.x, greatest(length(e.s.x) - 1, 0)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN u ON u.conv_id IS NOT DISTINCT FROM c.conv_id LEFT JOIN e ON e.conv_id IS NOT DISTINCT FROM c.conv_id
"""

ORACLES = {"op6_line_dedup": OP6, "op9_warc_zip": OP9, "op1_ngram_jaccard": OP1, "op7_decontamination": OP7, "op8_quality_rules": OP8, "op13_conversation_repair": OP13}
