"""DuckDB twins of the queries that SQL can express."""

from __future__ import annotations

import string

from panelkit.llm import line_rules

_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"
_LOWER = f"translate(coalesce(text, ''), '{string.ascii_uppercase}', '{string.ascii_lowercase}')"

OP1 = rf"""
WITH RECURSIVE d AS (
  SELECT row_number() OVER () AS r, doc_id,
         regexp_extract_all({_LOWER}, '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT r, array_to_string(w[p:p + least(len(w), 5) - 1], ' ') AS g
      FROM (SELECT r, w, unnest(range(1, greatest(len(w) - 4, least(len(w), 1)) + 1)) AS p FROM d)),
n AS (SELECT r, count(*) AS n FROM s GROUP BY r),
i AS (SELECT a.r AS a, b.r AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.r <> b.r GROUP BY ALL),
l AS (SELECT a, b FROM i JOIN n x ON x.r = a JOIN n y ON y.r = b WHERE 100 * c >= 75 * (x.n + y.n - c)),
t AS (SELECT a, b FROM l UNION SELECT t.a, l.b FROM t JOIN l ON t.b = l.a)
SELECT d.doc_id, coalesce(any_value(n.n), 0)::BIGINT AS n_shingles,
       least(d.doc_id, min(o.doc_id)) AS component_id
FROM d LEFT JOIN n USING (r) LEFT JOIN t ON t.a = d.r LEFT JOIN d o ON o.r = t.b
GROUP BY d.r, d.doc_id
"""

OP2 = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_WORDS} AS w FROM documents),
s AS (SELECT r, p, md5(array_to_string(w[p:p + 34], ' ')) AS h
      FROM (SELECT r, w, unnest(range(1, len(w) - 33)) AS p FROM d)),
m AS (SELECT r, p FROM s QUALIFY count(*) OVER (PARTITION BY h) > 1),
c AS (SELECT DISTINCT r, unnest(range(p, p + 35)) AS q FROM m),
x AS (SELECT r, unnest(w) AS word, generate_subscripts(w, 1) AS q FROM d),
k AS (SELECT x.r, count(c.q) AS gone, string_agg(word, ' ' ORDER BY x.q) FILTER (WHERE c.q IS NULL) AS t
      FROM x LEFT JOIN c ON c.r = x.r AND c.q = x.q GROUP BY x.r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(gone, 0)::BIGINT AS n_removed,
       sha256(coalesce(t, '')) AS kept_sha256
FROM d LEFT JOIN k USING (r)
"""

_LETTERS = rf"regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
OP4 = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_LETTERS} AS w FROM documents),
b AS (SELECT item_id, w, least(len(w), 10) AS m FROM (SELECT item_id, {_LETTERS} AS w FROM benchmark) WHERE len(w) > 0),
v AS (SELECT DISTINCT item_id, m, array_to_string(w[p:p + m - 1], ' ') AS g
      FROM (SELECT *, unnest(range(1, len(w) - m + 2)) AS p FROM b)),
s AS (SELECT r, m, p, array_to_string(w[p:p + m - 1], ' ') AS g
      FROM (SELECT r, w, m, unnest(range(1, len(w) - m + 2)) AS p
            FROM d, (SELECT DISTINCT m FROM b) WHERE len(w) >= m)),
h AS (SELECT r, s.m, p, item_id FROM s JOIN v ON v.m = s.m AND v.g = s.g),
c AS (SELECT r, count(DISTINCT q) AS n_hit FROM (SELECT r, unnest(range(p, p + m)) AS q FROM h) GROUP BY r),
t AS (SELECT r, count(*) AS n_items, string_agg(i, ',' ORDER BY i) AS items
      FROM (SELECT DISTINCT r, item_id::VARCHAR AS i FROM h WHERE item_id IS NOT NULL) GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN c USING (r) LEFT JOIN t USING (r)
"""

OP6 = r"""
WITH RECURSIVE u AS (
  SELECT conv_id, turn, text, conv_id || '-' || turn AS call_id, conv_id || '-' || (turn - 2) AS dep,
         len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) AS n
  FROM conversations WHERE role = 'user'),
a AS (SELECT conv_id, conv_id || '-' || (turn - 1) AS call_id, turn, text AS content
      FROM conversations WHERE role = 'assistant'),
f AS (SELECT conv_id, call_id, count(*) AS answers, min({'turn': turn, 'content': content}) AS one FROM a GROUP BY ALL),
k AS (SELECT conv_id, call_id, count(*) AS times FROM u GROUP BY ALL),
v AS (SELECT DISTINCT u.conv_id, u.call_id, u.dep, k.call_id IS NOT NULL AS known, u.turn >= 2 AS wants
      FROM u LEFT JOIN k ON k.conv_id = u.conv_id AND k.call_id = u.dep),
l AS (SELECT conv_id, call_id, 0 AS level FROM v WHERE NOT (wants AND known)
      UNION ALL SELECT v.conv_id, v.call_id, l.level + 1 FROM l JOIN v ON v.conv_id = l.conv_id AND v.dep = l.call_id
      WHERE v.wants),
x AS (SELECT u.*, l.level, f.one.content AS content,
        CASE WHEN k.times > 1 OR f.answers > 1 THEN 'repeated' WHEN f.answers IS NULL THEN 'unanswered'
             WHEN f.one.turn < u.turn THEN 'early' ELSE 'linked' END AS status,
        CASE WHEN n < 10 THEN 'ask' ELSE 'answer' END AS name,
        v.wants AND NOT v.known AS lost
      FROM u JOIN k USING (conv_id, call_id) JOIN l USING (conv_id, call_id) JOIN v USING (conv_id, call_id)
      LEFT JOIN f USING (conv_id, call_id))
SELECT conv_id, call_id, turn, level, status,
  array_to_string(list_sort(list_filter([
    CASE WHEN lost THEN 'dependency' END, CASE WHEN text IS NULL THEN 'missing:text' END,
    CASE WHEN name = 'answer' AND n IS NULL THEN 'missing:n_words' END,
    CASE WHEN name = 'ask' AND n IS NOT NULL THEN 'unknown:n_words' END], lambda e: e IS NOT NULL)), ',') AS errors,
  '{"arguments":{' || coalesce('"n_words":' || n || ',', '') || coalesce('"text":' || to_json(text)::VARCHAR || ',', '')
    || '"turn":' || turn || '},"call_id":' || to_json(call_id)::VARCHAR || ',"level":' || level || ',"name":"' || name
    || '","result":' || coalesce(to_json(content)::VARCHAR, 'null') || ',"status":"' || status || '"}' AS record
FROM x
UNION ALL
SELECT conv_id, call_id, turn, NULL, 'orphan', '', '{"arguments":null,"call_id":' || to_json(call_id)::VARCHAR
    || ',"level":null,"name":null,"result":' || coalesce(to_json(content)::VARCHAR, 'null') || ',"status":"orphan"}'
FROM a ANTI JOIN k USING (conv_id, call_id)
"""

#: the rules' fixed lists as SQL lists
END_MARKS, SEPARATORS, NOTICES = ("[" + ", ".join("'" + x.replace("'", "''") + "'" for x in xs) + "]"
                                  for xs in (line_rules.END_MARKS, line_rules.SEPARATORS, line_rules.NOTICES))
OP10 = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t, {_WORDS} AS w FROM documents),
g AS (SELECT r, p, count(*) OVER (PARTITION BY r, h) AS n
      FROM (SELECT r, p, md5(array_to_string(w[p:p + 4], ' ')) AS h
            FROM (SELECT r, w, unnest(range(1, len(w) - 3)) AS p FROM d))),
e AS (SELECT r, count(DISTINCT q) AS repeats FROM (SELECT r, unnest(range(p, p + 5)) AS q FROM g WHERE n > 1) GROUP BY r),
l AS (SELECT r, unnest(string_split(t, chr(10))) AS line, generate_subscripts(string_split(t, chr(10)), 1) AS i FROM d),
m AS (SELECT r, i, line, regexp_extract_all(line, '[^\x20\x09-\x0D]+') AS lw FROM l),
o AS (SELECT r, i, line, len(lw) AS words, row_number() OVER (PARTITION BY r, line ORDER BY i) > 1 AS again,
        row_number() OVER (PARTITION BY r ORDER BY i) AS k,
        md5(coalesce(lag(line) OVER (PARTITION BY r ORDER BY i), '') || chr(10)
            || coalesce(lead(line) OVER (PARTITION BY r ORDER BY i), '')) AS around,
        length(array_to_string(lw, '')) AS chars, len(regexp_extract_all(line, '[#*$%&|<>]')) AS signs,
        len(list_filter(lw, lambda x: x = '|')) AS bars, len(list_filter(lw, lambda x: contains(x, '!!'))) AS shout,
        len(list_filter(lw, lambda x: list_contains({SEPARATORS}, x))) AS seps,
        NOT list_contains({END_MARKS}, right(lw[len(lw)], 1)) AS unclosed,
        len(list_filter({NOTICES}, lambda x: contains(translate(line, '{string.ascii_uppercase}', '{string.ascii_lowercase}'),
                                                      x))) > 0 AS notice
      FROM m WHERE len(lw) > 0),
y AS (SELECT *, count(*) OVER (PARTITION BY r, menu, k - j) AS run
      FROM (SELECT *, row_number() OVER (PARTITION BY r, menu ORDER BY k) AS j
            FROM (SELECT *, unclosed AND words <= 6 AS menu FROM o))),
u AS (SELECT *, again OR signs > 0.1::DOUBLE * greatest(chars, 1) OR bars >= 3
          OR (words >= 3 AND shout > 0.5::DOUBLE * words) OR (unclosed AND words <= 3)
          OR (seps >= 3 AND 4 * seps >= words) OR (menu AND run >= 4) OR (notice AND words <= 24) AS bad FROM y),
c AS (SELECT line FROM u WHERE NOT bad AND words <= 24 GROUP BY line
      HAVING count(DISTINCT around) >= greatest(10, (SELECT (count(*) + 999) // 1000 FROM d WHERE len(w) > 0))),
s AS (SELECT r, count(*) FILTER (WHERE again) AS dups, count(*) FILTER (WHERE bad) AS n_bad,
        sum(chars) FILTER (WHERE bad) AS lost, count(c.line) AS n_common,
        sum(chars) FILTER (WHERE c.line IS NOT NULL) AS common
      FROM u LEFT JOIN c ON c.line = u.line AND NOT bad AND words <= 24 GROUP BY r),
z AS (SELECT d.r, doc_id, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars,
        len(regexp_extract_all(t, '[#*$%&|<>]')) AS n_symbols, coalesce(dups, 0) AS n_dup_lines,
        coalesce(repeats, 0) AS n_repeat_words, coalesce(n_bad, 0) AS n_bad, coalesce(lost, 0) AS lost,
        coalesce(n_common, 0) AS n_common, coalesce(common, 0) AS common
      FROM d LEFT JOIN e USING (r) LEFT JOIN s USING (r))
SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols,
  n_dup_lines::BIGINT AS n_dup_lines, n_repeat_words::BIGINT AS n_repeat_words, n_bad::BIGINT AS n_bad_lines,
  lost::BIGINT AS lost_chars, n_common::BIGINT AS n_common_lines, common::BIGINT AS common_chars, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
  NOT (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AND lost <= 0.5::DOUBLE * word_chars
    AND lost + common <= 0.9::DOUBLE * word_chars AS kept
FROM z
"""

_TERMS = rf"regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
OP11 = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_TERMS} AS w FROM documents),
s AS (SELECT count(*)::BIGINT AS nd, sum(len(w))::BIGINT AS l FROM d WHERE len(w) > 0),
q AS (SELECT DISTINCT item_id, unnest({_TERMS}) AS t FROM benchmark),
f AS (SELECT r, doc_id, n, t, count(*)::BIGINT AS tf FROM (SELECT r, doc_id, len(w)::BIGINT AS n, unnest(w) AS t FROM d)
      WHERE t IN (SELECT t FROM q) GROUP BY ALL),
k AS (SELECT t, floor(1000 * ln((2 * nd + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS k FROM f, s GROUP BY t, nd),
c AS (SELECT item_id, r, any_value(doc_id) AS doc_id,
             sum(k * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 90 + (90 * n * nd) // l))))::BIGINT AS score
      FROM q JOIN f USING (t) JOIN k USING (t), s GROUP BY item_id, r HAVING score > 0)
SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS LAST)::INTEGER AS rank, doc_id, score
FROM c QUALIFY rank <= 10
"""
