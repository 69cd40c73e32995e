"""DuckDB SQL for the queries that SQL can express, written from their definitions."""

from __future__ import annotations

LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
SPACE_WORD, LEAK_WORD = r"[^\x20\x09-\x0D]+", r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words(text: str, pattern: str) -> str:
    return f"regexp_extract_all(coalesce({text}, ''), '{pattern}')"


COPIES = r"""WITH n AS (SELECT doc_id, length(coalesce(text, '')) AS size, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', '', 'g')) AS h FROM documents)
SELECT doc_id, first(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY h) AS group_size, row_number() OVER w = 1 AS kept, h AS text_sha256
FROM n WINDOW w AS (PARTITION BY h ORDER BY size DESC, doc_id)"""

LEAKS = f"""WITH d AS (SELECT doc_id, {words(LOWER.format('text'), LEAK_WORD)} AS w FROM documents),
i AS (SELECT item_id, w, least(10, len(w)) AS k FROM (SELECT item_id, {words(LOWER.format('text'), LEAK_WORD)} AS w FROM benchmark) WHERE len(w) > 0),
win AS (SELECT DISTINCT item_id, k, array_to_string(w[p:p + k - 1], ' ') AS s FROM (SELECT *, unnest(range(1, CAST(len(w) - k + 2 AS BIGINT))) AS p FROM i)),
dw AS (SELECT doc_id, k, p, array_to_string(w[p:p + k - 1], ' ') AS s
  FROM (SELECT *, unnest(range(1, CAST(len(w) - k + 2 AS BIGINT))) AS p FROM d, (SELECT DISTINCT k FROM win))),
hits AS (SELECT doc_id, p, k, item_id FROM dw JOIN win USING (k, s)),
covered AS (SELECT doc_id, count(DISTINCT x) AS n_hit FROM (SELECT doc_id, unnest(range(p, p + k)) AS x FROM hits) GROUP BY 1),
names AS (SELECT doc_id, count(*) AS n_items, string_agg(name, ',' ORDER BY name) AS items FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS name FROM hits) GROUP BY 1)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN covered USING (doc_id) LEFT JOIN names USING (doc_id)"""

REPEATS = f"""WITH d AS (SELECT doc_id, {words('text', SPACE_WORD)} AS w FROM documents),
win AS (SELECT doc_id, p, sha256(array_to_string(w[p:p + 34], ' ')) AS s FROM (SELECT *, unnest(range(1, CAST(len(w) - 33 AS BIGINT))) AS p FROM d)),
twice AS (SELECT s FROM win GROUP BY 1 HAVING count(*) > 1),
gone AS (SELECT DISTINCT doc_id, unnest(range(p, p + 35)) AS p FROM win WHERE s IN (SELECT s FROM twice)),
each AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS p FROM d),
kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY p) AS text FROM each WHERE (doc_id, p) NOT IN (SELECT (doc_id, p) FROM gone) GROUP BY 1),
removed AS (SELECT doc_id, count(*) AS n FROM gone GROUP BY 1)
SELECT doc_id, len(w) AS n_words, coalesce(n, 0) AS n_removed, sha256(coalesce(text, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id) LEFT JOIN removed USING (doc_id)"""

NEAR = f"""WITH RECURSIVE d AS (SELECT doc_id, {words(LOWER.format('text'), SPACE_WORD)} AS w FROM documents),
sh AS (SELECT DISTINCT doc_id, array_to_string(w[p:p + 3], ' ') AS s FROM (SELECT *, unnest(range(1, CAST(greatest(len(w) - 3, 1) + 1 AS BIGINT))) AS p FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY 1),
links AS (SELECT x, y FROM (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM sh a JOIN sh b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY 1, 2)
  JOIN n m ON m.doc_id = x JOIN n o ON o.doc_id = y WHERE 100 * c >= 85 * (m.n + o.n - c)),
reach AS (SELECT doc_id AS x, doc_id AS y FROM d UNION SELECT r.x, l.y FROM reach r JOIN links l ON r.y = l.x)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, component_id FROM d LEFT JOIN n USING (doc_id) JOIN (SELECT x AS doc_id, min(y) AS component_id FROM reach GROUP BY 1) USING (doc_id)"""

LINES = f"""WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS w FROM documents),
l AS (SELECT doc_id, unnest(w) AS line, generate_subscripts(w, 1) AS p FROM d),
k AS (SELECT *, {LOWER.format("trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))")} AS key FROM l),
shared AS (SELECT key, max(doc_id) AS keeper FROM k WHERE length(key) >= 20 GROUP BY 1 HAVING count(DISTINCT doc_id) >= 3),
kept AS (SELECT doc_id, p, line, keeper IS NULL OR keeper = doc_id AS stays FROM k LEFT JOIN shared USING (key))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (NOT stays) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY p) FILTER (stays), '')) AS kept_sha256 FROM kept GROUP BY 1"""

#: crc32 of ASCII text k, bit by bit.
CRC = """xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(k, ''), lambda c: ord(c)::BIGINT)),
  lambda a, b: list_reduce(list_prepend(xor(a, b), range(8)), lambda x, j: xor(x >> 1, (x & 1) * 3988292384))), 4294967295::BIGINT)"""

REPAIRS = rf"""WITH RECURSIVE keyed AS (SELECT *, coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS k FROM conversations),
raw AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, {CRC} % 20 AS r FROM keyed),
harmed AS (SELECT conv_id, turn, CASE r WHEN 4 THEN 'user' ELSE role END AS role,
  CASE r WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, CASE r WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END AS copies FROM raw),
m AS (SELECT conv_id, turn, role, text, unnest(range(copies)) AS c FROM harmed),
placed AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(text), c) AS i,
  row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, c) AS seen FROM m),
coded AS (SELECT *, left(role, 1) AS initial, CASE WHEN NOT regexp_matches(text, '[^ 	-
]') THEN 'blank' WHEN seen > 1 THEN 'duplicate'
  WHEN NOT regexp_matches(text, '[.!?][ 	-
]*$') THEN 'truncated' ELSE '' END AS fault FROM placed),
near AS (SELECT *, lag(initial) OVER (PARTITION BY conv_id ORDER BY i) || initial AS pair FROM coded),
faults AS (SELECT conv_id, count(*) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank,
  count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated, count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal FROM near GROUP BY 1),
ins(q, q2, spent, marks, said) AS (VALUES ('-', '-', 0, '', ''), ('s', 's', 0, '', ''), ('u', 'u', 0, '', ''), ('a', 'a', 0, '', ''),
  ('-', 'u', 3, 'I', chr(10) || 'user:'), ('s', 'u', 3, 'I', chr(10) || 'user:'), ('a', 'u', 3, 'I', chr(10) || 'user:'), ('u', 'a', 3, 'I', chr(10) || 'assistant:'),
  ('-', 'a', 6, 'II', chr(10) || 'user:' || chr(10) || 'assistant:'), ('s', 'a', 6, 'II', chr(10) || 'user:' || chr(10) || 'assistant:'),
  ('a', 'a', 6, 'II', chr(10) || 'user:' || chr(10) || 'assistant:'), ('u', 'u', 6, 'II', chr(10) || 'assistant:' || chr(10) || 'user:')),
follows(q2, role_next, name) AS (VALUES ('-', 'u', 'user'), ('s', 'u', 'user'), ('a', 'u', 'user'), ('u', 'a', 'assistant')),
edits(e) AS (VALUES ('D'), ('K'), ('R')),
best(conv_id, i, q, cost, audit, said) AS (
  SELECT DISTINCT conv_id, 0::BIGINT, '-', 0, '', '' FROM conversations
  UNION ALL
  SELECT conv_id, i, q, cost, audit, said FROM (
    SELECT *, row_number() OVER (PARTITION BY conv_id, q ORDER BY cost, audit) AS place FROM (
      SELECT c.conv_id, c.i, CASE e WHEN 'D' THEN ins.q2 WHEN 'R' THEN role_next ELSE initial END AS q,
        b.cost + spent + CASE e WHEN 'D' THEN 4 WHEN 'R' THEN 3 ELSE 0 END + CASE WHEN e <> 'D' AND fault = 'truncated' THEN 3 ELSE 0 END AS cost,
        b.audit || marks || e AS audit,
        b.said || ins.said || CASE e WHEN 'D' THEN '' ELSE chr(10) || CASE e WHEN 'R' THEN name ELSE role END || ':' || text END AS said
      FROM best b JOIN coded c ON c.conv_id IS NOT DISTINCT FROM b.conv_id AND c.i = b.i + 1 JOIN ins ON ins.q = b.q JOIN follows ON follows.q2 = ins.q2, edits
      WHERE e = 'D' OR (fault NOT IN ('blank', 'duplicate') AND (e = 'R' OR initial = role_next OR (initial = 's' AND ins.q2 = '-'))))) WHERE place = 1),
whole AS (SELECT b.conv_id, n, gaps, blank, duplicate, truncated, illegal, b.cost + spent AS cost, b.audit || marks AS audit, b.said || ins.said AS said,
  row_number() OVER (PARTITION BY b.conv_id ORDER BY b.cost + spent, b.audit || marks) AS place
  FROM best b JOIN ins ON ins.q = b.q LEFT JOIN faults f ON f.conv_id IS NOT DISTINCT FROM b.conv_id WHERE b.i = coalesce(n, 0) AND ins.q2 IN ('-', 'a'))
SELECT conv_id, CAST(coalesce(gaps, 0) AS BIGINT) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated,
  coalesce(illegal, 0) AS illegal, CAST(cost AS BIGINT) AS cost, audit, sha256(substr(said, 2)) AS repaired_sha256 FROM whole WHERE place = 1"""

ORACLE = {"op13_conversation_repair": REPAIRS, "op12_line_bitmaps": LINES, "op2_substring_dedup": REPEATS, "op5_decontamination": LEAKS, "op9_jaccard_join": NEAR, "op10_content_sort": COPIES}
