"""What DuckDB says to the queries that SQL can express."""

WORD = r"[^\x20\x09-\x0D]+"

OP2 = """WITH p AS (SELECT page_id, coalesce(html, '') AS data FROM pages),
h AS (SELECT *, sha1(data) AS hex FROM p),
f AS (SELECT hex, min(page_id) AS first_id FROM h GROUP BY 1)
SELECT page_id, strlen(data)::BIGINT AS payload_bytes,
  array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((('0x' || substr(hex, (1 + 5 * (i // 4))::BIGINT, 5))::BIGINT >> (15 - 5 * (i % 4))::BIGINT) & 31) + 1, 1)), '') AS payload_digest,
  CASE WHEN first_id IS NULL OR first_id IS NOT DISTINCT FROM page_id THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN first_id IS DISTINCT FROM page_id THEN first_id END AS refers_to
FROM h JOIN f USING (hex)"""

_FOLD = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = rf"regexp_extract_all({_FOLD}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

OP6 = f"""WITH dw AS MATERIALIZED (SELECT row_number() OVER () AS rid, doc_id, {_WORDS} AS ws FROM documents),
iw AS (SELECT item_id, ws, least(13, len(ws)) AS k FROM (SELECT item_id, {_WORDS} AS ws FROM benchmark) WHERE len(ws) > 0),
ig AS MATERIALIZED (SELECT DISTINCT item_id, k, array_to_string(ws[i:i + k - 1], ' ') AS g FROM (SELECT *, unnest(range(1, len(ws) - k + 2)) AS i FROM iw)),
dg AS (SELECT rid, k, i, array_to_string(ws[i:i + k - 1], ' ') AS g FROM (SELECT rid, ws, k, unnest(range(1, len(ws) - k + 2)) AS i FROM dw, (SELECT DISTINCT k FROM ig) WHERE len(ws) >= k)),
h AS MATERIALIZED (SELECT rid, i, k, item_id FROM dg JOIN ig USING (k, g)),
n AS (SELECT rid, count(DISTINCT p) AS n_hit FROM (SELECT rid, unnest(range(i, i + k)) AS p FROM h) GROUP BY 1),
w AS (SELECT rid, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS items FROM h GROUP BY 1)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(ws) AS contaminated
FROM dw LEFT JOIN n USING (rid) LEFT JOIN w USING (rid)"""

OP8 = rf"""WITH d AS MATERIALIZED (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text FROM documents),
m AS MATERIALIZED (SELECT rid, doc_id, text, regexp_extract_all(text, '{WORD}') AS ws,
  list_filter(string_split(text, chr(10)), lambda l: regexp_matches(l, '{WORD}')) AS ls FROM d),
e AS MATERIALIZED (SELECT rid, unnest(ws) AS w, generate_subscripts(ws, 1) AS i FROM m),
t AS (SELECT rid, i, w, lead(w) OVER o AS w2, lead(w, 2) OVER o AS w3 FROM e WINDOW o AS (PARTITION BY rid ORDER BY i)),
r AS (SELECT rid, i, count(*) OVER (PARTITION BY rid, w, w2, w3) AS n FROM t WHERE w3 IS NOT NULL),
rep AS (SELECT rid, count(DISTINCT p) AS n_repeat_words FROM (SELECT rid, unnest([i, i + 1, i + 2]) AS p FROM r WHERE n > 1) GROUP BY 1),
top AS (SELECT rid, max(n) AS top FROM (SELECT rid, w, count(*) AS n FROM e WHERE strlen(w) > 4 GROUP BY 1, 2) GROUP BY 1),
k AS (SELECT rid, count(*) FILTER (strlen(w) > 1 AND regexp_matches(w, '[A-Z]') AND NOT regexp_matches(w, '[a-z]')) AS n_upper,
  count(*) FILTER (regexp_matches(w, '(!!|\?\?|##|\*\*|\$\$|%%|&&|~~)$')) AS n_marked, sum(length(w)) AS word_chars FROM e GROUP BY 1),
a AS (SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(word_chars, 0)::BIGINT AS word_chars,
  length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols, (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines,
  coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words, len(ls) AS n_lines, coalesce(n_upper, 0) AS n_upper, coalesce(n_marked, 0) AS n_marked, coalesce(top, 0) AS top
  FROM m LEFT JOIN rep USING (rid) LEFT JOIN top USING (rid) LEFT JOIN k USING (rid)),
b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM a)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT (base_failed OR 10 * n_symbols > 3 * n_words OR n_lines >= 4 AND 10 * n_dup_lines > 4 * n_lines OR n_words >= 20 AND 2 * n_upper > n_words
    OR 4 * n_marked > n_words OR n_words > 0 AND NOT (2 * n_words <= word_chars AND word_chars <= 20 * n_words)
    OR n_words >= 50 AND top::DOUBLE / n_words > 0.25) AS kept FROM b"""

_HIDDEN = r"""length(replace({0}, '\', '\\')) + len(regexp_extract_all(replace({0}, '\', '\\'), '\[/?SYS\]|\[/?INST\]|</?s>|\[/?ROLE\]|\[/TURN\]'))"""

OP9 = f"""WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-1, 0, 'user', '</s>[INST] ok [/INST]'), (-1, 1, 'assistant', '</s>[INST] ok [/INST]')),
f AS (SELECT *, {_HIDDEN.format("text")} + CASE role WHEN 'system' THEN 11 WHEN 'user' THEN 13 WHEN 'assistant' THEN 7 ELSE 20 + {_HIDDEN.format("role")} END AS n FROM c)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(n)::BIGINT AS formatted_chars FROM f GROUP BY 1"""


def _crc32(text: str) -> str:
    """The checksum of a string's bytes, bit by bit."""
    bits = f"list_transform(range(8 * strlen({text})), lambda i: (('0x' || substr(hex({text}), (2 * (i // 8) + 1)::BIGINT, 2))::BIGINT >> (i % 8)::BIGINT) & 1)"
    return f"xor(list_reduce(list_prepend(4294967295::BIGINT, {bits}), lambda c, b: xor(xor(c, b) >> 1, 3988292384 * (xor(c, b) & 1))), 4294967295)"


OP11 = f"""WITH RECURSIVE r AS MATERIALIZED (SELECT coalesce(doc_id::VARCHAR, '') AS d, unnest(regexp_extract_all({_FOLD}, '[a-zÀ-ÿ]{{7,}}')) AS w FROM documents),
k AS MATERIALIZED (SELECT d, w, d || ':' || w AS t, count(*) AS n FROM r GROUP BY 1, 2),
h AS MATERIALIZED (SELECT w, n, {_crc32("t")} AS h FROM k),
c AS MATERIALIZED (SELECT w, sum(n)::BIGINT AS n FROM (SELECT n, CASE WHEN h % 31 = 0 THEN substr(w, 1, (h % length(w))::BIGINT) || substr(w, (h % length(w) + 2)::BIGINT) ELSE w END AS w FROM h)
  WHERE length(w) >= 7 GROUP BY 1 HAVING sum(n) >= 2),
g AS MATERIALIZED (SELECT w, n, i, substr(w, 1, i - 1) || substr(w, i + 1) AS cut FROM (SELECT w, n, unnest(range(1, length(w) + 1)) AS i FROM c)),
p AS (SELECT a.w AS a, b.w AS b FROM g a JOIN g b ON a.i = b.i AND a.cut = b.cut AND a.w <> b.w
  UNION SELECT g.w, c.w FROM g JOIN c ON g.cut = c.w UNION SELECT c.w, g.w FROM g JOIN c ON g.cut = c.w),
m AS (SELECT p.a AS w, count(*) AS n_near, arg_min(p.b, (-c.n, p.b)) AS best, max(c.n) AS most FROM p JOIN c ON c.w = p.b GROUP BY 1),
f AS MATERIALIZED (SELECT c.w, c.n, coalesce(n_near, 0) AS n_near, CASE WHEN most >= 10 * c.n THEN best END AS form, CASE WHEN most >= 10 * c.n THEN most END AS form_n FROM c LEFT JOIN m USING (w)),
s AS (SELECT w, w AS reached, form AS onward FROM f UNION ALL SELECT s.w, s.onward, f.form FROM s JOIN f ON f.w = s.onward),
x AS (SELECT w, reached FROM s WHERE onward IS NULL)
SELECT f.w AS word, form, reached AS root, n, n_near::BIGINT AS n_near, form_n::BIGINT AS form_n FROM f JOIN x ON f.w = x.w"""

_RUNS = f"(SELECT rid, unnest(list_concat(ws, list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1]))) AS g FROM {{}})"

OP12 = f"""WITH d AS MATERIALIZED (SELECT row_number() OVER () AS rid, doc_id, {_WORDS} AS ws FROM documents),
b AS MATERIALIZED (SELECT 0 AS rid, {_WORDS} AS ws FROM benchmark),
dg AS MATERIALIZED (SELECT rid, g, count(*) AS n FROM {_RUNS.format("d")} GROUP BY 1, 2),
bg AS MATERIALIZED (SELECT g, count(*) AS n FROM {_RUNS.format("b")} GROUP BY 1),
k AS MATERIALIZED (SELECT g, {_crc32("g")} % 10000 AS bucket FROM (SELECT g FROM dg UNION SELECT g FROM bg)),
s AS (SELECT bucket, sum(n) AS s FROM dg JOIN k USING (g) GROUP BY 1), t AS (SELECT bucket, sum(n) AS t FROM bg JOIN k USING (g) GROUP BY 1),
gain AS MATERIALIZED (SELECT bucket, floor(1000 * ln(((coalesce(t, 0) + 1) * ((SELECT coalesce(sum(n), 0) FROM dg) + 10000))::DOUBLE
  / ((s + 1) * ((SELECT coalesce(sum(n), 0) FROM bg) + 10000))::DOUBLE))::BIGINT AS gain FROM s LEFT JOIN t USING (bucket)),
w AS (SELECT rid, sum(n)::BIGINT AS n_features, floor(sum(n * gain)::DOUBLE / sum(n))::BIGINT AS weight FROM dg JOIN k USING (g) JOIN gain USING (bucket) GROUP BY 1),
e AS MATERIALIZED (SELECT rid, doc_id, len(ws) AS n_words, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight,
  ('0x' || substr(sha256('7:' || coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT AS h FROM d LEFT JOIN w USING (rid)),
f AS MATERIALIZED (SELECT *, weight + floor(-1000 * ln(-ln((h + 0.5) / 4294967296)))::BIGINT AS score FROM e),
o AS (SELECT rid, row_number() OVER (ORDER BY score DESC, doc_id NULLS LAST, n_features DESC, weight DESC) AS rank FROM f WHERE n_words >= 20)
SELECT doc_id, n_features::BIGINT AS n_features, weight, score,
  CASE WHEN rank <= (SELECT 25 * count(*) // 100 FROM f WHERE n_words >= 20) THEN rank END::BIGINT AS rank FROM f LEFT JOIN o USING (rid)"""
