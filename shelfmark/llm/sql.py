"""DuckDB SQL with the results of those queries of this package that SQL can express."""

QUALITY = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS text FROM documents),
w AS (SELECT r, unnest(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) AS w, generate_subscripts(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), 1) AS i FROM d),
g AS (SELECT *, lead(w, 1) OVER o AS w2, lead(w, 2) OVER o AS w3 FROM w WINDOW o AS (PARTITION BY r ORDER BY i)),
t AS (SELECT *, w3 IS NOT NULL AND count(*) OVER (PARTITION BY r, w, w2, w3) > 1 AS twice FROM g),
c AS (SELECT r, w, max(CASE WHEN twice THEN 1 ELSE 0 END) OVER (PARTITION BY r ORDER BY i ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS hit FROM t),
n AS (SELECT r, count(*) AS n_words, sum(length(w)) AS word_chars, sum(hit) AS n_repeat_words FROM c GROUP BY r),
l AS (SELECT r, unnest(string_split(text, chr(10))) AS line FROM d),
j AS (SELECT r, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n_dup_lines FROM l WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY r),
m AS (
  SELECT doc_id, lang, source, coalesce(n_words, 0)::BIGINT AS n_words, coalesce(word_chars, 0)::BIGINT AS word_chars,
    length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols, coalesce(n_dup_lines, 0)::BIGINT AS n_dup_lines,
    coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words, greatest(coalesce(n_lines, 0), 1) AS n_lines
  FROM d LEFT JOIN n USING (r) LEFT JOIN j USING (r)),
v AS (
  SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed, n_symbols / greatest(n_words, 1) AS symbols,
    n_repeat_words / greatest(n_words, 1) AS repeats, n_dup_lines / n_lines AS dup_lines, word_chars / greatest(n_words, 1) AS mean_word FROM m),
k AS (SELECT *, CASE WHEN symbols > 0 THEN ceil(ln(symbols) / ln(1.02)) ELSE -1e12 END AS bs, CASE WHEN repeats > 0 THEN ceil(ln(repeats) / ln(1.02)) ELSE -1e12 END AS br,
  CASE WHEN dup_lines > 0 THEN ceil(ln(dup_lines) / ln(1.02)) ELSE -1e12 END AS bd, CASE WHEN mean_word > 0 THEN ceil(ln(mean_word) / ln(1.02)) ELSE -1e12 END AS bm FROM v),
s AS (SELECT lang, source, ratio, bucket, upper, count(*) AS n FROM (
  SELECT lang, source, unnest(['symbols', 'repeats', 'dup_lines', 'mean_word']) AS ratio, unnest([950, 990, 990, 1000]) AS upper, unnest([bs, br, bd, bm]) AS bucket FROM k WHERE NOT base_failed) GROUP BY ALL),
p AS (
  SELECT lang, source, ratio, bucket, upper, n, 1 AS level FROM s
  UNION ALL SELECT lang, NULL, ratio, bucket, upper, sum(n), 2 FROM s GROUP BY lang, ratio, bucket, upper
  UNION ALL SELECT NULL, NULL, ratio, bucket, upper, sum(n), 3 FROM s GROUP BY ratio, bucket, upper),
q AS (SELECT *, sum(n) OVER (PARTITION BY level, lang, source, ratio ORDER BY bucket) AS upto, sum(n) OVER (PARTITION BY level, lang, source, ratio) AS total FROM p),
e AS (
  SELECT level, lang, source, ratio, max(total) AS total, min(bucket) FILTER (WHERE 1000 * upto >= 250 * total) AS b1,
    min(bucket) FILTER (WHERE 1000 * upto >= 750 * total) AS b3, min(bucket) FILTER (WHERE 1000 * upto >= upper * total) AS bu
  FROM q GROUP BY ALL),
h AS (
  SELECT a.lang, a.source, a.ratio, CASE WHEN a.total >= 50 THEN a.bu WHEN b.total >= 50 THEN b.bu ELSE c.bu END AS bu,
    pow(1.02, CASE WHEN a.total >= 50 THEN a.b1 WHEN b.total >= 50 THEN b.b1 ELSE c.b1 END - 1) AS q1,
    pow(1.02, CASE WHEN a.total >= 50 THEN a.b3 WHEN b.total >= 50 THEN b.b3 ELSE c.b3 END) AS q3
  FROM e a JOIN e b ON b.level = 2 AND a.lang = b.lang AND a.ratio = b.ratio JOIN e c ON c.level = 3 AND a.ratio = c.ratio WHERE a.level = 1),
z AS (
  SELECT lang, source, max(bu) FILTER (WHERE ratio = 'symbols') AS us, max(bu) FILTER (WHERE ratio = 'repeats') AS ur, max(bu) FILTER (WHERE ratio = 'dup_lines') AS ud,
    max(q1 - 5 * (q3 - q1)) FILTER (WHERE ratio = 'mean_word') AS lm, max(q3 + 5 * (q3 - q1)) FILTER (WHERE ratio = 'mean_word') AS hm
  FROM h GROUP BY lang, source)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND coalesce(bs <= us AND br <= ur AND bd <= ud AND mean_word BETWEEN lm AND hm, false) AS kept
FROM k LEFT JOIN z USING (lang, source)
"""

CONTAMINATION = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
x AS (SELECT *, regexp_extract_all(text, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM d),
b AS (SELECT item_id::VARCHAR AS item, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark),
iw AS (
  SELECT item, n, array_to_string(ws[i:i + n - 1], ' ') AS win FROM (
    SELECT item, ws, least(len(ws), 10) AS n, unnest(range(1, greatest(len(ws) - 9, 1) + 1)) AS i FROM b WHERE len(ws) > 0)),
sizes AS (SELECT DISTINCT n FROM iw),
dw AS (
  SELECT r, i, n, array_to_string(ws[i:i + n - 1], ' ') AS win FROM (
    SELECT r, ws, n, unnest(range(1, len(ws) - n + 2)) AS i FROM x, sizes WHERE len(ws) >= n)),
h AS (SELECT r, i, n, item FROM dw JOIN iw USING (n, win)),
p AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(i, i + n)) AS p FROM h) GROUP BY r),
t AS (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS ids FROM (SELECT DISTINCT r, item FROM h) GROUP BY r)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM x LEFT JOIN p USING (r) LEFT JOIN t USING (r)
"""

CHAT = r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
g AS (
  SELECT conv_id, count(*) AS n_turns, string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text) AS whole,
    coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '') AS loss,
    sum(16 + length(role) + length(text) + length(regexp_replace(role || text, '[^<\[\\]', '', 'g'))) AS formatted_chars
  FROM c GROUP BY conv_id)
SELECT conv_id, n_turns::BIGINT AS n_turns, sha256(whole) AS turns_sha256, length(loss)::BIGINT AS loss_chars, sha256(loss) AS loss_sha256, formatted_chars::BIGINT AS formatted_chars
FROM g
"""


def licenses(templates: dict[str, str]) -> str:
    """(doc_id, license, containment) for these templates, by all five-word shingles."""
    quoted = lambda t: "'" + t.replace("'", "''") + "'"
    values = ", ".join(f"({quoted(n)}, {quoted(t)})" for n, t in templates.items())
    words = lambda c: f"regexp_extract_all(translate({c}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
    return f"""
WITH t AS (SELECT name, {words('body')} AS ws FROM (VALUES {values}) AS v(name, body)),
ts AS (SELECT DISTINCT name, len(ws) AS m, array_to_string(ws[i:i + 4], ' ') AS g FROM (SELECT name, ws, unnest(range(1, len(ws) - 3)) AS i FROM t WHERE len(ws) >= 5)),
size AS (SELECT name, count(*) AS n FROM ts GROUP BY name),
d AS (SELECT row_number() OVER () AS r, doc_id, {words("coalesce(text, '')")} AS ws FROM documents),
ds AS (SELECT r, doc_id, i, array_to_string(ws[i:i + 4], ' ') AS g FROM (SELECT r, doc_id, ws, unnest(range(1, len(ws) - 3)) AS i FROM d WHERE len(ws) >= 5)),
h AS (SELECT r, doc_id, name, m, i, g FROM ds JOIN ts USING (g)),
b AS (SELECT a.doc_id, a.name, a.r, a.i, count(DISTINCT b.g) AS got FROM h a JOIN h b ON a.r = b.r AND a.name = b.name AND b.i BETWEEN a.i AND a.i + a.m + a.m // 4 - 5 GROUP BY ALL)
SELECT doc_id, name AS license, max(got / n) AS containment FROM b JOIN size USING (name) GROUP BY doc_id, name HAVING max(got / n) >= 0.8
"""
