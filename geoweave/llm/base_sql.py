"""SQL for what it can express of the operators: the base columns of quality rules, secrets and personal data.

Words are runs of anything but space and \\x09 to \\x0D; all patterns find leftmost matches that don't overlap."""

from __future__ import annotations

_TEXT = "(SELECT doc_id, coalesce(text, '') AS t FROM documents)"
_SPACE = r"[\x20\x09-\x0D]"
_WORD = r"[^\x20\x09-\x0D]+"

QUALITY = f"""WITH d AS (SELECT row_number() OVER () AS k, doc_id, t FROM {_TEXT}),
w AS (SELECT k, unnest(regexp_extract_all(t, '{_WORD}')) AS word, generate_subscripts(regexp_extract_all(t, '{_WORD}'), 1) AS i FROM d),
win AS (SELECT k, i, word || ' ' || lead(word) OVER p || ' ' || lead(word, 2) OVER p AS s FROM w WINDOW p AS (PARTITION BY k ORDER BY i)),
rep AS (SELECT k, i FROM (SELECT k, i, count(*) OVER (PARTITION BY k, s) AS n FROM win WHERE s IS NOT NULL) WHERE n > 1),
cov AS (SELECT k, count(DISTINCT i + o) AS n FROM rep CROSS JOIN (VALUES (0), (1), (2)) v(o) GROUP BY k),
s AS (SELECT k, doc_id, len(regexp_extract_all(t, '{_WORD}')) AS n_words, length(regexp_replace(t, '{_SPACE}+', '', 'g')) AS word_chars, length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS n_symbols,
list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS lines FROM d)
SELECT doc_id, n_words, word_chars, n_symbols, CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines, coalesce(cov.n, 0) AS n_repeat_words, n_words < 50 OR 100 * coalesce(cov.n, 0) > 50 * n_words AS base_failed
FROM s LEFT JOIN cov ON cov.k = s.k"""

_ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)"""
SECRETS = f"""SELECT doc_id, CAST(len(list_filter(regexp_extract_all(t, '{_ASSIGN}', 1), lambda x: length(x) >= 6)) AS BIGINT) AS n_assign,
CAST(len(list_filter(regexp_extract_all(t, 'AKIA[A-Z0-9]+'), lambda x: length(x) >= 20)) AS BIGINT) AS n_access, CAST(len(list_filter(regexp_extract_all(t, '[0-9a-f]+'), lambda x: length(x) >= 24)) AS BIGINT) AS n_hex FROM {_TEXT}"""

_DIGITS = "regexp_replace({0}, '[^0-9]', '', 'g')"
_LUHN = "list_sum(list_transform(range(1, length(y) + 1), lambda i: CASE WHEN i % 2 = 1 THEN CAST(reverse(y)[i] AS INT) WHEN CAST(reverse(y)[i] AS INT) > 4 THEN CAST(reverse(y)[i] AS INT) * 2 - 9 ELSE CAST(reverse(y)[i] AS INT) * 2 END)) % 10 = 0"
PERSONAL = rf"""SELECT doc_id, CAST(len(regexp_extract_all(t, '[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+')) AS BIGINT) AS n_email,
CAST(len(list_filter(regexp_extract_all(t, '[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)'), lambda x: len(list_filter(string_split(x, '.'), lambda p: length(ltrim(p, '0')) > 3 OR coalesce(try_cast(ltrim(p, '0') AS INT), 0) > 255)) = 0)) AS BIGINT) AS n_ip,
CAST(len(list_filter(list_filter(list_transform(regexp_extract_all(t, '[0-9]([\x20-]?[0-9])+'), lambda x: {_DIGITS.format('x')}), lambda y: length(y) BETWEEN 16 AND 19), lambda y: {_LUHN})) AS BIGINT) AS n_card,
CAST(len(list_filter(regexp_extract_all(t, '\+[0-9][\x20().0-9-]+[0-9]'), lambda x: length({_DIGITS.format('x')}) BETWEEN 8 AND 15)) AS BIGINT) AS n_phone FROM {_TEXT}"""

#: op11: everything, in integers.
DIVERGENCE = r"""
WITH d AS (
  SELECT coalesce(lang, '') AS lang, coalesce(source, '') AS source, row_number() OVER () AS id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS terms
  FROM documents),
w AS (SELECT lang, source, id, unnest(terms) AS term FROM d),
c AS (SELECT lang, source, term, count(*) AS c, count(DISTINCT id) AS docs FROM w GROUP BY ALL),
kept AS (SELECT lang, term, sum(c)::BIGINT AS c FROM c GROUP BY ALL HAVING sum(docs) >= 10),
v AS (SELECT lang, count(*) AS v, sum(c)::BIGINT AS n FROM kept GROUP BY ALL),
g AS (SELECT DISTINCT lang, source FROM d),
n AS (SELECT g.lang, g.source, v.v, v.n AS all_n, coalesce(sum(c.c) FILTER (kept.term IS NOT NULL), 0)::BIGINT AS n
      FROM g JOIN v USING (lang) LEFT JOIN c USING (lang, source) LEFT JOIN kept ON kept.lang = c.lang AND kept.term = c.term GROUP BY ALL),
p AS (SELECT n.lang, n.source, kept.term, coalesce(c.c, 0) AS c, 1 + (1000000000 * (coalesce(c.c, 0) + 2)) // (n.n + 2 * n.v) AS p,
             1 + (1000000000 * (kept.c + 2)) // (n.all_n + 2 * n.v) AS q
      FROM n JOIN kept USING (lang) LEFT JOIN c ON c.lang = n.lang AND c.source = n.source AND c.term = kept.term),
f AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p))::BIGINT AS value
      FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
every AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(f.value, 0) AS value
  FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN f ON f.lang = a.lang AND f.source = a.source AND f.item = b.source
  UNION ALL
  SELECT lang, source, 'term', term, (p - q) * (p - q) // (p + q) FROM p WHERE c > 0 AND p > q)
SELECT lang, source, part, item, value, rank FROM (
  SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, encode(item))::INTEGER AS rank FROM every)
WHERE part = 'pair' OR rank <= 10
"""

#: op13: every score of every anchor.
NEGATIVES = """
WITH r AS (
  SELECT vec_id AS id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, [floor(256 * x::DOUBLE) for x in embedding] AS v
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len([x for x in embedding if x IS NOT NULL AND isfinite(x)]) = len(embedding)),
s AS (
  SELECT a.id AS anchor_id, b.id AS id, a.label = b.label AS same, list_inner_product(a.v, b.v)::BIGINT AS score
  FROM r a JOIN r b ON a.id <> b.id WHERE a.id % 50 = 0),
p AS (
  SELECT anchor_id, id AS positive_id, score AS positive_score FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5)
SELECT p.anchor_id, positive_id, row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY s.score DESC, s.id)::INTEGER AS rank,
       s.id AS negative_id, positive_score, s.score AS negative_score
FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT s.same AND 100 * s.score BETWEEN 50 * positive_score AND 95 * positive_score
QUALIFY rank <= 3
"""
