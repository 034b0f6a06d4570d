"""The SQL of those queries that SQL can express."""

from __future__ import annotations

from erascope.llm.urls import all_rules

# The mix by running sums over the sorted places, without histograms.
MIX = r"""
WITH d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '') || ':' || coalesce(text, '')), 1, 15))::BIGINT AS place
  FROM documents
), s AS (
  SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS nth FROM d GROUP BY source
), w AS (
  SELECT *, [3.0, 1.0, 2.0][1 + (nth - 1) % 3]::DOUBLE AS weight, source_size * 2.0::DOUBLE AS stop FROM s
), r AS (
  SELECT *, row_number() OVER (ORDER BY stop / weight, nth) AS k FROM w
), l AS (
  SELECT a.k, ((SELECT sum(source_size) FROM r) * 1.5::DOUBLE - coalesce((SELECT sum(stop) FROM r b WHERE b.k < a.k), 0))
         / (SELECT sum(weight) FROM r b WHERE b.k >= a.k) AS level, a.stop, a.weight
  FROM r a
), x AS (
  SELECT level FROM l WHERE stop >= level * weight ORDER BY k LIMIT 1
), t AS (
  SELECT source, source_size, least(stop, (SELECT level FROM x) * weight) AS target FROM r
), p AS (
  SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END AS passes,
         target - CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END * source_size AS rest
  FROM t
), h AS (
  SELECT source, place, sum(size) AS words, count(*) AS copies FROM d GROUP BY ALL
), c AS (
  SELECT *, sum(words) OVER (PARTITION BY source ORDER BY place) AS passed FROM h
), e AS (
  SELECT c.source, c.place, passes,
         CASE WHEN passed <= rest THEN copies WHEN passed - words >= rest THEN 0
              ELSE floor((rest - (passed - words)) * copies / words)
                   + CASE WHEN ((rest - (passed - words)) * copies / words) - floor((rest - (passed - words)) * copies / words) > 0.5 THEN 1 ELSE 0 END END AS more
  FROM c JOIN p ON c.source IS NOT DISTINCT FROM p.source
), n AS (
  SELECT *, row_number() OVER (PARTITION BY source, place) AS nth FROM d
)
SELECT doc_id, n.size, p.source_size, p.target::DOUBLE AS target,
       (n.size * least(e.passes + CASE WHEN nth <= more THEN 1 ELSE 0 END, 2))::BIGINT AS taken
FROM n JOIN p ON n.source IS NOT DISTINCT FROM p.source
JOIN e ON e.source IS NOT DISTINCT FROM n.source AND e.place = n.place
"""


# Every rule tried on every URL.
URLS = r"""
WITH p AS (
  SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages
), q AS (
  SELECT page_id, translate(rest, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS lowered,
         translate(regexp_extract(rest, '(?s)^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '(?s)^[^/?#]*([^?#]*)', 1) AS path
  FROM p
), r AS (
  SELECT * FROM (VALUES {rules}) AS t(name, verdict, base, regex)
), f AS (
  SELECT page_id, lowered, host, path,
         (SELECT max_by(r, len(name)) FROM r WHERE base AND regexp_matches(q.host || q.path, regex)) AS b,
         (SELECT min_by(r, (verdict <> 'allow')::INT::VARCHAR || name) FROM r WHERE NOT base AND regexp_matches(q.lowered, regex)) AS m
  FROM q
)
SELECT page_id, host, path, b.name AS rule, coalesce(b.verdict, m.verdict, 'allow') AS verdict,
       CASE WHEN b.name IS NULL THEN m.name END AS pattern
FROM f
"""


# The checksum by its table of 256 entries, neighbours by all pairs that share a word with a letter left out.
VARIANTS = r"""
WITH RECURSIVE crc_table AS (
  SELECT list_transform(range(256), lambda i: list_reduce(list_prepend(i, range(8)),
           lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS entries
), runs AS (
  SELECT coalesce(doc_id::VARCHAR, '') AS name, count(*) AS n,
         translate(run, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run
  FROM (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-z\x{00C0}-\x{00FF}]+')) AS run FROM documents)
  GROUP BY ALL
), summed AS (
  SELECT run, n, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(octet_length(bytes)), lambda k: ('0x' || substr(hex(bytes), 2 * k + 1, 2))::BIGINT)),
           lambda c, b: xor(c >> 8, entries[1 + (xor(c, b) & 255)])), 4294967295) AS h
  FROM (SELECT run, n, encode(name || ':' || run) AS bytes FROM runs), crc_table
), words AS (
  SELECT word, sum(n)::BIGINT AS n
  FROM (SELECT n, CASE WHEN h % 97 = 0 THEN left(run, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word FROM summed)
  WHERE length(word) >= 5 GROUP BY word HAVING sum(n) >= 3
), gaps AS (
  SELECT word, n, left(word, i) || '$' || substr(word, i + 2) AS gap, left(word, i) || substr(word, i + 2) AS rest
  FROM (SELECT word, n, unnest(range(length(word))) AS i FROM words)
), pairs AS (
  SELECT a.word, b.word AS near, b.n AS near_n FROM gaps a JOIN gaps b ON a.gap = b.gap AND a.word <> b.word
  UNION SELECT g.word, w.word, w.n FROM gaps g JOIN words w ON g.rest = w.word
  UNION SELECT w.word, g.word, g.n FROM gaps g JOIN words w ON g.rest = w.word
), best AS (
  SELECT word, count(*) AS n_near, max(near_n) AS near_n, min(encode(near)) FILTER (near_n = top) AS near
  FROM (SELECT *, max(near_n) OVER (PARTITION BY word) AS top FROM pairs) GROUP BY word
), forms AS (
  SELECT word, n, coalesce(n_near, 0)::BIGINT AS n_near,
         CASE WHEN near_n >= 2 * n THEN decode(near) END AS form, CASE WHEN near_n >= 2 * n THEN near_n END AS form_n
  FROM words LEFT JOIN best USING (word)
), steps AS (
  SELECT word, word AS at FROM forms
  UNION ALL SELECT s.word, f.form FROM steps s JOIN forms f ON s.at = f.word WHERE f.form IS NOT NULL
), roots AS (
  SELECT s.word, s.at AS root FROM steps s JOIN forms f ON s.at = f.word WHERE f.form IS NULL
)
SELECT word, form, root, n, n_near, form_n::BIGINT AS form_n FROM forms JOIN roots USING (word)
"""


def url_sql() -> str:
    rows = (f"('{r.name}', '{r.verdict}', {r.base}, '(?s){r.regex}')" for r in all_rules())
    return URLS.format(rules=", ".join(rows))


def build() -> dict[str, str]:
    return {"op4_source_mix": MIX, "op6_url_filter": url_sql(), "op12_spelling_variants": VARIANTS}
