"""DuckDB SQL with the same results, for the queries that SQL can express."""

from __future__ import annotations

OP3 = """
WITH split AS (
  SELECT page_id, coalesce(url, '') AS url,
    CASE WHEN strpos(coalesce(url, ''), '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest
  FROM pages
), parts AS (
  SELECT *, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path
  FROM split
), rules(rule, verdict) AS (
  VALUES ('org/', 'allow'), ('example.org/es/', 'block'), ('example.org/en/1', 'block'), ('com/fr/', 'allow'), ('com/de/', 'block')
), fits AS (
  SELECT DISTINCT p.host, p.path, max_by(r.rule, length(r.rule)) AS rule, max_by(r.verdict, length(r.rule)) AS verdict
  FROM (SELECT DISTINCT host, path FROM parts) p
  JOIN rules r ON (p.host = split_part(r.rule, '/', 1) OR ends_with(p.host, '.' || split_part(r.rule, '/', 1)))
    AND starts_with(p.path, substr(r.rule, strpos(r.rule, '/')))
  GROUP BY p.host, p.path
), urls AS (
  SELECT DISTINCT p.url, lower(p.rest) AS text, f.verdict, substr(md5(p.url), 1, 1) IN ('0', '1', '2') AS held
  FROM parts p LEFT JOIN fits f USING (host, path)
), posts AS (
  SELECT url, substr(chr(2) || chr(2) || chr(2) || chr(2) || text || chr(3), CAST(i AS BIGINT), 5) AS gram,
    CASE WHEN verdict = 'allow' AND NOT held THEN 1 ELSE 0 END AS good, CASE WHEN verdict = 'block' AND NOT held THEN 1 ELSE 0 END AS bad
  FROM (SELECT *, unnest(range(1, length(text) + 2)) AS i FROM urls)
), grams AS (
  SELECT gram, sum(good) AS good, sum(bad) AS bad FROM posts GROUP BY gram
), tails AS (
  SELECT right(gram, k) AS tail, left(right(gram, k), k - 1) AS context, sum(good) AS good, sum(bad) AS bad
  FROM grams, (VALUES (1), (2), (3), (4), (5)) o(k) GROUP BY ALL
), contexts AS (
  SELECT context, sum(good) AS h_good, sum(bad) AS h_bad, count(*) FILTER (good > 0) AS k_good, count(*) FILTER (bad > 0) AS k_bad
  FROM tails GROUP BY context
), known AS (
  SELECT t.tail, t.good, t.bad, c.* EXCLUDE (context) FROM tails t JOIN contexts c USING (context)
), p0 AS (SELECT gram, 1.0::DOUBLE / 256 AS g, 1.0::DOUBLE / 256 AS b FROM grams),
p1 AS (SELECT p0.gram, CASE WHEN h_good > 0 THEN (good + k_good * g) / (h_good + k_good) ELSE g END AS g,
    CASE WHEN h_bad > 0 THEN (bad + k_bad * b) / (h_bad + k_bad) ELSE b END AS b FROM p0 JOIN known ON tail = right(gram, 1)),
p2 AS (SELECT p1.gram, CASE WHEN h_good > 0 THEN (good + k_good * g) / (h_good + k_good) ELSE g END AS g,
    CASE WHEN h_bad > 0 THEN (bad + k_bad * b) / (h_bad + k_bad) ELSE b END AS b FROM p1 JOIN known ON tail = right(gram, 2)),
p3 AS (SELECT p2.gram, CASE WHEN h_good > 0 THEN (good + k_good * g) / (h_good + k_good) ELSE g END AS g,
    CASE WHEN h_bad > 0 THEN (bad + k_bad * b) / (h_bad + k_bad) ELSE b END AS b FROM p2 JOIN known ON tail = right(gram, 3)),
p4 AS (SELECT p3.gram, CASE WHEN h_good > 0 THEN (good + k_good * g) / (h_good + k_good) ELSE g END AS g,
    CASE WHEN h_bad > 0 THEN (bad + k_bad * b) / (h_bad + k_bad) ELSE b END AS b FROM p3 JOIN known ON tail = right(gram, 4)),
p5 AS (SELECT p4.gram, CASE WHEN h_good > 0 THEN (good + k_good * g) / (h_good + k_good) ELSE g END AS g,
    CASE WHEN h_bad > 0 THEN (bad + k_bad * b) / (h_bad + k_bad) ELSE b END AS b FROM p4 JOIN known ON tail = right(gram, 5)),
scores AS (
  SELECT p.url, sum(ln(g) - ln(b)) / count(*) AS score FROM posts p JOIN p5 USING (gram) GROUP BY p.url
), moments AS (
  SELECT u.verdict, avg(score) AS mean, stddev_pop(score) + 1e-9 AS dev
  FROM urls u JOIN scores USING (url) WHERE held AND u.verdict IS NOT NULL GROUP BY u.verdict
), bound AS (
  SELECT coalesce((a.mean * b.dev + b.mean * a.dev) / (a.dev + b.dev), 0.0) AS t
  FROM (SELECT 1) LEFT JOIN moments a ON a.verdict = 'allow' LEFT JOIN moments b ON b.verdict = 'block'
)
SELECT p.page_id, p.host, p.path, f.rule,
  coalesce(f.verdict, CASE WHEN s.score >= (SELECT t FROM bound) THEN 'allow' ELSE 'block' END) AS verdict
FROM parts p LEFT JOIN fits f USING (host, path) LEFT JOIN scores s ON s.url = p.url
"""

OP7 = """
WITH sized AS (
  SELECT *, greatest(strlen(coalesce(text, '')), 1) AS size FROM documents
), sizes AS (
  SELECT source, sum(size)::DOUBLE AS size FROM sized GROUP BY source
), rates AS (
  SELECT source, pow(size, 0.5) / sum(pow(size, 0.5)) OVER () * sum(size) OVER () / size AS rate FROM sizes
), parts AS (
  SELECT source, greatest(ceil(rate / 16.0), 1)::BIGINT AS parts, rate / greatest(ceil(rate / 16.0), 1)::BIGINT AS mean FROM rates
), terms AS (
  SELECT source, parts, k, CASE WHEN k = 0 THEN exp(-mean) ELSE exp(-mean + k * ln(mean) - lgamma(k + 1)) END AS p
  FROM parts, range(0, 71) t(k)
), cdf AS (
  SELECT source, parts, list(f ORDER BY k) AS steps
  FROM (SELECT source, parts, k, sum(p) OVER (PARTITION BY source ORDER BY k) AS f FROM terms) GROUP BY source, parts
), draws AS (
  SELECT d.doc_id, d.source, d.text, d.lang, d.n_chars, c.steps, unnest(range(1, c.parts + 1)) AS i, d.rid
  FROM (SELECT *, row_number() OVER () AS rid FROM documents) d JOIN cdf c ON d.source IS NOT DISTINCT FROM c.source
), counts AS (
  SELECT rid, doc_id, source, text, lang, n_chars, sum(length(list_filter(steps, lambda x: x <= u))) AS copies
  FROM (SELECT *, ('0x' || substr(md5('mix-1|' || coalesce(doc_id::VARCHAR, 'null') || '|' || i), 1, 13))::BIGINT / 4503599627370496.0 AS u FROM draws)
  GROUP BY ALL
)
SELECT doc_id, text, lang, source, n_chars, CAST(replica AS INTEGER) AS replica,
  md5('mix-1|place|' || coalesce(doc_id::VARCHAR, 'null') || '|' || replica) AS place
FROM (SELECT *, unnest(range(1, CAST(copies AS BIGINT) + 1)) AS replica FROM counts)
"""


OP11 = r"""
WITH read AS (
    SELECT doc_id, regexp_extract_all(
        translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS terms
    FROM documents
),
docs AS (SELECT doc_id, terms, len(terms)::BIGINT AS n FROM read WHERE len(terms) > 0),
totals AS (SELECT count(*)::BIGINT AS docs, sum(n)::BIGINT AS length FROM docs),
asked AS (
    SELECT DISTINCT item_id, unnest(regexp_extract_all(
        translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
    FROM benchmark
),
each AS (SELECT doc_id, n, unnest(terms) AS term FROM docs),
counts AS (
    SELECT doc_id, n, term, count(*)::BIGINT AS tf FROM each
    WHERE term IN (SELECT term FROM asked) GROUP BY doc_id, n, term
),
weights AS (
    SELECT term, floor(1000 * ln((2.0::DOUBLE * docs + 2) / (2.0::DOUBLE * df + 1)))::BIGINT AS w
    FROM (SELECT term, count(*)::BIGINT AS df FROM counts GROUP BY term), totals
),
scores AS (
    SELECT item_id, doc_id,
        sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * docs) // length))))::BIGINT AS score
    FROM counts JOIN weights USING (term) JOIN asked USING (term), totals
    GROUP BY item_id, doc_id
)
SELECT item_id, rank, doc_id, score FROM (
    SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INTEGER AS rank, doc_id, score
    FROM scores WHERE score > 0
) WHERE rank <= 50
"""
