"""DuckDB SQL of the corpus queries that SQL can express."""

from __future__ import annotations

from . import urlfilter

_SEGMENT_LEVELS = "".join(
    f"""
children_{d} AS (
  SELECT host, prefix, segments[{d + 1}] AS segment, sum(pages) AS in_child FROM rows_{d - 1}
  WHERE len(segments) > {d} GROUP BY ALL),
varying_{d} AS (
  SELECT c.host, c.prefix, c.segment FROM children_{d} c
  JOIN (SELECT host, prefix, count(*) AS kinds, sum(in_child) AS in_all FROM children_{d} GROUP BY ALL) p
    ON c.host = p.host AND c.prefix = p.prefix
  WHERE kinds > {urlfilter.BRANCHES} AND in_child * {urlfilter.BRANCHES} < in_all),
rows_{d} AS (
  SELECT r.host, lexical, segments, pages, n, b,
    CASE WHEN len(segments) <= {d} THEN r.prefix
         ELSE r.prefix || '/' || CASE WHEN v.segment IS NOT NULL THEN '*' ELSE segments[{d + 1}] END END AS prefix
  FROM rows_{d - 1} r LEFT JOIN varying_{d} v ON r.host = v.host AND r.prefix = v.prefix AND segments[{d + 1}] = v.segment),"""
    for d in range(1, urlfilter.LEVELS + 1)
)

_RULES = ", ".join(f"('{rule.partition('/')[0]}', '/{rule.partition('/')[2]}', '{rule}', '{verdict}')" for rule, verdict in urlfilter.RULES)

URL_FILTERS = f"""
WITH split AS (
  SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
urls AS (
  SELECT page_id, translate(regexp_extract(coalesce(rest, ''), '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(coalesce(rest, ''), '^[^/?#]*([^?#]*)', 1) AS path FROM split),
rules(name, begin, rule, verdict) AS (VALUES {_RULES}),
ruled AS (
  SELECT page_id, max_by(rule, length(rule)) AS rule, max_by(verdict, length(rule)) AS said
  FROM urls JOIN rules ON (host = name OR host LIKE '%.' || name) AND starts_with(path, begin) GROUP BY page_id),
known AS (
  SELECT u.page_id, bool_or(quality = 0 OR toxic = 1) AS bad FROM urls u
  JOIN labels l ON l.doc_id = try_cast(nullif(regexp_extract(path, '([0-9]+)[^0-9/]*/?$', 1), '') AS BIGINT)
  GROUP BY u.page_id HAVING bool_or(quality = 0 OR toxic = 1) IS NOT NULL),
counted AS (
  SELECT host, regexp_replace(path, '[0-9]+', '#', 'g') AS lexical, count(*) AS pages, count(bad) AS n, count(*) FILTER (bad) AS b
  FROM urls LEFT JOIN known USING (page_id) GROUP BY ALL),
rows_0 AS (SELECT *, string_split(lexical, '/') AS segments, '' AS prefix FROM counted),{_SEGMENT_LEVELS}
tree AS (
  SELECT *, regexp_replace(template, '/[^/]*$', '') AS parent FROM (
    SELECT host, lexical, n, b, CASE WHEN len(segments) > {urlfilter.LEVELS + 1}
      THEN prefix || '/' || array_to_string(segments[{urlfilter.LEVELS + 2}:], '/') ELSE prefix END AS template
    FROM rows_{urlfilter.LEVELS})),
branches AS (
  SELECT t.host, t.parent, template, n, b, n_all - n AS m, b_all - b AS others, b_all / n_all::DOUBLE AS pooled
  FROM (SELECT host, parent, template, sum(n) AS n, sum(b) AS b FROM tree GROUP BY ALL) t
  JOIN (SELECT host, parent, sum(n) AS n_all, sum(b) AS b_all FROM tree GROUP BY ALL) p ON t.host = p.host AND t.parent = p.parent),
parted AS (
  SELECT *, CASE WHEN n > 0 AND m > 0 AND abs(b / n::DOUBLE - others / m::DOUBLE) > {urlfilter.Z} * sqrt(pooled * (1 - pooled) * (1.0::DOUBLE / n + 1.0::DOUBLE / m))
    THEN template ELSE '' END AS branch FROM branches),
merged AS (SELECT host, parent, branch, sum(n) AS n_m, sum(b) AS b_m FROM parted GROUP BY ALL),
hosts AS (SELECT host, sum(n) AS n_h, sum(b) AS b_h FROM tree GROUP BY host),
every AS (SELECT CASE WHEN sum(n) > 0 THEN (sum(n) - sum(b)) / sum(n)::DOUBLE ELSE 1 END AS purity FROM tree),
learned AS (
  SELECT p.host, p.template, CASE WHEN (n_m - b_m + {urlfilter.SMOOTHING} * ((n_h - b_h + {urlfilter.SMOOTHING} * purity) / (n_h + {urlfilter.SMOOTHING})))
      / (n_m + {urlfilter.SMOOTHING}) < {urlfilter.LEAST_PURITY} THEN 'block' ELSE 'allow' END AS learned
  FROM parted p JOIN merged m ON p.host = m.host AND p.parent = m.parent AND p.branch = m.branch JOIN hosts h ON p.host = h.host CROSS JOIN every)
SELECT u.page_id, u.host, u.path, r.rule, coalesce(r.said, l.learned) AS verdict, t.template
FROM urls u LEFT JOIN ruled r USING (page_id)
LEFT JOIN tree t ON t.host = u.host AND t.lexical = regexp_replace(u.path, '[0-9]+', '#', 'g')
LEFT JOIN learned l ON l.host = t.host AND l.template = t.template
"""

ORACLES = {"op8_url_filters": URL_FILTERS}
