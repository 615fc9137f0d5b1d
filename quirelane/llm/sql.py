"""DuckDB SQL with the rows of those queries of this subpackage that SQL can express."""

_BASE_RULES = "VALUES ('org', '/', 'allow'), ('example.org', '/es/', 'block'), ('example.org', '/en/1', 'block'), ('com', '/fr/', 'allow'), ('com', '/de/', 'block')"
_WORDS = "casino|bets|poker|slots|spam|link[^a-z0-9/]+farm|ads|adserver|tracker|porn|xxx|malware|phishing|warez"
_PATHS = "wp[^A-Za-z0-9/]+login|wp[^A-Za-z0-9/]+admin|phpmyadmin|cgi[^A-Za-z0-9/]+bin|trackback|affiliate[^A-Za-z0-9/]+link|adserver|account[^A-Za-z0-9/]+verify"

OP9 = rf"""
WITH parts AS (
  SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages
), places AS (
  SELECT page_id,
    translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path
  FROM parts
), rules(rule_host, rule_path, action) AS ({_BASE_RULES}),
fits AS (
  SELECT page_id, arg_max(rule_host || rule_path, length(rule_host || rule_path)) AS rule, arg_max(action, length(rule_host || rule_path)) AS action
  FROM places JOIN rules ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path)
  GROUP BY page_id
)
SELECT p.page_id, p.host, p.path, f.rule,
  coalesce(f.action, CASE WHEN regexp_matches(p.host, '(^|[^a-z0-9])({_WORDS})([^a-z0-9]|$)') OR regexp_matches(p.path, '(^|[^A-Za-z0-9])(?i:{_PATHS})([^A-Za-z0-9]|$)') THEN 'block' ELSE 'allow' END) AS verdict
FROM places p LEFT JOIN fits f USING (page_id)
"""

OP11 = r"""
WITH docs AS (
  SELECT row_number() OVER () AS i, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS body FROM documents
), words AS (
  SELECT i, lang, source, unnest(regexp_extract_all(body, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM docs
), kept AS (
  SELECT lang, term, count(*) AS n FROM words GROUP BY lang, term HAVING count(DISTINCT i) >= 10
), langs AS (
  SELECT d.lang, coalesce(any_value(k.v), 0)::HUGEINT AS v, coalesce(any_value(k.n), 0)::HUGEINT AS n
  FROM (SELECT DISTINCT lang FROM docs) d LEFT JOIN (SELECT lang, count(*) AS v, sum(n) AS n FROM kept GROUP BY lang) k ON d.lang = k.lang GROUP BY d.lang
), counts AS (
  SELECT w.lang, w.source, w.term, count(*) AS n FROM words w JOIN kept k ON w.lang = k.lang AND w.term = k.term GROUP BY ALL
), groups AS (
  SELECT g.lang, g.source, l.v, l.n AS lang_n, coalesce(c.n, 0)::HUGEINT AS n FROM (SELECT DISTINCT lang, source FROM docs) g JOIN langs l ON g.lang = l.lang
  LEFT JOIN (SELECT lang, source, sum(n) AS n FROM counts GROUP BY ALL) c ON g.lang = c.lang AND g.source = c.source
), shares AS (
  SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS times, 1 + (1000000000::HUGEINT * (coalesce(c.n, 0) + 2)) // (g.n + 2 * g.v) AS p,
    1 + (1000000000::HUGEINT * (k.n + 2)) // (g.lang_n + 2 * g.v) AS q
  FROM groups g JOIN kept k ON g.lang = k.lang LEFT JOIN counts c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term
), pairs AS (
  SELECT g.lang, g.source, h.source AS item, coalesce(s.value, 0)::BIGINT AS value
  FROM groups g JOIN groups h ON g.lang = h.lang AND g.source <> h.source
  LEFT JOIN (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) AS value
    FROM shares a JOIN shares b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL) s ON s.lang = g.lang AND s.source = g.source AND s.item = h.source
), ranked AS (
  SELECT lang, source, 'pair' AS part, item, value, (row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item))::INTEGER AS rank FROM pairs
  UNION ALL
  SELECT lang, source, 'term', term, value, (row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, term))::INTEGER
  FROM (SELECT lang, source, term, ((p - q) * (p - q) // (p + q))::BIGINT AS value FROM shares WHERE times > 0 AND p > q)
)
SELECT * FROM ranked WHERE part = 'pair' OR rank <= 10
"""

OP13 = r"""
WITH measured AS (
  SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS body, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents
), marks AS (
  SELECT doc_id, coalesce(bool_or(quality = 1), false) AS good, coalesce(bool_or(toxic = 1), false) AS toxic FROM labels GROUP BY doc_id
), failed AS (
  SELECT m.part, coalesce(k.good, false) AS good, coalesce(k.toxic, false) AS toxic, [
    len(words) < 200, 100 * len(list_distinct(words)) < 50 * len(words),
    100 * (length(body) - length(regexp_replace(body, '[A-Z]', '', 'g'))) > 2 * length(body), regexp_matches(body, '[#$%&*|]'),
    coalesce(m.doc_id > min(m.doc_id) OVER (PARTITION BY body), false)] AS fails
  FROM measured m LEFT JOIN marks k ON m.doc_id = k.doc_id
), counts AS (
  SELECT part, good, toxic, fails, count(*) AS n FROM failed GROUP BY ALL
), letters AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS l), orders AS (
  SELECT a.l || b.l || c.l || d.l || e.l AS filter_order FROM letters a, letters b, letters c, letters d, letters e
  WHERE a.l NOT IN (b.l, c.l, d.l, e.l) AND b.l NOT IN (c.l, d.l, e.l) AND c.l NOT IN (d.l, e.l) AND d.l <> e.l
), steps AS (
  SELECT filter_order, step, ascii(substr(filter_order, step, 1)) - 64 AS f, list_transform(range(1, step), lambda i: ascii(substr(filter_order, i::INT, 1)) - 64) AS earlier
  FROM orders, (SELECT unnest(range(1, 6))::INT AS step)
), effects AS (
  SELECT part, filter_order, step, f,
    coalesce(sum(n) FILTER (NOT fails[f] AND NOT gone), 0)::BIGINT AS kept, coalesce(sum(n) FILTER (fails[f] AND NOT gone), 0)::BIGINT AS removed,
    coalesce(sum(n) FILTER (fails[f] AND gone), 0)::BIGINT AS redundant,
    coalesce(sum(n) FILTER (fails[f] AND len(list_filter(fails, lambda x: x)) = 1), 0)::BIGINT AS unique_fails,
    coalesce(sum(n) FILTER (fails[f] AND NOT gone AND good), 0)::BIGINT AS good_lost, coalesce(sum(n) FILTER (fails[f] AND NOT gone AND toxic), 0)::BIGINT AS toxic_lost
  FROM (SELECT *, list_bool_or(list_transform(earlier, lambda i: fails[i])) IS TRUE AS gone FROM counts, steps)
  GROUP BY part, filter_order, step, f
)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, (sum(removed) OVER (PARTITION BY part, f))::BIGINT AS shapley FROM effects
"""

ORACLE_SQL = {"op9_urls": OP9, "op11_divergence": OP11, "op13_filters": OP13}
