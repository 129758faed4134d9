"""DuckDB SQL that gives the rows of those queries that SQL can express."""

ORACLES = {
    "op5_url_rules": """
WITH rules(host, path, action) AS (VALUES ('org', '/', 'allow'), ('example.org', '/es/', 'block'), ('example.org', '/en/1', 'block'), ('com', '/fr/', 'allow'), ('com', '/de/', 'block')),
parts AS (
  SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) END AS rest FROM pages),
split AS (
  SELECT page_id, coalesce(translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
         coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') AS path FROM parts)
SELECT s.page_id, s.host, s.path, arg_max(r.host || r.path, length(r.host || r.path)) AS rule,
       coalesce(arg_max(r.action, length(r.host || r.path)), 'allow') AS verdict
FROM split s LEFT JOIN rules r ON (s.host = r.host OR ends_with(s.host, '.' || r.host)) AND starts_with(s.path, r.path)
GROUP BY ALL
""",
}
