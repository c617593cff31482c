"""op10: every url of `pages` against the rules, aliases included."""

from linkloom.llm.common import table
from linkloom.llm.redirects import judge_urls, rule_table
from linkloom.llm.registry import register

# fixed values: (action, host, path)
RULES = [("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"),
         ("allow", "com", "/fr/"), ("block", "com", "/de/")]

# The recursion walks the alias classes; links are absolute or root-relative here.
SQL = r"""
WITH RECURSIVE p AS (
  SELECT page_id, coalesce(url, '') AS url, coalesce(html, '') AS html,
         CASE WHEN contains(url, '://') THEN regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', ['h', 'p'])
              ELSE {'h': '', 'p': ''} END AS x FROM pages),
rules(action, host, path) AS (VALUES ('allow', 'org', '/'), ('block', 'example.org', '/es/'),
  ('block', 'example.org', '/en/1'), ('allow', 'com', '/fr/'), ('block', 'com', '/de/')),
u AS (SELECT page_id, url, html, translate(x.h, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
             x.p AS path, regexp_replace(url, '(?s)#.*$', '') AS node FROM p),
hit AS (SELECT u.page_id, u.host, u.path, arg_max(r.host || r.path, length(r.host || r.path)) AS rule,
               arg_max(r.action, length(r.host || r.path)) AS act
        FROM (SELECT DISTINCT page_id, host, path FROM u) u JOIN rules r
          ON (u.host = r.host OR ends_with(u.host, '.' || r.host)) AND starts_with(u.path, r.path)
        GROUP BY ALL),
link AS (SELECT node AS src, page_id, regexp_extract(regexp_extract(html, '(?is)<link[^>]*rel="?canonical[^>]*>'),
                'href="([^"]*)"', 1) AS dst FROM u),
edge AS (SELECT src, dst FROM link WHERE dst <> '' UNION SELECT dst, src FROM link WHERE dst <> ''),
reach(a, b) AS (SELECT src, src FROM edge UNION SELECT r.a, e.dst FROM reach r JOIN edge e ON r.b = e.src),
votes AS (SELECT r.a AS node, bool_or(h.act = 'allow') AS al, bool_or(h.act = 'block') AS bl
          FROM reach r JOIN u ON u.node = r.b JOIN hit h USING (page_id) GROUP BY 1)
SELECT u.page_id, u.host, u.path, h.rule,
       coalesce(h.act, CASE WHEN v.al THEN 'allow' WHEN v.bl THEN 'block' END, 'allow') AS verdict
FROM u LEFT JOIN hit h ON u.page_id = h.page_id AND u.host = h.host AND u.path = h.path
LEFT JOIN votes v ON v.node = u.node
"""


@register("op10_url_filter", SQL)
def op10_url_filter(spark, sf_dir):
    out = judge_urls(table(spark, sf_dir, "pages"), rule_table(spark, RULES))
    return out.select("page_id", "host", "path", "rule", "verdict")
