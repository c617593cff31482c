"""op2: repeated 13-word windows removed from every row of `documents`."""

from linkloom.llm.common import table
from linkloom.llm.debruijn import drop_repeats
from linkloom.llm.registry import register

SQL = r"""
WITH w AS (SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
g AS MATERIALIZED (SELECT doc_id, p, array_to_string(ws[p:p + 12], ' ') AS gram FROM (
       SELECT doc_id, ws, unnest(generate_series(1, len(ws) - 12)) AS p FROM w WHERE len(ws) >= 13)),
f AS (SELECT md5(gram) AS m, min(doc_id) AS lo FROM g GROUP BY 1),
hit AS (SELECT g.doc_id, g.p FROM g JOIN f ON md5(g.gram) = f.m WHERE f.lo < g.doc_id),
gone AS (SELECT doc_id, list(DISTINCT p + i) AS ps FROM hit, range(13) t(i) GROUP BY doc_id),
k AS (SELECT w.doc_id, len(ws) AS n, CASE WHEN ps IS NULL THEN ws ELSE list_filter(ws, lambda x, i: NOT list_contains(ps, i)) END AS kept
      FROM w LEFT JOIN gone USING (doc_id))
SELECT doc_id, n::BIGINT AS n_words, (n - len(kept))::BIGINT AS n_removed, sha256(array_to_string(kept, ' ')) AS kept_sha256 FROM k
"""


@register("op2_substring_dedup", SQL)
def op2_substring_dedup(spark, sf_dir):
    return drop_repeats(table(spark, sf_dir, "documents"))
