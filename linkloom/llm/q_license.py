"""op1: license scan of every text of `documents`."""

from pyspark.sql import functions as F

from linkloom.llm.common import table
from linkloom.llm.license_rules import rules
from linkloom.llm.license_scan import CONFIDENCE, pattern, scan_licenses
from linkloom.llm.registry import register

# fixed values
BASE = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}


def _values(rows):
    quote = lambda v: str(v) if isinstance(v, int) else "'" + v.replace("'", "''") + "'"
    return ", ".join("(" + ", ".join(quote(v) for v in r) + ")" for r in rows)


SQL = f"""
WITH rules(o, label, kw, rx, p) AS (VALUES {_values([(i, a, k, pattern(x), p) for i, (a, k, x, p) in enumerate(rules())])}),
base(o, label, kw, rx, p) AS (VALUES {_values([(i, a, x.split(' ')[0], pattern(x), 2) for i, (x, a) in enumerate(BASE.items())])}),
conf(p, c) AS (VALUES {', '.join(f'({p}, {c})' for p, c in CONFIDENCE.items())}),
w AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
        'abcdefghijklmnopqrstuvwxyz'), '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda x: x <> '') AS ws FROM documents),
n AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, len(ws) AS n_words, ' ' || array_to_string(ws, '  ') || ' ' AS norm FROM w),
hits AS (SELECT n.r, 0 AS is_base, o, label, p, string_split_regex(norm, rx) AS gaps, regexp_extract_all(norm, rx) AS hs
         FROM n JOIN rules ON contains(norm, ' ' || kw)
         UNION ALL SELECT n.r, 1, o, label, p, string_split_regex(norm, rx), regexp_extract_all(norm, rx)
         FROM n JOIN base ON contains(norm, ' ' || kw)),
long AS (SELECT r, is_base, o, label, p, j, (length(gaps[j]) - length(replace(gaps[j], ' ', ''))) // 2 AS g,
                (length(hs[j]) - length(replace(hs[j], ' ', ''))) // 2 AS h
         FROM (SELECT *, unnest(generate_series(1, len(hs))) AS j FROM hits WHERE len(hs) > 0)),
iv AS (SELECT r, is_base, o, label, p, sum(g + h) OVER w - h AS s, sum(g + h) OVER w AS e
       FROM long WINDOW w AS (PARTITION BY r, is_base, o ORDER BY j)),
kept AS (SELECT a.* FROM iv a WHERE is_base = 0 AND NOT EXISTS (
           SELECT 1 FROM iv b WHERE b.is_base = 0 AND b.r = a.r AND b.s <= a.s AND b.e >= a.e AND
             (b.p > a.p OR b.p = a.p AND (b.e - b.s > a.e - a.s OR b.o < a.o AND b.s = a.s AND b.e = a.e)))),
b AS (SELECT r, count(*) AS n_base, min(s) AS first_word, max(s) AS last_word, string_agg(DISTINCT label, ',' ORDER BY label) AS base_labels
      FROM iv WHERE is_base = 1 GROUP BY r),
l AS (SELECT r, string_agg(DISTINCT label, ',' ORDER BY label) AS labels
      FROM (SELECT r, label FROM kept UNION SELECT r, label FROM iv WHERE is_base = 1) GROUP BY r),
s AS (SELECT r, max(c) AS score FROM (SELECT r, p FROM kept UNION SELECT r, p FROM iv WHERE is_base = 1) JOIN conf USING (p) GROUP BY r)
SELECT n.doc_id, n.n_words, coalesce(b.n_base, 0) AS n_base, b.first_word, b.last_word,
       coalesce(b.base_labels, '') AS base_labels, coalesce(l.labels, '') AS labels, coalesce(s.score, 0.0)::DOUBLE AS score
FROM n LEFT JOIN b USING (r) LEFT JOIN l USING (r) LEFT JOIN s USING (r)
"""


@register("op1_license_scan", SQL)
def op1_license_scan(spark, sf_dir):
    x = scan_licenses(table(spark, sf_dir, "documents"), BASE)
    labels = lambda *cols: F.array_join(F.array_sort(F.array_distinct(F.concat(*cols))), ",")
    best = F.coalesce(F.array_max(F.transform(F.concat("base", "detections"), lambda d: d["p"])), F.lit(0))
    score = F.lit(0.0)
    for p, c in CONFIDENCE.items():
        score = F.when(best == p, F.lit(c)).otherwise(score)
    return x.select(
        F.col("id").alias("doc_id"), "n_words", F.size("base").cast("long").alias("n_base"),
        F.array_min(F.transform("base", lambda d: d["s"])).cast("long").alias("first_word"),
        F.array_max(F.transform("base", lambda d: d["s"])).cast("long").alias("last_word"),
        labels("base.label").alias("base_labels"), labels("base.label", "detections.label").alias("labels"),
        score.alias("score"))
