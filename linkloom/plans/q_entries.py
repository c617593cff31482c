"""Queries for URL/date scalars (P1-P8, P12-P18), S5, A1, A2, W1-W3, W7."""

from __future__ import annotations

from pyspark.sql import functions as F

from linkloom.functions import text as T
from linkloom.functions import urls as U
from linkloom.operators import entries as E
from linkloom.plans.registry import register
from linkloom.sources import formats
from linkloom.sources.tables import (DOCS_AS_ENTRIES_SQL, DOMAIN_SQL, ENTRIES_DUP_SQL, ENTRIES_SQL,
                                     docs_as_entries, entries, entries_dup, load)

W = "WITH " + ENTRIES_SQL + " "


@register("p1_url_domain", "SELECT page_id, " + DOMAIN_SQL.format(c="url") + " AS domain FROM pages")
def p1_url_domain(spark, sf):
    return load(spark, sf, "pages").select("page_id", U.url_domain(F.col("url")).alias("domain"))


# Every entry date written as an export header, plus one malformed header per row.
_P2_SQL = W + """, created AS (
  SELECT pos, 'ok' AS kind, 'Created ' || strftime(date, '%-m/%-d/%Y, %-I:%M:%S %p') AS header FROM entries
  UNION ALL SELECT pos, 'bad' AS kind, 'Created ' || strftime(date, '%Y-%m-%d') AS header FROM entries)
SELECT pos, kind, strftime(CASE WHEN regexp_full_match(header, 'Created \\d{1,2}/\\d{1,2}/\\d{4}, \\d{1,2}:\\d{2}:\\d{2} [AP]M')
  THEN try_strptime(substr(header, 9), '%m/%d/%Y, %I:%M:%S %p') END, '%Y-%m-%d %H:%M:%S') AS parsed FROM created"""


@register("p2_onetab_date", _P2_SQL)
def p2_onetab_date(spark, sf):
    e = entries(spark, sf)
    created = e.select("pos", F.lit("ok").alias("kind"),
                       F.concat(F.lit("Created "), F.date_format("date", "M/d/yyyy, h:mm:ss a")).alias("header")) \
        .unionByName(e.select("pos", F.lit("bad").alias("kind"),
                              F.concat(F.lit("Created "), F.date_format("date", "yyyy-MM-dd")).alias("header")))
    return created.select("pos", "kind",
                          F.date_format(U.onetab_date(F.col("header")), "yyyy-MM-dd HH:mm:ss").alias("parsed"))


_P3_SQL = W + """, stamps AS (
  SELECT pos, CASE WHEN pos % 4 = 0 THEN 'n/a' ELSE CAST(1704067200 + pos * 3600 AS VARCHAR) END AS add_date,
         CASE WHEN pos % 3 = 0 THEN '' ELSE CAST(1704067200 + pos * 3600 + 1 AS VARCHAR) END AS last_modified
  FROM entries)
SELECT pos, strftime(COALESCE(
  CASE WHEN regexp_full_match(add_date, '[0-9]{1,12}') THEN TIMESTAMP '1970-01-01' + to_seconds(CAST(add_date AS BIGINT)) END,
  CASE WHEN regexp_full_match(last_modified, '[0-9]{1,12}') THEN TIMESTAMP '1970-01-01' + to_seconds(CAST(last_modified AS BIGINT)) END),
  '%Y-%m-%d %H:%M:%S') AS date FROM stamps"""


@register("p3_epoch_date", _P3_SQL)
def p3_epoch_date(spark, sf):
    e = entries(spark, sf)
    secs = F.lit(1704067200) + F.col("pos") * 3600
    stamps = e.select(
        "pos",
        F.when(F.col("pos") % 4 == 0, F.lit("n/a")).otherwise(secs.cast("string")).alias("add_date"),
        F.when(F.col("pos") % 3 == 0, F.lit("")).otherwise((secs + 1).cast("string")).alias("last_modified"))
    return stamps.select("pos", F.date_format(U.epoch_date(F.col("add_date"), F.col("last_modified")),
                                              "yyyy-MM-dd HH:mm:ss").alias("date"))


_P4_SQL = """WITH urls AS (
  SELECT page_id, 'web' AS kind, url FROM pages
  UNION ALL SELECT page_id, 'file', 'file:///tmp/' || CAST(page_id AS VARCHAR) || '.html' FROM pages
  UNION ALL SELECT page_id, 'ext', 'chrome-extension://abcdef/' || CAST(page_id AS VARCHAR) FROM pages
  UNION ALL SELECT page_id, 'inner', url || '?next=file:///x' FROM pages)
SELECT page_id, kind, url FROM urls
WHERE NOT (starts_with(url, 'chrome-extension://') OR contains(url, 'file:///'))"""


@register("p4_drop_local_urls", _P4_SQL)
def p4_drop_local_urls(spark, sf):
    p = load(spark, sf, "pages")
    pid = F.col("page_id").cast("string")
    urls = p.select("page_id", F.lit("web").alias("kind"), "url") \
        .unionByName(p.select("page_id", F.lit("file").alias("kind"),
                              F.concat(F.lit("file:///tmp/"), pid, F.lit(".html")).alias("url"))) \
        .unionByName(p.select("page_id", F.lit("ext").alias("kind"),
                              F.concat(F.lit("chrome-extension://abcdef/"), pid).alias("url"))) \
        .unionByName(p.select("page_id", F.lit("inner").alias("kind"),
                              F.concat("url", F.lit("?next=file:///x")).alias("url")))
    return U.drop_local_urls(urls)


_P567_SQL = W + """SELECT pos,
  length(url) - length(replace(url, '/', '')) AS path_depth,
  CAST(length(domain) - length(replace(domain, '.', '')) > 1 AS INTEGER) AS is_subdomain,
  CAST(date_diff('day', DATE '1970-01-01', CAST(date AS DATE)) AS INTEGER) AS days_since_epoch
FROM entries"""


@register("p5_p6_p7_url_features", _P567_SQL)
def p567_url_features(spark, sf):
    e = entries(spark, sf)
    return e.select("pos", U.path_depth(F.col("url")).alias("path_depth"),
                    U.is_subdomain(F.col("domain")).alias("is_subdomain"),
                    U.days_since_epoch(F.col("date")).alias("days_since_epoch"))


_P8_SQL = W + """, parts AS (
  SELECT pos, title, domain, string_split(lower(domain), '.') AS p FROM entries),
best AS (
  SELECT pos, title, domain,
    list_last(list_filter(p, lambda x: length(x) = list_max(list_transform(p, lambda y: length(y))))) AS part
  FROM parts)
SELECT pos, CASE WHEN coalesce(domain, '') = '' THEN regexp_replace(coalesce(title, ''), '^\\s+|\\s+$', '', 'g')
  ELSE regexp_replace(regexp_replace(title, '(?i)\\b' || regexp_escape(part) || '\\b', '', 'g'), '^\\s+|\\s+$', '', 'g')
  END AS base_title FROM best"""


@register("p8_base_title", _P8_SQL)
def p8_base_title(spark, sf):
    e = entries(spark, sf)
    return e.select("pos", U.base_title(F.col("title"), F.col("domain")).alias("base_title"))


_P9_SQL = "WITH " + DOCS_AS_ENTRIES_SQL + """, t AS (
  SELECT pos, CASE WHEN lang = 'en' THEN NULL ELSE 'c:' || scraped END AS clean_text, scraped FROM docs_as_entries)
SELECT pos, md5(coalesce(clean_text, scraped, '')) AS content_md5 FROM t"""


@register("p9_entry_content", _P9_SQL)
def p9_entry_content(spark, sf):
    d = docs_as_entries(load(spark, sf, "documents"))
    t = d.select("pos", F.when(F.col("lang") == "en", F.lit(None).cast("string"))
                 .otherwise(F.concat(F.lit("c:"), "scraped")).alias("clean_text"), "scraped")
    return t.select("pos", F.md5(T.entry_content(t)).alias("content_md5"))


_IS_HTML_SQL = "(starts_with(regexp_replace({c}, '^\\s+|\\s+$', '', 'g'), '<html') OR " \
    "starts_with(regexp_replace({c}, '^\\s+|\\s+$', '', 'g'), '<!DOCTYPE') OR " \
    "starts_with(regexp_replace({c}, '^\\s+|\\s+$', '', 'g'), '<doc'))"


@register("p12_is_html", "SELECT 'page' AS kind, page_id AS id, " + _IS_HTML_SQL.format(c="html")
          + " AS is_html FROM pages UNION ALL SELECT 'doc', doc_id, " + _IS_HTML_SQL.format(c="text")
          + " FROM documents")
def p12_is_html(spark, sf):
    p = load(spark, sf, "pages").select(F.lit("page").alias("kind"), F.col("page_id").alias("id"),
                                        T.is_html(F.col("html")).alias("is_html"))
    d = load(spark, sf, "documents").select(F.lit("doc").alias("kind"), F.col("doc_id").alias("id"),
                                            T.is_html(F.col("text")).alias("is_html"))
    return p.unionByName(d)


def _folder_paths(e):
    word = F.element_at(F.split(F.col("title"), " "), 1)
    return e.select("pos", F.when(F.col("pos") % 4 == 0, F.lit("Bookmarks Bar"))
                    .when(F.col("pos") % 4 == 1, F.concat(F.lit("Bookmarks Bar/"), F.col("folder"), F.lit(" links")))
                    .when(F.col("pos") % 4 == 2, F.concat(F.lit("Bookmarks Bar/Menu/"), word))
                    .otherwise(F.concat(F.lit("a/b/c/"), F.col("folder"), F.lit(" Sites/extra"))).alias("path"))


_W_RE2 = "(?:" + "|".join(U.IGNORED_FOLDER_WORDS) + ")s?"
_P13_SQL = W + f""", paths AS (
  SELECT pos, CASE WHEN pos % 4 = 0 THEN 'Bookmarks Bar'
    WHEN pos % 4 = 1 THEN 'Bookmarks Bar/' || folder || ' links'
    WHEN pos % 4 = 2 THEN 'Bookmarks Bar/Menu/' || string_split(title, ' ')[1]
    ELSE 'a/b/c/' || folder || ' Sites/extra' END AS path FROM entries)
SELECT pos, regexp_replace(regexp_replace(lower(regexp_replace(
    list_last(string_split(path, '/')[1:4]), '^\\s+|\\s+$', '', 'g')),
  '(?i)\\b(?:{_W_RE2}(?: {_W_RE2})?)\\b', '', 'g'), '^\\s+|\\s+$', '', 'g') AS label FROM paths"""


@register("p13_folder_label", _P13_SQL)
def p13_folder_label(spark, sf):
    paths = _folder_paths(entries(spark, sf))
    return paths.select("pos", U.folder_label(F.col("path")).alias("label"))


@register("p14_fingerprint", "SELECT doc_id, md5(text) AS fingerprint FROM documents")
def p14_fingerprint(spark, sf):
    return load(spark, sf, "documents").select("doc_id", U.fingerprint(F.col("text")).alias("fingerprint"))


def _p15_sql():
    inner = _P8_SQL.replace("parts AS (\n  SELECT pos, title, domain,", "parts AS (\n  SELECT pos, title, domain, folder,") \
        .replace("best AS (\n  SELECT pos, title, domain,", "best AS (\n  SELECT pos, title, domain, folder,") \
        .replace("END AS base_title FROM best", "END AS base_title, folder FROM best")
    head, select = inner.split("\nSELECT pos, CASE WHEN", 1)
    return (head + ", based AS (SELECT pos, CASE WHEN" + select + ")\n"
            "SELECT pos, regexp_replace(coalesce(base_title, '') || ' ' || coalesce(folder, ''), "
            "'^\\s+|\\s+$', '', 'g') AS combined FROM based")


@register("p15_title_plus_text", _p15_sql())
def p15_title_plus_text(spark, sf):
    e = entries(spark, sf)
    return e.select("pos", T.title_plus_text(U.base_title(F.col("title"), F.col("domain")),
                                              F.col("folder")).alias("combined"))


_CHALLENGE_SQL = "(" + " OR ".join(f"contains(lower(substr(html, 1, 1000)), '{p}')"
                                    for p in T.BROWSER_CHALLENGE_PHRASES) + ")"


# pages with the faults that a crawl meets: challenge texts, empty bodies, failed requests
_FAULTY_SQL = """bad AS (SELECT page_id, url, CASE WHEN page_id % 17 = 4 THEN 503 ELSE 200 END AS status,
  CASE WHEN page_id % 11 = 3 THEN '<p>Just a moment...</p>' || html WHEN page_id % 13 = 5 THEN '' WHEN page_id % 19 = 6 THEN NULL
       ELSE html END AS html FROM pages)"""


def _faulty(spark, sf):
    p, i = load(spark, sf, "pages"), F.col("page_id")
    html = (F.when(i % 11 == 3, F.concat(F.lit("<p>Just a moment...</p>"), F.col("html"))).when(i % 13 == 5, "")
            .when(i % 19 == 6, F.lit(None).cast("string")).otherwise(F.col("html")))
    return p.select("page_id", "url", F.when(i % 17 == 4, 503).otherwise(200).alias("status"), html.alias("html"))


@register("p16_drop_challenge_pages",
          f"WITH {_FAULTY_SQL} SELECT page_id, coalesce({_CHALLENGE_SQL}, false) AS is_challenge FROM bad")
def p16_drop_challenge_pages(spark, sf):
    return _faulty(spark, sf).select("page_id", T.is_challenge_page(F.col("html")).alias("is_challenge"))


_P17_SQL = """WITH pairs AS (
  SELECT a.conv_id, a.turn, a.text AS a, b.text AS b FROM conversations a
  JOIN conversations b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1),
cut AS (SELECT conv_id, turn, a, b, least(50, length(a), length(b)) AS n FROM pairs),
s AS (SELECT conv_id, turn, a, b, regexp_replace(substr(a, 1, n), '^[\x00-\x20]+|[\x00-\x20]+$', '', 'g') AS sa,
  regexp_replace(substr(b, 1, n), '^[\x00-\x20]+|[\x00-\x20]+$', '', 'g') AS sb FROM cut)
SELECT conv_id, turn,
  CASE WHEN a IS NULL OR b IS NULL OR length(a) = 0 OR length(b) = 0 THEN 0
       WHEN greatest(length(sa), length(sb)) = 0 THEN 100
       ELSE 100 - CAST(floor(levenshtein(sa, sb) / greatest(length(sa), length(sb)) * 100) AS INTEGER) END AS similarity
FROM s"""


# DuckDB's levenshtein counts UTF-8 bytes.  The oracle maps every distinct
# character of the two (<= 50-char) prefixes to its own one-byte code (at most
# 100 codes < 128), where byte and character edit distances coincide.
_ALPHA = "list_distinct(string_split(sa, '') || string_split(sb, ''))"
_ENC = "array_to_string(list_transform(string_split({s}, ''), lambda c: chr(list_position(" + _ALPHA + ", c))), '')"
_P17_SQL = _P17_SQL.replace("levenshtein(sa, sb)", "levenshtein(" + _ENC.format(s="sa") + ", " + _ENC.format(s="sb") + ")")


@register("p17_text_similarity", _P17_SQL)
def p17_text_similarity(spark, sf):
    c = load(spark, sf, "conversations")
    a = c.select("conv_id", "turn", F.col("text").alias("a"))
    b = c.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("b"))
    pairs = a.join(b, ["conv_id", "turn"])
    return pairs.select("conv_id", "turn", T.text_similarity(F.col("a"), F.col("b")).alias("similarity"))


_P18_SQL = W.rstrip() + f""", {_FAULTY_SQL},
r AS (SELECT url, CASE WHEN status >= 400 THEN 'HTTP status ' || status WHEN coalesce({_CHALLENGE_SQL}, false) THEN 'browser challenge'
  WHEN html IS NULL OR length(html) = 0 THEN 'empty page' END AS reason FROM bad)
SELECT url, reason, 'scrape' AS stage FROM r WHERE reason IS NOT NULL
UNION ALL SELECT url, 'no title', 'parse' FROM entries WHERE title = ''"""


@register("p18_rejects", _P18_SQL)
def p18_rejects(spark, sf):
    from linkloom.sources.pages import rejects
    e = entries(spark, sf)
    r1 = rejects(_faulty(spark, sf))
    r2 = e.filter(F.col("title") == "").select("url", F.lit("no title").alias("reason"), F.lit("parse").alias("stage"))
    return r1.unionByName(r2)


_S5_SQL = """SELECT page_id AS id, CASE
  WHEN contains(lower(substr(html, 1, 2048)), '<!doctype netscape-bookmark-file-1') THEN 'netscape'
  WHEN contains(lower(substr(html, 1, 2048)), '<!doctype html') AND contains(lower(substr(html, 1, 2048)), '<title>onetab') THEN 'onetab'
  ELSE 'unsupported' END AS format FROM pages"""


@register("s5_detect_format", _S5_SQL)
def s5_detect_format(spark, sf):
    p = load(spark, sf, "pages")
    return p.select(F.col("page_id").alias("id"), formats.detect_format(F.col("html")).alias("format"))


_A1_SQL = "WITH " + ENTRIES_DUP_SQL + """, g AS (
  SELECT url, arg_min(pos, pos) AS pos, list_sort(list_distinct(flatten(list(group_ids)))) AS gids
  FROM entries_dup GROUP BY url)
SELECT e.pos, e.url, e.domain, e.title, array_to_string(g.gids, ',') AS group_ids
FROM g JOIN entries_dup e ON e.url = g.url AND e.pos = g.pos"""


@register("a1_dedup_entries", _A1_SQL)
def a1_dedup_entries(spark, sf):
    d = E.dedup_entries(entries_dup(entries(spark, sf)))
    return d.select("pos", "url", "domain", "title", F.array_join("group_ids", ",").alias("group_ids"))


@register("a2_domain_sizes", W + "SELECT domain, count(*) AS n_entries FROM entries GROUP BY domain HAVING count(*) >= 3")
def a2_domain_sizes(spark, sf):
    return E.domain_sizes(entries(spark, sf))


@register("w1_sample_per_domain", W + """SELECT * FROM (SELECT domain, pos,
  row_number() OVER (PARTITION BY domain ORDER BY pos) AS sample_rank FROM entries) WHERE sample_rank <= 8""")
def w1_sample_per_domain(spark, sf):
    return E.sample_per_domain(entries(spark, sf), 8).select("domain", "pos", "sample_rank")


@register("w2_interleave_by_domain", W + """SELECT pos, domain,
  row_number() OVER (PARTITION BY domain ORDER BY pos) AS turn,
  min(pos) OVER (PARTITION BY domain) AS domain_first FROM entries""")
def w2_interleave_by_domain(spark, sf):
    return E.interleave_by_domain(entries(spark, sf)).select("pos", "domain", "turn", "domain_first")


@register("w3_crawl_schedule", W + """SELECT pos, url,
  CAST((row_number() OVER (PARTITION BY domain ORDER BY pos) - 1) * 2.0 AS DOUBLE) AS fetch_at_s FROM entries""")
def w3_crawl_schedule(spark, sf):
    return E.crawl_schedule(entries(spark, sf), 2.0).select("pos", "url", "fetch_at_s")


@register("w7_top_domains", W + """SELECT domain, count(*) AS n_entries FROM entries GROUP BY domain
  ORDER BY n_entries DESC, domain LIMIT 10""")
def w7_top_domains(spark, sf):
    return E.top_domains(entries(spark, sf), 10)
