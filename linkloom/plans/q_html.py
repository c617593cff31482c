"""Queries for the HTML jobs (H1-H6) and bookmark sources.

Export files are derived from the ``entries`` view by Spark (50 entries per
file, one group per ``page_id % 7``), parsed back by the readers and compared
with what the entries say they must contain.
"""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from linkloom.functions import text as T
from linkloom.operators import html as H
from linkloom.plans.registry import register
from linkloom.sources import bookmarks as BK
from linkloom.sources.tables import ENTRIES_SQL, entries, load

PER_FILE = 50


def _esc(c, attr=False):
    c = F.replace(F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")),
                  F.lit(">"), F.lit("&gt;"))
    return F.replace(c, F.lit('"'), F.lit("&quot;")) if attr else c


def _file_name(kind):
    return F.concat(F.lit(f"{kind}_"), F.lpad((F.col("pos") / PER_FILE).cast("bigint").cast("string"), 5, "0"),
                    F.lit(".html"))


def onetab_exports(e):
    """(file, content): tab-group exports holding every entry plus one local tab each."""
    e = e.withColumn("file", _file_name("onetab")).withColumn("gid", F.col("group_ids")[0])
    tab = F.concat(F.lit('<div class="tab"><img class="favIcon" src="x.png"><a class="tabLink" href="'),
                   _esc(F.col("url"), True), F.lit('">'), _esc(F.col("title")), F.lit("</a></div>"),
                   F.lit('<div class="tab"><a class="tabLink" href="file:///tmp/'), F.col("pos").cast("string"),
                   F.lit('.html">local copy</a></div>'))
    groups = (e.groupBy("file", "gid")
              .agg(F.min("date").alias("created"), F.count(F.lit(1)).alias("n"),
                   F.array_sort(F.collect_list(F.struct("pos", tab.alias("t")))).alias("tabs"))
              .select("file", "gid", F.concat(
                  F.lit('<div class="tabGroup"><div class="tabGroupLabel"><div>'), F.col("n").cast("string"),
                  F.lit(' tabs</div><div>Created '), F.date_format("created", "M/d/yyyy, h:mm:ss a"),
                  F.lit('</div><div class="cmds">Restore all</div></div><div class="tabList">'),
                  F.array_join(F.transform("tabs", lambda x: x["t"]), "\n"), F.lit("</div></div>")).alias("g")))
    return (groups.groupBy("file").agg(F.array_sort(F.collect_list(F.struct("gid", "g"))).alias("gs"))
            .select("file", F.concat(
                F.lit('<!DOCTYPE html><html><head><title>OneTab</title></head><body><div id="tabGroupsDiv">\n'),
                F.array_join(F.transform("gs", lambda x: x["g"]), "\n"),
                F.lit("\n</div></body></html>")).alias("content")))


@register("s1_read_onetab", "WITH " + ENTRIES_SQL + """, f AS (
  SELECT *, 'onetab_' || lpad(CAST(CAST(floor(pos / 50) AS BIGINT) AS VARCHAR), 5, '0') || '.html' AS file,
         group_ids[1] AS gid FROM entries),
g AS (SELECT file, gid, min(date) AS created FROM f GROUP BY file, gid),
r AS (SELECT file, gid, dense_rank() OVER (PARTITION BY file ORDER BY gid) - 1 AS group_idx FROM g)
SELECT f.file, r.group_idx + 4294967296 * (dense_rank() OVER (ORDER BY f.file) - 1) AS group_id, f.url, f.title, f.domain, strftime(g.created, '%Y-%m-%d %H:%M:%S') AS date
FROM f JOIN g USING (file, gid) JOIN r USING (file, gid)""")
def s1_read_onetab(spark, sf):
    out = BK.parse_onetab(onetab_exports(entries(spark, sf)))
    return out.select("file", F.col("group_ids")[0].alias("group_id"), "url", "title", "domain",
                      F.date_format("date", "yyyy-MM-dd HH:mm:ss").alias("date"))


def netscape_exports(e):
    """(file, content): browser exports; entries sit in <lang>/ or <lang>/Links
    (odd pos), others at the root; every 5th link has only LAST_MODIFIED."""
    e = e.withColumn("file", _file_name("netscape"))
    secs = (F.lit(1704067200) + F.col("pos") * 3600).cast("string")
    dates = F.when(F.col("pos") % 5 == 0, F.concat(F.lit('LAST_MODIFIED="'), secs, F.lit('"'))) \
        .otherwise(F.concat(F.lit('ADD_DATE="'), secs, F.lit('"')))
    link = F.concat(F.lit('<DT><A HREF="'), _esc(F.col("url"), True), F.lit('" '), dates, F.lit(">"),
                    _esc(F.col("title")), F.lit("</A>"))
    e = e.withColumn("sub", F.when((F.col("folder") != "") & (F.col("pos") % 2 == 1), F.lit("Links"))
                     .otherwise(F.lit("")))
    leaf = (e.groupBy("file", "folder", "sub")
            .agg(F.array_sort(F.collect_list(F.struct("pos", link.alias("l")))).alias("ls"))
            .select("file", "folder", "sub", F.array_join(F.transform("ls", lambda x: x["l"]), "\n").alias("links")))
    top = (leaf.groupBy("file", "folder").agg(
        F.max(F.when(F.col("sub") == "", F.col("links"))).alias("direct"),
        F.max(F.when(F.col("sub") == "Links", F.col("links"))).alias("nested")))
    body = F.when(F.col("folder") == "", F.coalesce("direct", F.lit(""))).otherwise(F.concat(
        F.lit("<DT><H3 ADD_DATE=\"1\">"), F.col("folder"), F.lit("</H3>\n<DL><p>\n"),
        F.coalesce("direct", F.lit("")),
        F.when(F.col("nested").isNotNull(), F.concat(F.lit("\n<DT><H3>Links</H3>\n<DL><p>\n"), F.col("nested"),
                                                     F.lit("\n</DL><p>"))).otherwise(F.lit("")),
        F.lit("\n</DL><p>")))
    return (top.groupBy("file").agg(F.array_sort(F.collect_list(F.struct("folder", body.alias("b")))).alias("bs"))
            .select("file", F.concat(
                F.lit("<!DOCTYPE NETSCAPE-Bookmark-file-1>\n<META HTTP-EQUIV=\"Content-Type\" CONTENT=\"text/html\">\n"
                      "<TITLE>Bookmarks</TITLE>\n<H1>Bookmarks</H1>\n<DL><p>\n"),
                F.array_join(F.transform("bs", lambda x: x["b"]), "\n"), F.lit("\n</DL><p>")).alias("content")))


@register("s2_read_netscape", "WITH " + ENTRIES_SQL + """
SELECT 'netscape_' || lpad(CAST(CAST(floor(pos / 50) AS BIGINT) AS VARCHAR), 5, '0') || '.html' AS file,
  url, title, CASE WHEN folder = '' THEN '' WHEN pos % 2 = 1 THEN folder || '/Links' ELSE folder END AS folder,
  strftime(TIMESTAMP '1970-01-01' + to_seconds(1704067200 + pos * 3600), '%Y-%m-%d %H:%M:%S') AS date
FROM entries""")
def s2_read_netscape(spark, sf):
    out = BK.parse_netscape(netscape_exports(entries(spark, sf)))
    return out.select("file", "url", "title", "folder", F.date_format("date", "yyyy-MM-dd HH:mm:ss").alias("date"))


@register("s3_read_folder_paths", "WITH " + ENTRIES_SQL + """
SELECT DISTINCT 'netscape_' || lpad(CAST(CAST(floor(pos / 50) AS BIGINT) AS VARCHAR), 5, '0') || '.html' AS file,
  p AS path, len(string_split(p, '/')) AS depth
FROM (SELECT pos, unnest(CASE WHEN folder = '' THEN [] WHEN pos % 2 = 1 THEN [folder, folder || '/Links']
  ELSE [folder] END) AS p FROM entries)""")
def s3_read_folder_paths(spark, sf):
    return BK.parse_folder_paths(netscape_exports(entries(spark, sf))).select("file", "path", "depth").distinct()


@register("s4_entries_json_roundtrip", "WITH " + ENTRIES_SQL + """
SELECT pos, url, title, strftime(date, '%Y-%m-%d %H:%M:%S') AS date, array_to_string(group_ids, ',') AS group_ids
FROM entries""")
def s4_entries_json_roundtrip(spark, sf):
    from linkloom.session import scratch_path
    path = scratch_path(spark, f"entries-json-{uuid.uuid4().hex}")
    BK.write_entries_json(entries(spark, sf), path)
    back = BK.read_entries_json(spark, path)
    return back.select("pos", "url", "title", F.date_format("date", "yyyy-MM-dd HH:mm:ss").alias("date"),
                       F.array_join("group_ids", ",").alias("group_ids"))


@register("h1_visible_text")
def h1_visible_text(spark, sf):
    return H.visible_text(load(spark, sf, "pages"), None)


@register("h1_visible_text_limited")
def h1_visible_text_limited(spark, sf):
    return H.visible_text(load(spark, sf, "pages"), 1000)


@register("h2_main_content")
def h2_main_content(spark, sf):
    return H.main_content(load(spark, sf, "pages"), None)


@register("h2_main_content_limited")
def h2_main_content_limited(spark, sf):
    return H.main_content(load(spark, sf, "pages"), 400)


_H3_SQL = r"""SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(text,
  '(import\s+[\p{L}\p{N}_]+)', '\1 ', 'g'), '([;{}()])', '\1 ', 'g'),
  '(?i)([\p{L}\p{N}_])(if|for|while|def|class|return|import|from)', '\1 \2', 'g'), '\s{2,}', ' ', 'g') AS spaced
FROM documents"""


@register("h3_space_code", _H3_SQL)
def h3_space_code(spark, sf):
    return load(spark, sf, "documents").select("doc_id", T.space_code(F.col("text")).alias("spaced"))


@register("h4_page_summary")
def h4_page_summary(spark, sf):
    return H.page_summary(load(spark, sf, "pages"))


@register("h5_drop_near_duplicate_lines")
def h5_drop_near_duplicate_lines(spark, sf):
    d = load(spark, sf, "documents")
    return d.select("doc_id", H.drop_near_duplicate_lines(F.col("text"), 85).alias("deduped"))


# strip_accents + dropping what is left outside ASCII equals NFKD folding for
# accented Latin letters (the test corpus); compatibility forms such as
# ligatures or full-width letters would differ.  tests/test_scalars.py checks
# the query against ``unicodedata`` itself.
@register("h6_to_ascii", "SELECT doc_id, regexp_replace(strip_accents(text), '[^\\x00-\\x7F]', '', 'g') AS ascii_text "
                         "FROM documents")
def h6_to_ascii(spark, sf):
    d = load(spark, sf, "documents")
    return d.select("doc_id", T.to_ascii(F.col("text")).alias("ascii_text"))


@register("s6_read_pages", "SELECT page_id, url, 'html' AS kind, length(html) AS n_chars FROM pages")
def s6_read_pages(spark, sf):
    from linkloom.sources.pages import read_pages
    return read_pages(spark, f"{sf.rstrip('/')}/pages.parquet").select("page_id", "url", "kind",
                                                                        F.length("html").alias("n_chars"))
