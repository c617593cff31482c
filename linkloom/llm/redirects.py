"""URL filters with redirect equivalence (DataFrame functions only).

Rules are (action, host, path).  A rule fits its host and all subdomains when
the path of the url starts with the rule's path; the longest fitting rule
decides, allow before block at equal length.  A url that no rule decides takes
the verdict of its alias class: urls joined by redirects (meta refresh, or a
given redirect table) and canonical links form connected components, an allowed
member makes the class allowed, else a blocked member makes it blocked.

Defined results: a null url, or one without ``://``, has empty host and path and
no rule; null html or a null link gives no edge; a null page_id is kept; repeated
rows give repeated results; extra columns are ignored; empty tables give no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linkloom.llm.common import ascii_lower, connected_components

_URL = r"(?s)^.*?://([^/?#]*)([^?#]*)"
_CANONICAL = (r"""(?is)<link\b(?=[^>]*\brel\s*=\s*["']?canonical\b)[^>]*?\bhref\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>"']+))""")
_REFRESH = (r"""(?is)<meta\b(?=[^>]*\bhttp-equiv\s*=\s*["']?refresh\b)[^>]*?\bcontent\s*=\s*["']?[^"'>]*?url\s*=\s*([^"'\s>]+)""")


def url_host(c):
    return ascii_lower(F.coalesce(F.regexp_extract(c, _URL, 1), F.lit("")))


def url_path(c):
    return F.coalesce(F.regexp_extract(c, _URL, 2), F.lit(""))


def url_node(c):
    """Key of a resource: the url without its fragment, scheme and host in lower case."""
    bare = F.regexp_replace(F.trim(c), r"(?s)#.*$", "")
    return F.concat(ascii_lower(F.regexp_extract(bare, r"(?s)^(.*?://[^/?]*)", 1)),
                    F.regexp_replace(bare, r"(?s)^.*?://[^/?]*", ""))


def resolve(base, link):
    """Absolute form of ``link`` found on the page ``base``."""
    root = F.regexp_extract(base, r"(?s)^(.*?://[^/?#]*)", 1)
    folder = F.regexp_extract(base, r"(?s)^(.*?://[^/?#]*(?:/[^?#]*/|/)?)", 1)
    folder = F.when(folder.endswith("/"), folder).otherwise(F.concat(folder, F.lit("/")))
    return (F.when(link.rlike(r"^[A-Za-z][A-Za-z0-9+.\-]*://"), link)
            .when(link.startswith("//"), F.concat(F.regexp_extract(base, r"(?s)^(.*?:)//", 1), link))
            .when(link.startswith("/"), F.concat(root, link))
            .when(link.rlike(r"^[?#]|^[A-Za-z][A-Za-z0-9+.\-]*:"), F.lit(None).cast("string"))
            .when(F.length(link) > 0, F.concat(folder, link)))


def rule_table(spark: SparkSession, rules) -> DataFrame:
    """(action, host, path) rows of a list, as a plan-local relation of known size."""
    q = lambda s: "'" + s.replace("\\", "\\\\").replace("'", "\\'") + "'"
    if not rules:
        return spark.sql("SELECT '' AS action, '' AS host, '' AS path WHERE false")
    rows = ", ".join(f"({q(a)}, {q(h)}, {q(p)})" for a, h, p in rules)
    return spark.sql(f"SELECT * FROM VALUES {rows} AS t(action, host, path)")


def with_rule(urls: DataFrame, rules: DataFrame, url: str = "url") -> DataFrame:
    """Adds host, path, rule and rule_action to ``urls``.

    The rules of a host are looked up once a distinct host (few rows next to the
    urls), on every suffix of the host; the join back has one row a host, so a
    host with a third of the urls is a skewed join that AQE splits."""
    x = urls.withColumn("host", url_host(F.col(url))).withColumn("path", url_path(F.col(url)))
    hosts = x.select("host").distinct()
    labels = F.split("host", r"\.")
    suffixes = F.expr("transform(sequence(1, size(labels)), i -> array_join(slice(labels, i, size(labels)), '.'))")
    long = hosts.withColumn("labels", labels).select("host", F.explode(suffixes).alias("rule_host"))
    clean = rules.select("action", F.col("host").alias("rule_host"), F.col("path").alias("rule_path")).where(
        "action is not null and rule_host is not null and rule_path is not null").distinct()
    fits = (long.join(clean, "rule_host").select(
        "host", F.struct((-F.length(F.concat("rule_host", "rule_path"))).alias("o"), "action",
                         F.concat("rule_host", "rule_path").alias("rule"), "rule_path").alias("r"))
        .groupBy("host").agg(F.sort_array(F.collect_set("r")).alias("_rules")))
    first = F.expr("get(filter(_rules, r -> startswith(path, r.rule_path)), 0)")
    return (x.join(fits, "host", "left").withColumn("_hit", first)
            .withColumn("rule", F.col("_hit.rule")).withColumn("rule_action", F.col("_hit.action"))
            .drop("_hit", "_rules"))


def page_edges(pages: DataFrame) -> DataFrame:
    """(src, dst) nodes of the canonical and refresh links of ``pages``."""
    canonical = F.concat(*[F.regexp_extract("html", _CANONICAL, g) for g in (1, 2, 3)])
    refresh = F.regexp_extract("html", _REFRESH, 1)
    return (pages.select("url", F.explode(F.array(canonical, refresh)).alias("link"))
            .select(url_node(F.col("url")).alias("src"),
                    url_node(resolve(F.col("url"), F.trim("link"))).alias("dst"))
            .where("length(src) > 0 and length(dst) > 0"))


def judge_urls(pages: DataFrame, rules: DataFrame, redirects: DataFrame | None = None,
               default: str = "allow") -> DataFrame:
    """page_id, url, host, path, rule, rule_action, alias_class, verdict of every page row.

    pages: (page_id, url, html); rules: (action, host, path); redirects: optional
    (src, dst) urls, for instance from a crawl log."""
    pages = pages.select("page_id", "url", "html")
    edges = page_edges(pages)
    if redirects is not None:
        edges = edges.union(redirects.select(url_node(F.col("src")), url_node(F.col("dst")))
                            .where("length(src) > 0 and length(dst) > 0"))
    classes = connected_components(edges)
    voted = (with_rule(classes.withColumnRenamed("node", "url"), rules)
             .groupBy("component").agg(F.max(F.col("rule_action") == "allow").alias("allowed"),
                                       F.max(F.col("rule_action") == "block").alias("blocked")))
    # one row a node: its class and the class' verdict
    alias = classes.join(voted, "component").select(
        F.col("node").alias("_node"), F.col("component").alias("alias_class"),
        F.when(F.col("allowed"), "allow").when(F.col("blocked"), "block").alias("class_verdict"))
    judged = with_rule(pages.select("page_id", "url"), rules).withColumn("_node", url_node(F.col("url")))
    return judged.join(alias, "_node", "left").select(
        "page_id", "url", "host", "path", "rule", "rule_action", "alias_class",
        F.coalesce("rule_action", "class_verdict", F.lit(default)).alias("verdict"))
