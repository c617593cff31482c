"""Parquet test tables and the derived ``entries`` views built from them.

The same derivations exist as DuckDB CTEs (``*_SQL``) so every oracle query
starts from identical rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linkloom.functions.urls import url_domain

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations")

DEFAULT_SF_DIR = "/root/testdata/sf0.01"


ID_COLUMNS = {"documents": "doc_id", "pages": "page_id", "embeddings": "vec_id", "conversations": "conv_id",
              "labels": "doc_id", "benchmark": "item_id", "events": "event_id"}


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Read one table.  A scan that yields fewer splits than the cluster has
    cores (a small file with a single row group) is hash-partitioned on the
    table id so the CPU-heavy text work after it runs in parallel; on a
    large input with thousands of splits this is a no-op."""
    df = spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")
    return balance(df, ID_COLUMNS.get(name))


def balance(df: DataFrame, key: str | None = None) -> DataFrame:
    target = df.sparkSession.sparkContext.defaultParallelism
    if target > 1 and df.rdd.getNumPartitions() < target:
        return df.repartition(target, key) if key else df.repartition(target)
    return df


_TITLE_RE = r"(?s)<title[^>]*>(.*?)</title>"
_FOLDER_RE = r"^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*/([a-z]{2})(?:[/?#]|$)"


def strip_ws(c):
    """Python ``str.strip()``: remove leading/trailing whitespace of any kind."""
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def entries_from_pages(pages: DataFrame) -> DataFrame:
    """``entries`` view: one bookmark per crawled page (see FIXTURES.md §3)."""
    return pages.select(
        F.col("page_id").alias("pos"),
        "url",
        strip_ws(F.regexp_extract("html", _TITLE_RE, 1)).alias("title"),
        url_domain(F.col("url")).alias("domain"),
        F.expr("timestampadd(HOUR, page_id, TIMESTAMP_NTZ'2024-01-01 00:00:00')").alias("date"),
        F.array((F.col("page_id") % 7)).alias("group_ids"),
        F.regexp_extract("url", _FOLDER_RE, 1).alias("folder"),
    )


def entries_dup(entries: DataFrame) -> DataFrame:
    """Every entry twice (pos 2p and 2p + 1): the copy comes later, from another group.
    Built with one scan (explode of [original, copy]) rather than a union."""
    x = entries.select("*", F.explode(F.array(F.lit(0), F.lit(1))).alias("_copy"))
    copy = F.col("_copy") == 1
    return x.select(
        (F.col("pos") * 2 + F.col("_copy")).alias("pos"), "url", "title", "domain", "date",
        F.when(copy, F.array(F.lit(100) + (F.col("pos") % 7))).otherwise(F.col("group_ids")).alias("group_ids"),
        "folder")


def docs_as_entries(documents: DataFrame) -> DataFrame:
    return documents.select(
        F.col("doc_id").alias("pos"),
        F.concat(F.lit("doc://"), F.col("source"), F.lit("/"), F.col("doc_id").cast("string")).alias("url"),
        F.lit("").alias("title"),
        F.col("source").alias("domain"),
        F.col("text").alias("scraped"),
        "lang",
    )


def entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return entries_from_pages(load(spark, sf_dir, "pages"))


# --- DuckDB equivalents (RE2 dialect) -------------------------------------
DOMAIN_SQL = r"regexp_extract({c}, '^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?//([^/?#]*)', 1)"
STRIP_SQL = r"regexp_replace({c}, '^\s+|\s+$', '', 'g')"

ENTRIES_SQL = (
    "entries AS (SELECT page_id AS pos, url, "
    + STRIP_SQL.format(c=f"regexp_extract(html, '{_TITLE_RE}', 1)") + " AS title, "
    + DOMAIN_SQL.format(c="url") + " AS domain, "
    "CAST(TIMESTAMP '2024-01-01 00:00:00' + to_hours(page_id) AS TIMESTAMP) AS date, "
    "[page_id % 7] AS group_ids, "
    f"regexp_extract(url, '{_FOLDER_RE}', 1) AS folder FROM pages)"
)
ENTRIES_DUP_SQL = (
    ENTRIES_SQL + ", entries_dup AS (SELECT * REPLACE (2 * pos AS pos) FROM entries UNION ALL "
    "SELECT 2 * pos + 1 AS pos, url, title, domain, date, [100 + pos % 7] AS group_ids, folder FROM entries)"
)
DOCS_AS_ENTRIES_SQL = (
    "docs_as_entries AS (SELECT doc_id AS pos, 'doc://' || source || '/' || CAST(doc_id AS VARCHAR) AS url, "
    "'' AS title, source AS domain, text AS scraped, lang FROM documents)"
)
