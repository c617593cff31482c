"""Crawl-dump source standing in for live fetching, and P18 rejects."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linkloom.functions.text import is_challenge_page


def read_pages(spark, path: str, fmt: str = "parquet") -> DataFrame:
    """Pages as ``(page_id, url, html[, status, content_type])``.

    Optional ``status`` / ``content_type`` columns reproduce the fetcher's
    rules: status >= 400 -> empty text; ``text/plain`` -> raw text (kind
    'text'); XML or HTML by content type; everything else HTML.
    """
    df = spark.read.format(fmt).load(path)
    return with_fetch_rules(df)


def with_fetch_rules(df: DataFrame) -> DataFrame:
    status = F.col("status") if "status" in df.columns else F.lit(200)
    ctype = F.lower(F.col("content_type")) if "content_type" in df.columns else F.lit("text/html")
    kind = (F.when(status >= 400, F.lit("failed"))
            .when(ctype.contains("text/plain"), F.lit("text"))
            .when(ctype.contains("xml"), F.lit("xml"))
            .otherwise(F.lit("html")))
    html = F.when(status >= 400, F.lit("")).otherwise(F.col("html"))
    return df.withColumn("html", html).withColumn("kind", kind)


def rejects(pages: DataFrame, stage: str = "scrape", at: Column | None = None) -> DataFrame:
    """One (url, reason, stage[, rejected_at]) row per page that yields no
    usable text: HTTP status of 400 and more, challenge, or empty.  ``at`` stamps
    the rows (for instance ``F.current_timestamp()``)."""
    status = F.col("status") if "status" in pages.columns else F.lit(200)
    reason = (F.when(status >= 400, F.concat(F.lit("HTTP status "), status.cast("string")))
              .when(is_challenge_page(F.col("html")), F.lit("browser challenge"))
              .when(F.col("html").isNull() | (F.length("html") == 0), F.lit("empty page")))
    out = pages.select("url", reason.alias("reason"), F.lit(stage).alias("stage"), *([] if at is None else [at.alias("rejected_at")]))
    return out.filter(F.col("reason").isNotNull())


def split_challenge_pages(pages: DataFrame):
    """(good pages, rejects) - challenge pages get empty text."""
    flag = is_challenge_page(F.col("html"))
    good = pages.withColumn("html", F.when(flag, F.lit("")).otherwise(F.col("html")))
    return good, rejects(pages)
