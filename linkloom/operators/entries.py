"""Entry-level operators: dedup (A1), domain sizes (A2), per-domain sampling
(W1), round-robin interleave (W2), crawl schedule (W3), top domains (W7)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkloom.operators.ranking import first_per_group, rank_within_group


def dedup_entries(df: DataFrame, max_length: int = 200, order_by_first_seen: bool = False) -> DataFrame:
    """A1: one row per URL - the first occurrence (smallest ``pos``) with the
    union of all group ids.  URLs longer than ``max_length`` are kept as is.

    One scan and one shuffle: the grouping key is (url, pos) for long URLs
    (every row its own group) and (url, null) otherwise.  ``min_by`` and
    ``collect_set`` are combined map-side, so a URL repeated millions of
    times ships one partial row per task, and the set holds distinct group
    ids only.
    """
    cols = [c for c in df.columns if c not in ("url", "group_ids")]
    keep_key = F.when(F.length("url") > max_length, F.col("pos"))
    merged = (df.select("url", keep_key.alias("_long"), "pos", F.struct(*cols).alias("_first"),
                        F.explode_outer("group_ids").alias("_gid"))
              .groupBy("url", "_long")
              .agg(F.min_by("_first", "pos").alias("_first"), F.collect_set("_gid").alias("group_ids"))
              .select("url", "_first.*", F.array_sort("group_ids").alias("group_ids")))
    out = merged.select(*df.columns)
    if order_by_first_seen:
        first = out.groupBy("domain").agg(F.min("pos").alias("_domain_first"))
        out = out.join(first, "domain").orderBy("_domain_first", "pos").drop("_domain_first").select(*df.columns)
    return out


def domain_sizes(df: DataFrame, min_size: int = 3) -> DataFrame:
    """A2: entries per domain, domains with at least ``min_size`` entries."""
    return df.groupBy("domain").agg(F.count(F.lit(1)).alias("n_entries")).filter(F.col("n_entries") >= min_size)


def top_domains(df: DataFrame, n: int) -> DataFrame:
    """The ``n`` largest domains (TakeOrderedAndProject, no global sort)."""
    return (df.groupBy("domain").agg(F.count(F.lit(1)).alias("n_entries"))
            .orderBy(F.desc("n_entries"), F.asc("domain")).limit(n))


def sample_per_domain(df: DataFrame, n: int = 8) -> DataFrame:
    """First ``n`` entries of each domain in input order."""
    return first_per_group(df, "domain", "pos", n, out_col="sample_rank")


def interleave_by_domain(df: DataFrame) -> DataFrame:
    """Round-robin order over domains taken in first-seen order.

    Adds ``turn`` (1-based position within the domain, skew-safe rank) and
    ``domain_first``; the interleaved order is ``orderBy("turn",
    "domain_first")`` - a range-partitioned sort, never a single-task
    global row number.
    """
    ranked = rank_within_group(df, "domain", ["pos"], out_col="turn")
    first = df.groupBy("domain").agg(F.min("pos").alias("domain_first"))
    return ranked.join(first, "domain")


def crawl_schedule(df: DataFrame, delay: float = 2.0) -> DataFrame:
    """Earliest fetch offset (seconds) so one domain is never hit twice
    within ``delay`` seconds: the k-th URL of a domain waits (k-1)*delay."""
    ranked = rank_within_group(df, "domain", ["pos"], out_col="turn")
    return ranked.withColumn("fetch_at_s", ((F.col("turn") - 1) * F.lit(float(delay))).cast("double"))
