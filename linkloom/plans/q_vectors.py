"""Queries for projection, hybrid embedding and numeric features."""

from __future__ import annotations

from pyspark.sql import functions as F

from linkloom.operators import vectors as V
from linkloom.plans.registry import register
from linkloom.sources.tables import ENTRIES_SQL, entries, load


@register("m2_random_project")
def m2_random_project(spark, sf):
    e = load(spark, sf, "embeddings")
    p = V.random_project(e.withColumn("v", F.col("embedding").cast("array<double>")), "v", 64, 21, seed=42, out_col="p")
    return p.select("vec_id", F.size("p").alias("dim"),
                    F.round(F.sqrt(F.aggregate("p", F.lit(0.0), lambda a, x: a + x * x)), 4).alias("norm"))


@register("m3_hybrid_embedding")
def m3_hybrid_embedding(spark, sf):
    e = entries(spark, sf).withColumn("contents", F.col("title")).withColumn("keywords_text", F.col("folder"))
    h = V.hybrid_embedding(e, "pos", 384, 42)
    return h.select("pos", F.size("embedding").alias("dim"))


_M4_SQL = "WITH " + ENTRIES_SQL + """, f AS (SELECT pos,
  length(url) - length(replace(url, '/', '')) AS path_depth,
  CAST(length(domain) - length(replace(domain, '.', '')) > 1 AS INTEGER) AS is_subdomain,
  date_diff('day', DATE '1970-01-01', CAST(date AS DATE)) AS days_since_epoch FROM entries),
st AS (SELECT avg(path_depth) AS mp, stddev_pop(path_depth) AS sp, avg(days_since_epoch) AS md,
  stddev_pop(days_since_epoch) AS sd FROM f)
SELECT pos, round(CASE WHEN sp > 0 THEN (path_depth - mp) / sp ELSE path_depth - mp END, 4) AS path_depth_z,
  round(CASE WHEN sd > 0 THEN (days_since_epoch - md) / sd ELSE days_since_epoch - md END, 4) AS days_z,
  CAST(is_subdomain AS DOUBLE) AS is_subdomain FROM f CROSS JOIN st"""


@register("m4_combine_numeric", _M4_SQL)
def m4_combine_numeric(spark, sf):
    e = V.with_features(entries(spark, sf)).withColumn("embedding", F.array().cast("array<double>"))
    c = V.combine_numeric(e, "embedding", "features")
    return c.select("pos", F.round(F.col("features")[0], 4).alias("path_depth_z"),
                    F.round(F.col("features")[1], 4).alias("days_z"), F.col("features")[2].alias("is_subdomain"))


@register("p19_with_features", "WITH " + ENTRIES_SQL + """ SELECT pos,
  length(url) - length(replace(url, '/', '')) AS path_depth,
  CAST(length(domain) - length(replace(domain, '.', '')) > 1 AS INTEGER) AS is_subdomain FROM entries""")
def p19_with_features(spark, sf):
    return V.with_features(entries(spark, sf), ("path", "subdomain")).select("pos", "path_depth", "is_subdomain")


@register("m5_build_features")
def m5_build_features(spark, sf):
    from linkloom.sources.tables import docs_as_entries
    d = docs_as_entries(load(spark, sf, "documents")).withColumn(
        "date", F.expr("timestampadd(DAY, pos, TIMESTAMP_NTZ'2024-01-01 00:00:00')"))
    f = V.build_features(d, dim=384)
    return f.select("pos", F.size("features").alias("dim"),
                    F.round(F.sqrt(F.aggregate("features", F.lit(0.0), lambda a, x: a + x * x)), 4).alias("norm"))
