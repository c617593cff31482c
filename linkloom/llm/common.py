"""Helpers shared by the training-data operators: table access, shared-folder
stage tables, and connected components by alternating stars."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linkloom.session import scratch_path

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def ascii_lower(c):
    """Lower-case A-Z only; every other character stays."""
    return F.translate(c, UPPER, LOWER)


def stage(df: DataFrame, name: str, partition_by: list[str] | None = None) -> DataFrame:
    """Write ``df`` to the shared folder of ``spark.checkpoint.dir`` and read it
    back: cuts lineage, survives lost executors, and is read as often as needed
    without computing it again."""
    spark = df.sparkSession
    path = scratch_path(spark, f"{name}-{uuid.uuid4().hex}")
    writer = df.write.mode("error")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def give_back() -> None:
    """Hand freed memory back to the system at the end of a task: the worker lives on."""
    import ctypes

    import pyarrow as pa
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc only
    if trim:
        trim(0)


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst", max_rounds: int = 60) -> DataFrame:
    """(node, component): the smallest node of each connected component, for
    every node of an undirected edge list.

    Alternating large-star / small-star contraction: each round links every
    node's neighbours to the smallest node it sees, O(log^2 n) rounds.  The
    minimum is a map-side combined aggregate and the join back has one row a
    node on its small side, so AQE splits a hub that holds a third of all
    edges.  Each round's edges are a written table.  Raises when the rounds run
    out instead of returning labels that have not settled.

    Null endpoints are ignored; self loops give a component of their own;
    repeated edges count once; no edges give no rows.
    """
    pairs = edges.select(F.col(src).alias("u"), F.col(dst).alias("v")).where("u is not null and v is not null")
    loops = pairs.select(F.col("u").alias("node")).union(pairs.select(F.col("v").alias("node")))
    cur = stage(pairs.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(),
                "cc")
    nodes = loops.distinct()
    seen = None
    for _ in range(max_rounds):
        sign = cur.select(F.count(F.lit(1)), F.coalesce(F.bit_xor(F.xxhash64("u", "v")), F.lit(0))).first()
        if (sign[0], sign[1]) == seen or sign[0] == 0:
            break
        seen = (sign[0], sign[1])
        both = cur.union(cur.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min(F.least("u", "v")).alias("m"))
        large = (both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
                 .where("u <> v"))
        # small star: every edge points from the larger to the smaller node
        low2 = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (large.join(low2, "u").select(F.explode(F.array(F.col("u"), F.col("v"))).alias("u"),
                                              F.col("m").alias("v")).where("u <> v").distinct())
        cur = stage(small, "cc")
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return nodes.join(cur.select(F.col("u").alias("node"), F.col("v").alias("component")), "node", "left").select(
        "node", F.coalesce("component", "node").alias("component"))
