"""Skew-safe ranking inside groups.

``row_number() over (partition by g order by o)`` sends a whole group to one
task: with one domain holding a third of all rows that task sorts a third of
the data.  ``rank_within_group`` instead range-partitions on ``(g, o)`` (the
sampled bounds split a hot group over many tasks), numbers rows locally and
adds, per (partition, group), the count of the group's rows in earlier
partitions.  The range-partitioned rows are a written table: bounds are sampled
once, and counts and ranks read the same partitions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from linkloom.session import written_table


def rank_within_group(df: DataFrame, group_col: str, order_cols: list[str], out_col: str = "rn",
                      num_partitions: int | None = None) -> DataFrame:
    spark = df.sparkSession
    n = num_partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    keys = [group_col, *order_cols]
    local = written_table(df.repartitionByRange(n, *keys)
                          .sortWithinPartitions(*keys)
                          .withColumn("_pid", F.spark_partition_id())
                          .withColumn("_mid", F.monotonically_increasing_id()), "ranked")
    # one row per (partition, group): tiny next to the data, bounded by partitions + groups
    runs = local.groupBy("_pid", group_col).agg(F.min("_mid").alias("_first"), F.count(F.lit(1)).alias("_n"))
    w = Window.partitionBy(group_col).orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.withColumn("_offset", F.coalesce(F.sum("_n").over(w), F.lit(0))).select(
        F.col("_pid").alias("_p"), F.col(group_col).alias("_g"), "_first", "_offset")
    return (local.join(runs, (F.col("_pid") == F.col("_p")) & F.col(group_col).eqNullSafe(F.col("_g")))
            .withColumn(out_col, (F.col("_mid") - F.col("_first") + F.col("_offset") + 1).cast("bigint"))
            .drop("_pid", "_mid", "_first", "_offset", "_p", "_g"))


def first_per_group(df: DataFrame, group_col: str, order_col: str, n: int, out_col: str = "rn") -> DataFrame:
    """Top ``n`` rows of each group by ``order_col``.

    ``row_number() <= n`` is planned as ``WindowGroupLimit``: every map task
    keeps at most ``n`` rows per group before the shuffle, so a hot group
    ships only ``n`` rows per task.
    """
    w = Window.partitionBy(group_col).orderBy(order_col)
    return df.withColumn(out_col, F.row_number().over(w)).filter(F.col(out_col) <= n)
