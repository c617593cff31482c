"""Candidate label sets."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def seed_labels(folder_labels: DataFrame, extra: list[str] | None = None) -> DataFrame:
    """Distinct union of user seeds and folder labels (P13), empty dropped."""
    spark = folder_labels.sparkSession
    out = folder_labels.select(F.col(folder_labels.columns[0]).alias("label"))
    if extra:
        out = out.unionByName(spark.createDataFrame([(x,) for x in extra], "label string"))
    return out.filter(F.col("label").isNotNull() & (F.col("label") != "")).distinct()
