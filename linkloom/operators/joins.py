"""Small joins of the pipeline (J1-J3, J9).  None is forced to broadcast: Spark does so
from measured sizes, and splits hot keys otherwise."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def attach_scraped(entries: DataFrame, pages: DataFrame, text_col: str = "html") -> DataFrame:
    """Entries LEFT JOIN page text on exact url; pages deduped on url first
    (lowest page_id wins) so the join never multiplies entries."""
    # the winner of a url is found on narrow rows; only its text meets the entries
    keyed = pages.select("url", "page_id", F.xxhash64(text_col).alias("_h"), F.col(text_col).alias("scraped"))
    first = keyed.groupBy("url").agg(F.min(F.struct("page_id", "_h")).alias("_w")).select("url", "_w.page_id", "_w._h")
    text = keyed.join(first, ["url", "page_id", "_h"], "left_semi").select("url", "scraped")
    # rows that repeat the winner
    return entries.join(text.dropDuplicates(["url"]), "url", "left")


def attach_cluster_label(df: DataFrame, labels: DataFrame, id_col: str = "cluster_id",
                         label_col: str = "cluster_label") -> DataFrame:
    """Label per cluster id; 'Noise' for ids < 0, 'Other' when unmatched."""
    lab = labels.select(id_col, F.col(label_col).alias("_lab"))
    out = df.join(lab, id_col, "left")
    return out.withColumn(label_col, F.when(F.col(id_col) < 0, F.lit("Noise"))
                          .otherwise(F.coalesce(F.col("_lab"), F.lit("Other")))).drop("_lab")


def inject_labels(df: DataFrame, mapping: DataFrame, id_col: str = "cluster_id", out_col: str = "label",
                  default: str = "Unclustered") -> DataFrame:
    """Id -> label, default 'Unclustered'."""
    m = mapping.select(id_col, F.col(mapping.columns[1]).alias("_lab"))
    return df.join(m, id_col, "left").withColumn(out_col, F.coalesce("_lab", F.lit(default))).drop("_lab")


def drop_labels(labels: DataFrame, drops: DataFrame, col: str = "label") -> DataFrame:
    """Remove labels named in ``drops`` (case-insensitive), a left anti join."""
    d = drops.select(F.lower(F.col(drops.columns[0])).alias("_k")).distinct()
    return labels.join(d, F.lower(F.col(col)) == F.col("_k"), "left_anti")
