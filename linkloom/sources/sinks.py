"""Sinks and stage cache (S8, S9) and the corpus fingerprint."""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, MapType, StructType


def write_clusters_csv(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """CSV with a header; arrays / maps / structs become JSON text."""
    cols = []
    for f in df.schema.fields:
        if isinstance(f.dataType, (ArrayType, MapType, StructType)):
            cols.append(F.to_json(F.col(f.name)).alias(f.name))
        else:
            cols.append(F.col(f.name))
    df.select(*cols).write.mode(mode).option("header", True).csv(path)


def read_clusters_csv(spark, path: str, schema: str) -> DataFrame:
    return spark.read.option("header", True).schema(schema).csv(path)


def corpus_fingerprint(df: DataFrame, *cols: str) -> str:
    """A16 (scalable form): count + order-insensitive sum and xor of
    xxhash64 over the given columns - partial aggregates only, no global
    ordering, no string through one task."""
    r = corpus_fingerprint_df(df, *cols).collect()[0]
    return r["fingerprint"]


def corpus_fingerprint_df(df: DataFrame, *cols: str) -> DataFrame:
    h = F.xxhash64(*[F.col(c) for c in cols])
    agg = df.agg(F.count(F.lit(1)).alias("n"), F.sum(h.cast("decimal(38,0)")).alias("s"),
                 F.bit_xor(h).alias("x"))
    return agg.select("n", F.md5(F.concat_ws(":", F.col("n").cast("string"), F.col("s").cast("string"),
                                             F.col("x").cast("string"))).alias("fingerprint"))


def ordered_fingerprint_df(df: DataFrame, order_col: str, *cols: str, settings: dict | None = None, fan: int = 64) -> DataFrame:
    """A16 (order-sensitive): (n, fingerprint) of the rows in the order of ``order_col``.

    A tree of md5 digests over fixed ranges of positions: rows are numbered over range
    partitions, every ``fan`` consecutive digests become one, level by level, so no task
    holds more than ``fan`` digests of a range and no text passes through one task.  A
    field is ``-`` for null, else its characters' number, ``:`` and its value.  Truthy
    settings enter the key.  Rows of equal order are taken in the order of their digests;
    an empty table has the digest of the empty text."""
    from linkloom.operators.ranking import rank_within_group
    from linkloom.session import written_table
    field = [F.coalesce(F.concat(F.length(F.col(c).cast("string")).cast("string"), F.lit(":"), F.col(c).cast("string")), F.lit("-"))
             for c in cols]
    leaves = written_table(df.select(F.lit(0).alias("all"), F.col(order_col).alias("o"), F.md5(F.concat(*field)).alias("d")), "order-leaves")
    level = rank_within_group(leaves, "all", ["o", "d"]).select((F.col("rn") - 1).alias("pos"), "d")
    n = left = leaves.count()
    while left > 1:
        level = written_table(level.groupBy(F.expr(f"pos div {fan}").alias("pos")).agg(
            F.md5(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "d"))), lambda x: x["d"]), "")).alias("d")), "order-level")
        left = -(-left // fan)
    root = level.agg(F.coalesce(F.max("d"), F.md5(F.lit(""))).alias("root"))
    key = F.concat_ws(":", F.lit(str(n)), "root", F.lit(settings_fingerprint(settings)))
    return root.select(F.lit(n).cast("long").alias("n"), F.md5(key).alias("fingerprint"))


def settings_fingerprint(settings: dict | None) -> str:
    """``k=v`` lines of the truthy settings (sorted), md5."""
    if not settings:
        return ""
    lines = [f"{k}={v}" for k, v in sorted(settings.items()) if v]
    return hashlib.md5("\n".join(lines).encode("utf-8")).hexdigest()


@dataclass
class StageCheckpoint:
    """Stage cache as Parquet under ``root/<stage>_<md5>``.

    ``reuse`` reads a complete earlier result (``_SUCCESS`` present); ``save``
    writes a freshly computed one; ``data_only`` keys the cache on the data
    fingerprint alone, otherwise settings are part of the key.
    """
    root: str
    reuse: bool = True
    save: bool = True
    data_only: bool = True

    def path(self, stage: str, data_fp: str, settings: dict | None = None) -> str:
        key = data_fp if self.data_only else data_fp + "\n" + settings_fingerprint(settings)
        return f"{self.root.rstrip('/')}/{stage}_{hashlib.md5(key.encode('utf-8')).hexdigest()}"

    def _exists(self, spark, path: str) -> bool:
        jvm = spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path + "/_SUCCESS")
        return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)

    def run(self, stage: str, data_fp: str, compute, spark=None, settings: dict | None = None) -> DataFrame:
        df = None
        if spark is None:
            df = compute()
            spark = df.sparkSession
        path = self.path(stage, data_fp, settings)
        if self.reuse and self._exists(spark, path):
            return spark.read.parquet(path)
        df = df if df is not None else compute()
        if not self.save:
            return df
        df.write.mode("overwrite").parquet(path)
        return spark.read.parquet(path)
