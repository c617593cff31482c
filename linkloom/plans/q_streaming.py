"""Streaming queries: the table is written as range-ordered files (one write
per range, so file order = key order), streamed with availableNow and one
file per trigger, and the sink is read back.  Stream results must equal the
batch operators, so the batch SQL is the oracle."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkloom.plans.registry import register
from linkloom.session import scratch_path
from linkloom.sources.tables import docs_as_entries, entries, entries_dup, load

N_FILES = 4
ROWS_A_FILE = 200_000


def split_files(df: DataFrame, key: str, path: str, n: int = N_FILES):
    """Test-input builder: write ``df`` as key ranges, one job and one file per
    range, so that arrival order of files equals key order, as a stream of
    exports would arrive.  There are at least ``n`` ranges and enough to bound
    the rows of a file."""
    n = max(n, -(-df.count() // ROWS_A_FILE))
    qs = sorted(set(df.approxQuantile(key, [i / n for i in range(1, n)], 0.1 / n)))
    bounds = [None] + qs + [None]
    for lo, hi in zip(bounds, bounds[1:]):
        part = df
        if lo is not None:
            part = part.filter(F.col(key) > lo)
        if hi is not None:
            part = part.filter(F.col(key) <= hi)
        part.repartition(1).sortWithinPartitions(key).write.mode("append").parquet(path)
    return df.schema


def ranged_files(df: DataFrame, key: str, path: str, n: int = N_FILES):
    """``split_files`` for streams whose result does not depend on the order in which files
    arrive: the same ranges and bounds, all files written by one job side by side."""
    df = df.where(F.col(key).isNotNull())
    n = max(n, -(-df.count() // ROWS_A_FILE))
    df.repartitionByRange(n, key).sortWithinPartitions(key).write.parquet(path)
    return df.schema


def _stream(spark, df, key, split=split_files):
    base = scratch_path(spark, f"stream-{uuid.uuid4().hex}")
    schema = split(df, key, base + "/src")
    s = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(base + "/src")
    return s, base


def _r1_sql():
    from linkloom.plans.q_boilerplate import fit_sql
    return "WITH " + fit_sql(samples=8) + " SELECT domain, phrase, kind, n FROM boilerplate"


@register("r1_stream_boilerplate", _r1_sql())
def r1_stream_boilerplate(spark, sf):
    from linkloom.plans.q_boilerplate import FREQ
    from linkloom.streaming.operators import stream_boilerplate
    d = docs_as_entries(load(spark, sf, "documents")).select("domain", "pos", "scraped")
    s, base = _stream(spark, d, "pos")
    q = stream_boilerplate(s, base + "/out", base + "/ck", freq=FREQ)
    q.awaitTermination()
    return spark.read.schema("domain string, phrase string, kind string, n long").parquet(base + "/out")


def _r2_sql():
    from linkloom.plans.q_keywords import TFIDF_SQL
    return TFIDF_SQL + " SELECT id AS doc_id, gram AS keyword, round(score, 4) AS score, rank FROM top"


@register("r2_stream_keywords", _r2_sql())
def r2_stream_keywords(spark, sf):
    from linkloom.operators import keywords as K
    from linkloom.streaming.operators import stream_keywords
    d = load(spark, sf, "documents").select(F.col("doc_id").alias("pos"), "text")
    # the statistics are those of the streamed entries: a term that is not among them is in one
    dfreq, n = K.document_frequencies(d, "pos", "text")
    s, base = _stream(spark, d, "pos", ranged_files)
    q = stream_keywords(s, dfreq, n, base + "/out", base + "/ck", least=1)
    q.awaitTermination()
    out = spark.read.schema("pos long, keyword string, score double, rank int").parquet(base + "/out")
    return out.select(F.col("pos").alias("doc_id"), "keyword", F.round("score", 4).alias("score"), "rank")


def _r3_sql():
    from linkloom.plans.q_cluster import CENTROIDS_SQL
    return "WITH " + CENTROIDS_SQL + " SELECT vec_id, first(label ORDER BY d, label) AS cluster_id FROM dist GROUP BY vec_id"


@register("r3_stream_assign", _r3_sql())
def r3_stream_assign(spark, sf):
    from linkloom.operators import cluster as CL
    from linkloom.streaming.operators import stream_assign
    e = load(spark, sf, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("v"), "label")
    cents = CL.label_centroids(e, "v", "label")
    s, base = _stream(spark, e, "vec_id")
    q = stream_assign(s, cents, "v", "label", "centroid").select("vec_id", "cluster_id").writeStream \
        .format("parquet").option("path", base + "/out").option("checkpointLocation", base + "/ck") \
        .trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema("vec_id long, cluster_id int").parquet(base + "/out")


def _r4_sql():
    from linkloom.sources.tables import ENTRIES_DUP_SQL
    return "WITH " + ENTRIES_DUP_SQL + " SELECT url, min(pos) AS pos FROM entries_dup GROUP BY url"


@register("r4_stream_dedup", _r4_sql())
def r4_stream_dedup(spark, sf):
    from linkloom.streaming.operators import stream_dedup
    e = entries_dup(entries(spark, sf)).select("pos", "url", "date")
    s, base = _stream(spark, e, "pos")
    q = stream_dedup(s, "date", "7 days").writeStream.format("parquet").option("path", base + "/out") \
        .option("checkpointLocation", base + "/ck").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema("pos long, url string, date timestamp_ntz").parquet(base + "/out").select("url", "pos")


def _r1f_sql():
    from linkloom.plans.q_boilerplate import fit_sql
    from linkloom.sources.tables import ENTRIES_SQL
    cte = ENTRIES_SQL + ", ent AS (SELECT e.domain, e.pos, p.html AS scraped FROM entries e JOIN pages p ON p.page_id = e.pos)"
    return "WITH " + fit_sql(0.75, "ent", "scraped", cte, samples=8) + " SELECT domain, phrase, kind, n FROM boilerplate"


@register("r1_stream_boilerplate_finalized", _r1f_sql())
def r1_stream_boilerplate_finalized(spark, sf):
    """Page stream (availableNow) + end-of-input flush of the leftover state:
    equals the batch fit for every domain, small ones included."""
    from linkloom.streaming.operators import finalize_boilerplate, stream_boilerplate
    pages = load(spark, sf, "pages").select(F.col("page_id").alias("pos"), "html")
    e = entries(spark, sf).join(pages, "pos").select("domain", "pos", F.col("html").alias("scraped"))
    s, base = _stream(spark, e, "pos")
    q = stream_boilerplate(s, base + "/out", base + "/ck")
    q.awaitTermination()
    finalize_boilerplate(spark, base + "/ck", base + "/out")
    return spark.read.schema("domain string, phrase string, kind string, n long").parquet(base + "/out")
