"""Streams over files (availableNow, one file per trigger) equal batch."""

from pyspark.sql import functions as F

from linkloom.sources.tables import docs_as_entries


def _write_parts(df, path, key, n_parts=4):
    """Range-ordered files, one per range (file order = key order)."""
    from linkloom.plans.q_streaming import split_files
    return split_files(df, key, path, n_parts)


def test_r1_stream_boilerplate_equals_batch(spark, sf, tmp_path):
    from linkloom.operators import boilerplate as B
    from linkloom.streaming.operators import stream_boilerplate
    d = docs_as_entries(spark.read.parquet(f"{sf}/documents.parquet")).select("domain", "pos", "scraped")
    src = str(tmp_path / "src")
    schema = _write_parts(d, src, "pos")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(src)
    q = stream_boilerplate(stream, str(tmp_path / "out"), str(tmp_path / "ck"), freq=0.1)
    q.awaitTermination(300)
    got = spark.read.parquet(str(tmp_path / "out"))
    # domains that reached 8 entries are fitted by the stream; compare those with batch
    full = d.groupBy("domain").count().filter("count >= 8").select("domain")
    exp = B.fit_boilerplate(d, "scraped", samples=8, freq=0.1).join(full, "domain", "left_semi")
    a = sorted((r.domain, r.phrase, r.kind, r.n) for r in got.collect())
    b = sorted((r.domain, r.phrase, r.kind, r.n) for r in exp.collect())
    assert a == b and len(a) > 0


def test_r2_stream_keywords_equals_batch(spark, sf, tmp_path):
    from linkloom.operators import keywords as K
    from linkloom.streaming.operators import stream_keywords
    d = spark.read.parquet(f"{sf}/documents.parquet").select(F.col("doc_id").alias("pos"), "text")
    tc = K.term_counts(d, "pos", "text")
    dfreq = tc.groupBy("gram").agg(F.count(F.lit(1)).alias("df"))
    n = d.count()
    src = str(tmp_path / "src")
    schema = _write_parts(d, src, "pos", 3)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(src)
    q = stream_keywords(stream, dfreq, n, str(tmp_path / "out"), str(tmp_path / "ck"))
    q.awaitTermination(300)
    got = sorted((r.pos, r.keyword, r.rank, round(r.score, 6)) for r in spark.read.parquet(str(tmp_path / "out")).collect())
    exp = sorted((r.pos, r.keyword, r.rank, round(r.score, 6)) for r in K.keywords(d, "pos", "text", 10).collect())
    assert got == exp


def test_r3_stream_assign_equals_batch(spark, sf, tmp_path):
    from linkloom.operators import cluster as CL
    from linkloom.streaming.operators import stream_assign
    e = spark.read.parquet(f"{sf}/embeddings.parquet").select("vec_id", F.col("embedding").cast("array<double>").alias("v"), "label")
    cents = CL.label_centroids(e, "v", "label")
    src = str(tmp_path / "src")
    schema = _write_parts(e, src, "vec_id", 3)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(src)
    out = stream_assign(stream, cents, "v", "label", "centroid").select("vec_id", "cluster_id")
    q = out.writeStream.format("parquet").option("path", str(tmp_path / "out")) \
        .option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    q.awaitTermination(300)
    got = sorted(tuple(r) for r in spark.read.parquet(str(tmp_path / "out")).collect())
    exp = sorted(tuple(r) for r in CL.assign_to_clusters(e, cents, "v", "label").select("vec_id", "cluster_id").collect())
    assert got == exp


def test_r4_stream_dedup_first_url_wins(spark, sf, tmp_path):
    from linkloom.sources.tables import entries, entries_dup
    from linkloom.streaming.operators import stream_dedup
    e = entries_dup(entries(spark, sf)).select("pos", "url", "date")
    src = str(tmp_path / "src")
    schema = _write_parts(e, src, "pos", 4)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(src)
    q = stream_dedup(stream, "date", "3650 days").writeStream.format("parquet") \
        .option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "ck")) \
        .trigger(availableNow=True).start()
    q.awaitTermination(300)
    got = sorted((r.url, r.pos) for r in spark.read.parquet(str(tmp_path / "out")).collect())
    exp = sorted((r.url, r.pos) for r in e.groupBy("url").agg(F.min("pos").alias("pos")).collect())
    assert got == exp


def test_r1_stream_plus_finalize_equals_batch_for_all_domains(spark, sf, tmp_path):
    """availableNow stream, then the end-of-input flush of leftover state:
    every domain with >= 3 entries is fitted exactly as in batch."""
    from linkloom.operators import boilerplate as B
    from linkloom.sources.tables import entries
    from linkloom.streaming.operators import finalize_boilerplate, stream_boilerplate
    pages = spark.read.parquet(f"{sf}/pages.parquet").select(F.col("page_id").alias("pos"), "html")
    e = entries(spark, sf).join(pages, "pos").select("domain", "pos", F.col("html").alias("scraped"))
    src = str(tmp_path / "src")
    schema = _write_parts(e, src, "pos", 4)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(src)
    q = stream_boilerplate(stream, str(tmp_path / "out"), str(tmp_path / "ck"))
    q.awaitTermination(300)
    finalize_boilerplate(spark, str(tmp_path / "ck"), str(tmp_path / "out"))
    got = spark.read.schema("domain string, phrase string, kind string, n long").parquet(str(tmp_path / "out"))
    a = sorted((r.domain, r.phrase, r.kind, r.n) for r in got.collect())
    b = sorted((r.domain, r.phrase, r.kind, r.n) for r in B.fit_boilerplate(e, "scraped", samples=8).collect())
    assert a == b and len(b) > 0
