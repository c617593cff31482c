"""Queries for clustering, neighbours and cluster labels."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from linkloom.functions import text as T
from linkloom.operators import boilerplate as B
from linkloom.operators import cluster as CL
from linkloom.operators import entries as E
from linkloom.operators import joins as J
from linkloom.operators import keywords as K
from linkloom.plans.q_boilerplate import FREQ, fit_sql
from linkloom.plans.q_entries import _P13_SQL
from linkloom.plans.q_keywords import TFIDF_SQL, _md5_bucket, _md5_sign, encode_sql, hash_feats_sql
from linkloom.plans.registry import register
from linkloom.session import written_table
from linkloom.sources.tables import ENTRIES_SQL, docs_as_entries, load

EPS, MIN_SAMPLES, MIN_CLUSTER = 1.13, 2, 5


def _emb(spark, sf):
    return load(spark, sf, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("v"), "label")


CENTROIDS_SQL = """cen_raw AS (SELECT label, i, avg(x) AS m FROM (SELECT label, CAST(unnest(embedding) AS DOUBLE) AS x,
    generate_subscripts(embedding, 1) AS i FROM embeddings) GROUP BY label, i),
cen AS (SELECT label, list(m ORDER BY i) AS c FROM cen_raw GROUP BY label),
dist AS (SELECT e.vec_id, e.label AS own, c.label, list_distance(CAST(e.embedding AS DOUBLE[]), c.c) AS d
  FROM embeddings e CROSS JOIN cen c)"""


@register("j7_assign_to_clusters", "WITH " + CENTROIDS_SQL + """
SELECT vec_id, first(label ORDER BY d, label) AS cluster_id, round(min(d), 4) AS dist FROM dist GROUP BY vec_id""")
def j7_assign_to_clusters(spark, sf):
    e = _emb(spark, sf)
    cents = CL.label_centroids(e, "v", "label")
    a = CL.assign_to_clusters(e, cents, "v", "label", "centroid", "cluster_id")
    return a.select("vec_id", "cluster_id", F.round("centroid_dist", 4).alias("dist"))


@register("m7_centroid_confidence", "WITH " + CENTROIDS_SQL + """, own AS (SELECT vec_id, d FROM dist WHERE label = own)
SELECT vec_id, round(1 - d / ((SELECT max(d) FROM own) + 1e-6), 4) AS cluster_conf FROM own""")
def m7_centroid_confidence(spark, sf):
    e = _emb(spark, sf)
    cents = CL.label_centroids(e, "v", "label")
    c = CL.centroid_confidence(e, cents, "v", "label", "label", "centroid")
    return c.select("vec_id", "cluster_conf")


@register("m6_kmeans")
def m6_kmeans(spark, sf):
    out, _ = CL.kmeans(_emb(spark, sf), "v", 10, 42)
    return out.select("vec_id", "cluster_id", "cluster_conf")


PAIRS_SQL = """pd AS (SELECT a.vec_id AS i, b.vec_id AS j,
    list_distance(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])) AS d
  FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id)"""


@register("j8_knn", "WITH " + PAIRS_SQL + """
SELECT i AS id, rank, j AS neighbor, round(d, 4) AS dist FROM (
  SELECT i, j, d, row_number() OVER (PARTITION BY i ORDER BY d, j) AS rank FROM pd) WHERE rank <= 5""")
def j8_knn(spark, sf):
    k = CL.knn(_emb(spark, sf), 5, "vec_id", "v")
    return k.select("id", "rank", "neighbor", F.round("dist", 4).alias("dist"))


DENSITY_SQL = "WITH RECURSIVE " + PAIRS_SQL + f""",
pairs AS (SELECT i, j, d FROM pd WHERE i < j AND d <= {EPS}),
sym AS (SELECT i, j, d FROM pairs UNION ALL SELECT j, i, d FROM pairs),
kth AS (SELECT i AS id, d AS core_dist FROM (
  SELECT i, j, d, row_number() OVER (PARTITION BY i ORDER BY d, j) AS r FROM sym) WHERE r = {MIN_SAMPLES - 1}),
core AS (SELECT id FROM kth),
edges AS (SELECT i, j FROM pairs WHERE i IN (SELECT id FROM core) AND j IN (SELECT id FROM core)),
esym AS (SELECT i, j FROM edges UNION SELECT j, i FROM edges),
cc(v, l) AS (SELECT id, id FROM core UNION SELECT e.j, cc.l FROM cc JOIN esym e ON cc.v = e.i),
comp AS (SELECT v AS id, min(l) AS component FROM cc GROUP BY v),
sizes AS (SELECT component FROM comp GROUP BY component HAVING count(*) >= {MIN_CLUSTER}),
lab AS (SELECT c.id, c.component AS cluster_id FROM comp c JOIN sizes USING (component)),
m8 AS (SELECT e.vec_id, coalesce(lab.cluster_id, -1) AS cluster_id, kth.core_dist
  FROM embeddings e LEFT JOIN lab ON lab.id = e.vec_id LEFT JOIN kth ON kth.id = e.vec_id)"""


def _density(spark, sf):
    return CL.density_cluster(_emb(spark, sf), EPS, MIN_SAMPLES, MIN_CLUSTER, "vec_id", "v")


@register("m8_density_cluster", DENSITY_SQL + " SELECT vec_id, cluster_id, round(core_dist, 4) AS core_dist FROM m8")
def m8_density_cluster(spark, sf):
    return _density(spark, sf).select("vec_id", "cluster_id", F.round("core_dist", 4).alias("core_dist"))


@register("m10_density_confidence", DENSITY_SQL + """, best AS (SELECT cluster_id, min(core_dist) AS m FROM m8
  WHERE cluster_id >= 0 GROUP BY cluster_id)
SELECT vec_id, cluster_id, round(CASE WHEN cluster_id < 0 THEN 0.0 WHEN core_dist = 0 THEN 1.0
  ELSE m / core_dist END, 4) AS cluster_conf FROM m8 LEFT JOIN best USING (cluster_id)""")
def m10_density_confidence(spark, sf):
    return CL.density_confidence(_density(spark, sf), "vec_id").select("vec_id", "cluster_id", "cluster_conf")


@register("m9_density_hierarchy")
def m9_density_hierarchy(spark, sf):
    return CL.density_hierarchy(_emb(spark, sf), MIN_SAMPLES, MIN_CLUSTER, "vec_id", "v")


@register("j7_assign_density")
def j7_assign_density(spark, sf):
    """Every vector, moved by a small step, placed in the tree of all vectors."""
    from linkloom.operators.hierarchy import DensityTree
    e = _emb(spark, sf)
    moved = e.select("vec_id", F.transform("v", lambda x: x + 0.01).alias("v"))
    return CL.assign_to_density_clusters(moved, DensityTree(e, MIN_SAMPLES, MIN_CLUSTER, "vec_id", "v"), "v", "vec_id")


@register("a9_cluster_members", DENSITY_SQL + " SELECT cluster_id, vec_id AS member, cluster_id < 0 AS is_outlier FROM m8")
def a9_cluster_members(spark, sf):
    return CL.cluster_members(_density(spark, sf), "vec_id")


@register("a10_cluster_counts", DENSITY_SQL + " SELECT cluster_id, count(*) AS n FROM m8 GROUP BY cluster_id")
def a10_cluster_counts(spark, sf):
    return CL.cluster_counts(_density(spark, sf), "cluster_id", "vec_id")


# --- label operators over documents: clusters = (quality, toxic) of labelled docs ----------
DOC_CLUSTERS_SQL = TFIDF_SQL + """,
kt AS (SELECT id, array_to_string(list_sort(list(gram)), ' ') AS keywords_text FROM top GROUP BY id),
dc AS (SELECT d.doc_id, d.source, d.lang, coalesce(l.quality * 2 + l.toxic, -1) AS cluster_id,
  coalesce(kt.keywords_text, '') AS keywords_text
  FROM documents d LEFT JOIN labels l USING (doc_id) LEFT JOIN kt ON kt.id = d.doc_id)"""


def doc_clusters(spark, sf):
    d = load(spark, sf, "documents").select("doc_id", "source", "lang", "text")
    lab = load(spark, sf, "labels").select("doc_id", (F.col("quality") * 2 + F.col("toxic")).alias("cid"))
    # texts stay out of the joins; callers read the clusters more than once
    kw = K.keyword_arrays(K.keywords(d, "doc_id", "text", 10), d.drop("text"), "doc_id")
    return written_table(kw.join(lab, "doc_id", "left").select(
        "doc_id", "source", "lang", F.coalesce("cid", F.lit(-1)).alias("cluster_id"),
        T.keywords_text(F.col("keywords")).alias("keywords_text")), "doc-clusters")


A11_SQL = DOC_CLUSTERS_SQL + """,
words AS (SELECT cluster_id, unnest(string_split_regex(keywords_text, '\\s+')) AS word FROM dc WHERE cluster_id >= 0),
wc AS (SELECT cluster_id, word, count(*) AS n FROM words WHERE word <> '' GROUP BY cluster_id, word),
topw AS (SELECT cluster_id, word, row_number() OVER (PARTITION BY cluster_id ORDER BY n DESC, word) AS r FROM wc),
lab AS (SELECT cluster_id, string_agg(word, ' | ' ORDER BY r) AS lab FROM topw WHERE r <= 5 GROUP BY cluster_id),
a11 AS (SELECT dc.doc_id, dc.cluster_id, CASE WHEN dc.cluster_id < 0 THEN 'Noise' ELSE coalesce(lab.lab, 'Unclustered') END
  AS cluster_label FROM dc LEFT JOIN lab USING (cluster_id))"""


@register("a11_cluster_keyword_labels", A11_SQL + " SELECT doc_id, cluster_id, cluster_label FROM a11")
def a11_cluster_keyword_labels(spark, sf):
    return CL.cluster_keyword_labels(doc_clusters(spark, sf)).select("doc_id", "cluster_id", "cluster_label")


@register("a12_mode_label", """SELECT source, first(lang ORDER BY n DESC, lang) AS mode_label FROM (
  SELECT source, lang, count(*) AS n FROM documents GROUP BY source, lang) GROUP BY source""")
def a12_mode_label(spark, sf):
    return CL.mode_label(load(spark, sf, "documents"), "source", "lang")


@register("a13_cluster_word_counts", DOC_CLUSTERS_SQL + """,
words AS (SELECT cluster_id, unnest(string_split_regex(keywords_text, '\\s+')) AS word FROM dc WHERE cluster_id >= 0)
SELECT cluster_id, word, count(*) AS n FROM words WHERE word <> '' GROUP BY cluster_id, word""")
def a13_cluster_word_counts(spark, sf):
    return CL.cluster_word_counts(doc_clusters(spark, sf))


@register("j2_attach_cluster_label", A11_SQL + """,
labels_t AS (SELECT DISTINCT cluster_id, cluster_label FROM a11 WHERE cluster_id IN (0, 1, 2))
SELECT dc.doc_id, CASE WHEN dc.cluster_id < 0 THEN 'Noise' ELSE coalesce(t.cluster_label, 'Other') END AS cluster_label
FROM dc LEFT JOIN labels_t t USING (cluster_id)""")
def j2_attach_cluster_label(spark, sf):
    dc = doc_clusters(spark, sf)
    labs = CL.cluster_keyword_labels(dc).filter(F.col("cluster_id").isin(0, 1, 2)) \
        .select("cluster_id", "cluster_label").distinct()
    return J.attach_cluster_label(dc, labs).select("doc_id", "cluster_label")


@register("j3_inject_labels", """SELECT d.doc_id, coalesce(m.label, 'Unclustered') AS label FROM documents d
LEFT JOIN (SELECT DISTINCT doc_id, 'q' || CAST(quality AS VARCHAR) || 't' || CAST(toxic AS VARCHAR) AS label FROM labels) m
USING (doc_id)""")
def j3_inject_labels(spark, sf):
    d = load(spark, sf, "documents").select(F.col("doc_id").alias("cluster_id"))
    m = load(spark, sf, "labels").select(F.col("doc_id").alias("cluster_id"), F.concat(
        F.lit("q"), F.col("quality").cast("string"), F.lit("t"), F.col("toxic").cast("string")).alias("label")).distinct()
    return J.inject_labels(d, m, "cluster_id", "label").select(F.col("cluster_id").alias("doc_id"), "label")


_LABELS_SQL = "[" + ", ".join("'" + x + "'" for x in dict.fromkeys(CL.DEFAULT_ZERO_SHOT_LABELS)) + "]"
J5_SQL = DOC_CLUSTERS_SQL + f""",
labs AS (SELECT unnest({_LABELS_SQL}) AS label),
{encode_sql('labs', 'label', 'label', 384, 'le')},
{hash_feats_sql('cf', '(SELECT * FROM dc WHERE cluster_id >= 0)', 'cluster_id', 'keywords_text')},
cv AS (SELECT cluster_id, {_md5_bucket('m')} AS bucket, sum({_md5_sign('m')}) AS v FROM cf GROUP BY cluster_id, bucket),
cvn AS (SELECT * FROM cv WHERE v <> 0),
nrm AS (SELECT cluster_id, sqrt(sum(v * v)) AS nrm FROM cvn GROUP BY cluster_id),
dots AS (SELECT c.cluster_id, l.id AS label, sum(c.v * l.value) AS dot FROM cvn c JOIN le l USING (bucket)
  GROUP BY c.cluster_id, l.id),
sc AS (SELECT cluster_id, label, round(dot / nrm, 9) AS score FROM dots JOIN nrm USING (cluster_id)),
best AS (SELECT cluster_id, first(label ORDER BY score DESC, length(label), label) AS zero_shot_label FROM sc WHERE score > 0
  GROUP BY cluster_id)
SELECT ids.cluster_id, coalesce(best.zero_shot_label, 'Other') AS zero_shot_label
FROM (SELECT DISTINCT cluster_id FROM dc WHERE cluster_id >= 0) ids LEFT JOIN best USING (cluster_id)"""


@register("j5_score_labels", J5_SQL)
def j5_score_labels(spark, sf):
    return CL.score_labels(doc_clusters(spark, sf)).select("cluster_id", "zero_shot_label")


@register("m12_cluster_and_label")
def m12_cluster_and_label(spark, sf):
    from pyspark import StorageLevel

    from linkloom.operators import vectors as V
    d = load(spark, sf, "documents").select("doc_id", "text")
    # features are read by the fit, the confidence, both kinds of labels and the result; kept as
    # they are, since k-means starts from their order
    kept = V.encode(d, "doc_id", "text", 64, "features").drop("text").persist(StorageLevel.DISK_ONLY)
    feats = K.keyword_arrays(K.keywords(d, "doc_id", "text", 10), kept, "doc_id") \
        .withColumn("keywords_text", T.keywords_text(F.col("keywords"))).drop("keywords")
    out = CL.cluster_and_label(feats, "kmeans", "features", "doc_id", n_clusters=8, zero_shot=True)
    out = written_table(out.select("doc_id", "cluster_id", "cluster_conf", "cluster_label", "zero_shot_label"), "cluster-labels")
    kept.unpersist()
    return out


# --- seed labels, dropped labels -------------------------------------------------------------
def _folder_labels(spark, sf):
    from linkloom.functions.urls import folder_label
    from linkloom.plans.q_entries import _folder_paths
    from linkloom.sources.tables import entries
    return _folder_paths(entries(spark, sf)).select(folder_label(F.col("path")).alias("label"))


_FOLDER_LABEL_SQL = _P13_SQL
_SEEDS = ["coding", "News", "travel"]


@register("a15_seed_labels", _FOLDER_LABEL_SQL.replace("SELECT pos, regexp_replace(regexp_replace(lower(",
                                                      "SELECT DISTINCT label FROM (SELECT regexp_replace(regexp_replace(lower(", 1)
          + " UNION SELECT unnest(['coding', 'News', 'travel'])) WHERE label <> ''")
def a15_seed_labels(spark, sf):
    from linkloom.operators.labels import seed_labels
    return seed_labels(_folder_labels(spark, sf), _SEEDS)


_J9_SQL = """WITH cand AS (SELECT DISTINCT lower(regexp_extract(text, '^[\\p{L}\\p{N}_]+', 0)) AS label FROM documents),
drops AS (SELECT DISTINCT lower(lang) AS d FROM documents UNION SELECT 'misc')
SELECT label FROM cand WHERE label <> '' AND lower(label) NOT IN (SELECT d FROM drops)"""


@register("j9_drop_labels", _J9_SQL)
def j9_drop_labels(spark, sf):
    d = load(spark, sf, "documents")
    cand = d.select(F.lower(F.regexp_extract("text", r"^[\p{L}\p{N}_]+", 0)).alias("label")).distinct() \
        .filter(F.col("label") != "")
    drops = d.select(F.upper("lang").alias("d")).unionByName(spark.createDataFrame([("MISC",)], "d string"))
    return J.drop_labels(cand, drops, "label")


# --- boilerplate map sink/source, refit of unlocked domains --------------------------------
@register("s7_boilerplate_roundtrip", "WITH " + fit_sql() + " SELECT DISTINCT domain, phrase FROM boilerplate")
def s7_boilerplate_roundtrip(spark, sf):
    from linkloom.session import scratch_path
    d = docs_as_entries(load(spark, sf, "documents"))
    bp = B.fit_boilerplate(d, "scraped", freq=FREQ)
    path = scratch_path(spark, f"boilerplate-{uuid.uuid4().hex}")
    B.write_boilerplate(bp, path)
    assert not B.write_boilerplate(bp, path)   # an existing map is kept
    return B.read_boilerplate(spark, path).select("domain", "phrase")


@register("u4_refit_unlocked", "WITH " + fit_sql() + """, big AS (SELECT domain FROM docs_as_entries GROUP BY domain
  ORDER BY count(*) DESC, domain LIMIT 5)
SELECT domain, phrase FROM boilerplate""")
def u4_refit_unlocked(spark, sf):
    d = docs_as_entries(load(spark, sf, "documents"))
    top = E.top_domains(d, 5).select("domain")
    existing = B.fit_boilerplate(d.join(top, "domain", "left_semi"), "scraped", freq=FREQ)
    return B.refit_boilerplate(d, existing, text_col="scraped", freq=FREQ).select("domain", "phrase")


@register("s8_clusters_csv", DENSITY_SQL + " SELECT vec_id, cluster_id FROM m8")
def s8_clusters_csv(spark, sf):
    from linkloom.session import scratch_path
    from linkloom.sources.sinks import read_clusters_csv, write_clusters_csv
    path = scratch_path(spark, f"clusters-{uuid.uuid4().hex}")
    write_clusters_csv(_density(spark, sf).select("vec_id", "cluster_id"), path)
    return read_clusters_csv(spark, path, "vec_id long, cluster_id long")


@register("s9_stage_checkpoint", "SELECT doc_id, md5(text) AS fingerprint FROM documents")
def s9_stage_checkpoint(spark, sf):
    """Write the stage once, then read it back through a cache hit whose
    compute function would return nothing - the result proves reuse."""
    from linkloom.session import scratch_path
    from linkloom.sources.sinks import StageCheckpoint, corpus_fingerprint
    d = load(spark, sf, "documents").select("doc_id", F.md5("text").alias("fingerprint"))
    fp = corpus_fingerprint(d, "doc_id", "fingerprint")
    ck = StageCheckpoint(root=scratch_path(spark, f"stages-{uuid.uuid4().hex}"))
    ck.run("fingerprints", fp, lambda: d)
    return ck.run("fingerprints", fp, lambda: d.limit(0))


@register("a16_corpus_fingerprint")
def a16_corpus_fingerprint(spark, sf):
    from linkloom.sources.sinks import corpus_fingerprint_df
    from linkloom.sources.tables import entries
    return corpus_fingerprint_df(entries(spark, sf), "pos", "url")


_A16_FIELD = "coalesce(CAST(length(CAST({0} AS VARCHAR)) AS VARCHAR) || ':' || CAST({0} AS VARCHAR), '-')"
_A16_LEVELS = "".join(f""",
l{k + 1} AS (SELECT pos // 64 AS pos, CASE WHEN (SELECT count(*) FROM l{k}) = 1 THEN max(d) ELSE md5(string_agg(d, '' ORDER BY pos)) END AS d
  FROM l{k} GROUP BY pos // 64)""" for k in range(5))
_A16_SQL = ("WITH " + ENTRIES_SQL + ", l0 AS (SELECT row_number() OVER (ORDER BY pos) - 1 AS pos, md5("
            + " || ".join(_A16_FIELD.format(c) for c in ("pos", "url", "title")) + ") AS d FROM entries)" + _A16_LEVELS + """
SELECT (SELECT count(*) FROM entries) AS n, md5((SELECT count(*) FROM entries) || ':' || d || ':' || md5('top_k=10')) AS fingerprint FROM l5""")


@register("a16_ordered_fingerprint", _A16_SQL)
def a16_ordered_fingerprint(spark, sf):
    from linkloom.sources.sinks import ordered_fingerprint_df
    from linkloom.sources.tables import entries
    return ordered_fingerprint_df(entries(spark, sf), "pos", "pos", "url", "title", settings={"top_k": 10, "off": None})
