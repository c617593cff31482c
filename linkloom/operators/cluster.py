"""Clustering (M6-M10, M12), neighbours (J7, J8) and cluster labels
(A9-A13, J5); J2, J3 live in joins.py.

* k-means is MLlib's (k-means||); centroids (k rows, size-checked) become a
  literal array so assignment and confidence need no join.
* Exact neighbour search runs on a pivot index (metric.py).  ``range_pairs_lsh``
  is MLlib's BucketedRandomProjectionLSH (approximate recall).
* Density clusters at one distance = connected components of core points
  (DBSCAN*) by min-label propagation, checkpointed to the shared checkpoint
  folder; over all distances: the tree of hierarchy.py.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from linkloom.session import cut_lineage

# Candidate labels for zero-shot cluster naming (the original
# list repeats 'hobbies'; it is kept once, Q22).
DEFAULT_ZERO_SHOT_LABELS = [
    'robotics', 'gardening', 'art', 'research papers', 'job search', 'utilities', 'misc', 'travel',
    'health', 'piracy', 'recipes', 'data science', 'privacy', 'modding', 'local businesses',
    'music', 'sports', 'hobbies', 'photography', 'web development', 'natural science', 'education',
    'social media', 'self-improvement', 'fitness', 'movies', 'social issues', 'reading',
    'lifestyle', 'food', 'artificial intelligence', 'culture', 'philosophy', 'nsfw', 'religion',
    'television', 'manga', 'anime', 'finance', 'social sciences', 'computer vision', 'academia',
    'books', 'nature', 'cooking', 'tech', 'sexuality', 'software', 'reference', 'coding', 'writing',
    'drugs', 'projects', 'aesthetics', 'math', 'news', 'environmentalism', 'politics', 'gaming',
    'current events', 'consumerism', 'history', 'fashion', 'articles', 'entertainment', 'comics',
]


# --- vector expressions ---------------------------------------------------------
def sq_dist(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda acc, x: acc + x)


def euclid(a: Column, b: Column) -> Column:
    return F.sqrt(sq_dist(a, b))


def collect_centroids(centroids: DataFrame, id_col: str, vec_col: str, max_centroids: int = 10000):
    """Bring k centroids to the driver - bounded by k, checked."""
    rows = centroids.select(id_col, vec_col).limit(max_centroids + 1).collect()
    if len(rows) > max_centroids:
        raise ValueError(f"more than {max_centroids} centroids; use a join-based assignment")
    rows.sort(key=lambda r: r[0])
    return [int(r[0]) for r in rows], [[float(x) for x in r[1]] for r in rows]


def nearest(v: Column, ids, vecs) -> Column:
    """struct(dist, id) of the nearest centroid (ties -> smaller id)."""
    cents = F.lit(vecs)
    idl = F.lit(ids)
    return F.array_min(F.transform(cents, lambda c, i: F.struct(euclid(v, c).alias("dist"),
                                                                F.element_at(idl, i + 1).alias("id"))))


def label_centroids(df: DataFrame, vec_col: str, label_col: str) -> DataFrame:
    """Mean vector per label: (label, centroid) via per-dimension averages."""
    ex = df.select(label_col, F.posexplode(F.col(vec_col).cast("array<double>")).alias("i", "x"))
    per = ex.groupBy(label_col, "i").agg(F.avg("x").alias("m"))
    return per.groupBy(label_col).agg(F.array_sort(F.collect_list(F.struct("i", "m"))).alias("_c")) \
        .select(label_col, F.transform("_c", lambda s: s["m"]).alias("centroid"))


def assign_to_clusters(df: DataFrame, centroids: DataFrame, vec_col: str = "features", id_col: str = "cluster_id",
                       centroid_col: str = "centroid", out_col: str = "cluster_id") -> DataFrame:
    """Nearest existing centre for every row (centres as a literal)."""
    ids, vecs = collect_centroids(centroids, id_col, centroid_col)
    nn = nearest(F.col(vec_col).cast("array<double>"), ids, vecs)
    return df.withColumn("_nn", nn).withColumn(out_col, F.col("_nn.id")) \
        .withColumn("centroid_dist", F.col("_nn.dist")).drop("_nn")


def centroid_confidence(df: DataFrame, centroids: DataFrame, vec_col: str = "features", cluster_col: str = "cluster_id",
                        id_col: str = "cluster_id", centroid_col: str = "centroid", out_col: str = "cluster_conf") -> DataFrame:
    """M7: 1 - d / (max d over all rows + 1e-6), 4 dp; d = distance to the own centre."""
    ids, vecs = collect_centroids(centroids, id_col, centroid_col)
    pos = F.array_position(F.lit(ids), F.col(cluster_col))
    own = F.element_at(F.lit(vecs), pos.cast("int"))
    d = df.withColumn("_d", euclid(F.col(vec_col).cast("array<double>"), own))
    maxd = d.agg(F.max("_d")).collect()[0][0] or 0.0
    return d.withColumn(out_col, F.round(F.lit(1.0) - F.col("_d") / F.lit(maxd + 1e-6), 4)).drop("_d")


def kmeans(df: DataFrame, vec_col: str = "features", k: int = 10, seed: int = 42, max_iter: int = 300,
           out_col: str = "cluster_id"):
    """M6: MLlib k-means; returns (assigned df with ``cluster_conf``, centroids df)."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector
    data = df.withColumn("_v", array_to_vector(F.col(vec_col).cast("array<double>")))
    model = KMeans(k=k, seed=seed, featuresCol="_v", predictionCol=out_col, maxIter=max_iter).fit(data)
    spark = df.sparkSession
    cents = spark.createDataFrame([(i, [float(x) for x in c]) for i, c in enumerate(model.clusterCenters())],
                                  f"{out_col} int, centroid array<double>")
    out = model.transform(data).drop("_v").withColumn(out_col, F.col(out_col).cast("int"))
    out = centroid_confidence(out, cents, vec_col, out_col, out_col)
    return out, cents


# --- exact neighbour search (pivot index, see metric.py) ---------------------------
def range_pairs(df: DataFrame, eps: float, id_col: str = "id", vec_col: str = "vector") -> DataFrame:
    """Every unordered pair (i < j) with distance <= eps, exactly once."""
    from linkloom.operators import metric
    index = metric.Index(df, id_col, vec_col)
    named = index.member_classes()
    x, y = (named.select(F.col("id").alias(f"{e}_id"), F.col("cls").alias(e)) for e in "ij")
    apart = metric.range_pairs(index, eps).join(x, "i").join(y, "j").select(
        F.least("i_id", "j_id").alias("i"), F.greatest("i_id", "j_id").alias("j"), "d")
    same = x.join(y, F.col("i") == F.col("j")).where("i_id < j_id").select(
        F.col("i_id").alias("i"), F.col("j_id").alias("j"), F.lit(0.0).alias("d"))
    return apart.unionByName(same) if eps >= 0 else apart


def range_pairs_lsh(df: DataFrame, eps: float, id_col: str = "id", vec_col: str = "vector",
                    bucket_length: float | None = None, num_tables: int = 8, seed: int = 42) -> DataFrame:
    """Approximate ``range_pairs`` with MLlib BucketedRandomProjectionLSH
    (an equi-join on hash buckets); pairs it finds are exact distances."""
    from pyspark.ml.feature import BucketedRandomProjectionLSH
    from pyspark.ml.functions import array_to_vector
    data = df.select(F.col(id_col).cast("long").alias("id"),
                     array_to_vector(F.col(vec_col).cast("array<double>")).alias("v"))
    lsh = BucketedRandomProjectionLSH(inputCol="v", outputCol="h", bucketLength=bucket_length or 2.0 * eps,
                                      numHashTables=num_tables, seed=seed).fit(data)
    j = lsh.approxSimilarityJoin(data, data, eps, distCol="d")
    return j.select(F.col("datasetA.id").alias("i"), F.col("datasetB.id").alias("j"), "d").filter("i < j")


def knn(df: DataFrame, k: int, id_col: str = "id", vec_col: str = "vector") -> DataFrame:
    """J8 (exact): (id, rank, neighbor, dist) for the k nearest other points; ties to
    smaller ids.

    The search runs on classes of equal vectors; a class needs its own and its
    neighbours' k + 1 smallest ids only, whatever their number of copies."""
    from linkloom.operators import metric
    from linkloom.operators.ranking import first_per_group
    index = metric.Index(df, id_col, vec_col)
    named = index.member_classes()
    few = first_per_group(named, "cls", "id", k + 1).select("cls", F.col("id").alias("neighbor"))
    own = few.select(F.col("cls").alias("q"), F.lit(0.0).alias("d"), "neighbor")
    others = metric.neighbours(index, k).join(few.withColumnRenamed("cls", "other"), "other").select("q", "d", "neighbor")
    w = Window.partitionBy("q").orderBy("d", "neighbor")
    near = own.unionByName(others).withColumn("r", F.row_number().over(w)).where(F.col("r") <= k + 1).groupBy("q").agg(
        F.array_sort(F.collect_list(F.struct("d", "neighbor"))).alias("near"))
    rest = F.slice(F.filter("near", lambda x: x["neighbor"] != F.col("id")), 1, k)
    return named.join(near, F.col("cls") == F.col("q")).select("id", F.posexplode(rest).alias("p", "n")).select(
        "id", (F.col("p") + 1).alias("rank"), "n.neighbor", F.col("n.d").alias("dist"))


# --- connected components -----------------------------------------------------------
def connected_components(vertices: DataFrame, edges: DataFrame, max_rounds: int = 200) -> DataFrame:
    """(id, component) = smallest id reachable; min-label propagation.

    Each round propagates labels along edges (partial ``min`` aggregation per
    target, so a hub vertex costs one row per task), lets every vertex adopt its
    label's label, and is a reliable checkpoint.  Rounds go on until no label
    changes; running out of rounds is an error, never a result.
    """
    e = edges.select(F.col("i").alias("src"), F.col("j").alias("dst"))
    e = cut_lineage(e.unionByName(e.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct())
    labels = cut_lineage(vertices.select(F.col("id"), F.col("id").alias("label")))
    for _ in range(max_rounds):
        prop = e.join(labels.withColumnRenamed("id", "src"), "src") \
            .groupBy(F.col("dst").alias("id")).agg(F.min("label").alias("cand"))
        new = labels.join(prop, "id", "left").select(
            "id", F.col("label").alias("old"), F.least("label", F.coalesce("cand", "label")).alias("label"))
        # pointer jumping: labels are vertices; a label's own last label is never larger
        jump = labels.select(F.col("id").alias("label"), F.col("label").alias("_ll"))
        new = cut_lineage(new.join(jump, "label", "left").select(
            "id", "old", F.least("label", F.coalesce("_ll", "label")).alias("label")))
        labels = new.select("id", "label")
        if new.filter("label <> old").limit(1).count() == 0:
            return labels.withColumnRenamed("label", "component")
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")


def density_cluster(df: DataFrame, eps: float, min_samples: int = 2, min_cluster_size: int = 5,
                    id_col: str = "id", vec_col: str = "vector") -> DataFrame:
    """M8: DBSCAN* at ``eps`` with noise -1.

    core distance = distance to the ``min_samples``-th nearest point counting
    the point itself; core points (core distance <= eps) linked when within
    eps form components; components smaller than ``min_cluster_size`` are
    noise.  A cluster's id is its smallest member id (stable, no global
    ranking).  Returns (id, cluster_id, core_dist), core_dist null for
    non-core points.  Rows that take no part in the index (see ``metric``)
    are noise."""
    from linkloom.operators import metric
    from linkloom.session import written_table
    index = metric.Index(df, id_col, vec_col)
    core = written_table(metric.core_distances(index, min_samples).where(F.col("core") <= eps).withColumnRenamed("q", "cls"), "density-core")
    comp = connected_components(core.select(F.col("cls").alias("id")), metric.linked(index, core, eps)).withColumnRenamed("id", "cls")
    sized = comp.join(index.classes.select("cls", "m"), "cls")
    big = sized.groupBy("component").agg(F.sum("m").alias("n")).filter(F.col("n") >= min_cluster_size).select("component")
    # a class is named by its smallest member, and so is a component
    at = index.member_classes().join(core.select("cls", F.col("core").alias("core_dist")), "cls").join(comp.join(big, "component"), "cls", "left")
    ids = df.select(F.col(id_col).cast("long").alias("id"))
    return ids.join(at.select("id", "component", "core_dist"), "id", "left").select(
        F.col("id").alias(id_col), F.coalesce("component", F.lit(-1)).cast("long").alias("cluster_id"), "core_dist")


def density_confidence(clustered: DataFrame, id_col: str = "id") -> DataFrame:
    """Membership strength min(core in cluster) / core, 0 for noise, 4 dp."""
    best = clustered.filter("cluster_id >= 0").groupBy("cluster_id").agg(F.min("core_dist").alias("_m"))
    out = clustered.join(best, "cluster_id", "left")
    conf = F.when(F.col("cluster_id") < 0, F.lit(0.0)).when(F.col("core_dist") == 0, F.lit(1.0)) \
        .otherwise(F.col("_m") / F.col("core_dist"))
    return out.withColumn("cluster_conf", F.round(conf, 4)).drop("_m")


def density_hierarchy(df: DataFrame, min_samples: int = 2, min_cluster_size: int = 5, id_col: str = "id",
                      vec_col: str = "vector") -> DataFrame:
    """M9 + M10: (id, cluster_id, cluster_conf): clusters chosen from the whole density
    hierarchy by excess of mass, and each row's membership strength (4 dp).

    See ``hierarchy.DensityTree``; rows that take no part are noise (-1, 0)."""
    from linkloom.operators.hierarchy import DensityTree
    rows = DensityTree(df, min_samples, min_cluster_size, id_col, vec_col).rows
    return df.select(F.col(id_col).cast("long").alias("id")).join(rows, "id", "left").select(
        F.col("id").alias(id_col), F.coalesce("cluster_id", F.lit(-1)).cast("long").alias("cluster_id"),
        F.round(F.coalesce("probability", F.lit(0.0)), 4).alias("cluster_conf"))


def assign_to_density_clusters(df: DataFrame, tree, vec_col: str = "vector", id_col: str = "id") -> DataFrame:
    """J7 for density clusters: (id, cluster_id, cluster_conf) of new rows in a fitted
    ``hierarchy.DensityTree``; -1 for noise."""
    got = tree.predict(df, id_col, vec_col)
    return got.select(F.col("id").alias(id_col), "cluster_id", F.round("probability", 4).alias("cluster_conf"))


# --- cluster summaries and labels ----------------------------------------------------
def cluster_members(df: DataFrame, id_col: str = "pos") -> DataFrame:
    """A9 (long form, no per-cluster collect): (cluster_id, member, is_outlier)."""
    return df.select("cluster_id", F.col(id_col).alias("member"), (F.col("cluster_id") < 0).alias("is_outlier"))


def cluster_counts(df: DataFrame, by: str = "cluster_id", count_col: str = "url") -> DataFrame:
    """A10: members per value of ``by`` (count of non-null ``count_col``)."""
    c = F.count(F.col(count_col)) if count_col in df.columns else F.count(F.lit(1))
    return df.groupBy(by).agg(c.alias("n"))


def cluster_word_counts(df: DataFrame, text_col: str = "keywords_text") -> DataFrame:
    """A13 in bag form: (cluster_id, word, n) over the members' texts - the
    distributed equivalent of concatenating them (never one string per cluster)."""
    words = df.filter(F.col("cluster_id") >= 0).select(
        "cluster_id", F.explode(F.split(F.coalesce(F.col(text_col), F.lit("")), r"(?U)\s+")).alias("word"))
    return words.filter(F.col("word") != "").groupBy("cluster_id", "word").agg(F.count(F.lit(1)).alias("n"))


def cluster_keyword_labels(df: DataFrame, top_k: int = 5, text_col: str = "keywords_text") -> DataFrame:
    """A11: ' | '-joined top words (count desc, word asc, Q6) per cluster;
    'Unclustered' without words, 'Noise' for ids < 0."""
    wc = cluster_word_counts(df, text_col)
    w = Window.partitionBy("cluster_id").orderBy(F.desc("n"), F.asc("word"))
    top = wc.withColumn("r", F.row_number().over(w)).filter(F.col("r") <= top_k)
    labels = top.groupBy("cluster_id").agg(F.array_sort(F.collect_list(F.struct("r", "word"))).alias("_t")) \
        .select("cluster_id", F.array_join(F.transform("_t", lambda x: x["word"]), " | ").alias("_lab"))
    out = df.join(labels, "cluster_id", "left")
    return out.withColumn("cluster_label", F.when(F.col("cluster_id") < 0, F.lit("Noise"))
                          .otherwise(F.coalesce("_lab", F.lit("Unclustered")))).drop("_lab")


def mode_label(df: DataFrame, group_col: str = "cluster_id", label_col: str = "label") -> DataFrame:
    """Most frequent label per group; ties -> smallest label.  Counts are
    combined map-side, so no group's values are gathered."""
    n = df.groupBy(group_col, label_col).agg(F.count(label_col).alias("n"))
    best = n.filter("n > 0").groupBy(group_col).agg(F.min(F.struct((-F.col("n")).alias("o"), F.col(label_col).alias("v"))).alias("b"))
    return df.select(group_col).distinct().join(best.withColumnRenamed(group_col, "_g"), F.col(group_col).eqNullSafe(F.col("_g")), "left") \
        .select(group_col, F.col("b.v").alias("mode_label"))


def score_labels(clusters: DataFrame, labels: list[str] | DataFrame | None = None, text_col: str = "keywords_text",
                 dim: int = 384) -> DataFrame:
    """Best candidate label per cluster by cosine in the hashing space
    between the cluster's word bag and each label; 'Other' when nothing
    overlaps."""
    from linkloom.operators import vectors as V
    spark = clusters.sparkSession
    if labels is None:
        labels = DEFAULT_ZERO_SHOT_LABELS
    lab = spark.createDataFrame([(x,) for x in dict.fromkeys(labels)], "label string") if isinstance(labels, list) \
        else labels.select(F.col(labels.columns[0]).alias("label")).distinct()
    lv = V.encode_sparse(lab, "label", "label", dim).withColumnRenamed("value", "lv")
    members = clusters.filter(F.col("cluster_id") >= 0)
    feats = members.select("cluster_id", F.explode(V.hash_features(F.col(text_col))).alias("f"))
    cv = feats.groupBy("cluster_id", V.bucket_of(F.col("f"), dim).alias("bucket")) \
        .agg(F.sum(V.sign_of(F.col("f"))).alias("v")).filter("v <> 0")
    norm = cv.groupBy("cluster_id").agg(F.sqrt(F.sum(F.col("v") * F.col("v"))).alias("nrm"))
    dots = cv.join(lv, "bucket").groupBy("cluster_id", "label").agg(F.sum(F.col("v") * F.col("lv")).alias("dot"))
    scored = dots.join(norm, "cluster_id").withColumn("score", F.round(F.col("dot") / F.col("nrm"), 9))
    best = scored.filter("score > 0").groupBy("cluster_id").agg(
        F.min(F.struct((-F.col("score")).alias("s"), F.length("label").alias("n"), F.col("label").alias("l"))).alias("b"))
    best = best.select("cluster_id", F.col("b.l").alias("zero_shot_label"), (-F.col("b.s")).alias("zero_shot_score"))
    ids = members.select("cluster_id").distinct()
    return ids.join(best, "cluster_id", "left").withColumn(
        "zero_shot_label", F.coalesce("zero_shot_label", F.lit("Other")))


def cluster_and_label(df: DataFrame, algorithm: str = "kmeans", vec_col: str = "features", id_col: str = "pos",
                      n_clusters: int = 10, eps: float = 1.0, min_samples: int = 2, min_cluster_size: int = 5,
                      seed: int = 42, top_k: int = 5, zero_shot: bool = False, candidate_labels=None):
    """Fit -> keyword labels (A11) -> optional zero-shot labels (J5 + J2)."""
    if not isinstance(algorithm, str):
        # Any pyspark.ml Estimator whose model writes ``predictionCol``
        from pyspark.ml.functions import array_to_vector
        est = algorithm
        data = df.withColumn("_v", array_to_vector(F.col(vec_col).cast("array<double>")))
        est = est.copy({est.featuresCol: "_v", est.predictionCol: "cluster_id"})
        out = est.fit(data).transform(data).drop("_v").withColumn("cluster_id", F.col("cluster_id").cast("long")) \
            .withColumn("cluster_conf", F.lit(None).cast("double"))
        out = cluster_keyword_labels(out, top_k)
        if zero_shot:
            from linkloom.operators.joins import attach_cluster_label
            z = score_labels(out, candidate_labels)
            out = attach_cluster_label(out, z.select("cluster_id", "zero_shot_label"), label_col="zero_shot_label")
        return out
    algo = algorithm.lower()
    if algo == "kmeans":
        out, _ = kmeans(df, vec_col, n_clusters, seed)
    elif algo in ("density", "hdbscan", "dbscan"):
        lab = density_cluster(df, eps, min_samples, min_cluster_size, id_col, vec_col)
        lab = density_confidence(lab, id_col)
        out = df.join(lab.select(id_col, "cluster_id", "cluster_conf"), id_col)
    else:
        raise ValueError(f"Unsupported clustering algorithm: {algorithm}")
    out = cluster_keyword_labels(out, top_k)
    if zero_shot:
        from linkloom.operators.joins import attach_cluster_label
        z = score_labels(out, candidate_labels)
        out = attach_cluster_label(out, z.select("cluster_id", "zero_shot_label"), label_col="zero_shot_label")
    return out
