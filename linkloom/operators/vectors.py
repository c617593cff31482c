"""Vectors (M1-M5): hashing text encoder, random projection, hybrid
embedding, numeric feature scaling, feature table.

The default encoder is deterministic feature hashing done with SQL
aggregates: words -> 1-2-grams -> md5 bucket and sign -> per-row sums ->
L2 norm.  Model encoders plug in as Arrow-batched pandas UDFs.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType

from linkloom.functions import urls as U

WORD = r"[\p{L}\p{N}_]+"


def hash_features(text: Column) -> Column:
    """Lower-cased words and adjacent word pairs (the hashed features)."""
    words = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(WORD), 0)
    pairs = F.filter(F.zip_with(words, F.slice(words, 2, F.greatest(F.size(words), F.lit(1))),
                                lambda a, b: F.when(b.isNotNull(), F.concat(a, F.lit(" "), b))),
                     lambda g: g.isNotNull())
    return F.concat(words, pairs)


def bucket_of(feature: Column, dim: int, hashed: bool = False) -> Column:
    """md5 bucket of a feature (``hashed``: the column already holds md5 hex)."""
    h = feature if hashed else F.md5(feature)
    return (F.conv(F.substring(h, 1, 8), 16, 10).cast("bigint") % dim).cast("int")


def sign_of(feature: Column, hashed: bool = False) -> Column:
    h = feature if hashed else F.md5(feature)
    return F.when(F.conv(F.substring(h, 9, 2), 16, 10).cast("int") % 2 == 0, F.lit(1.0)).otherwise(F.lit(-1.0))


def _bucket_sums(df: DataFrame, id_col: str, text_col: str, dim: int) -> DataFrame:
    """(id, bucket, v): signed counts of the hashed features, zeros left out."""
    # one md5 per feature, projected before the aggregation
    feats = df.select(F.col(id_col).alias("id"), F.explode(hash_features(F.col(text_col))).alias("f")) \
        .select("id", F.md5("f").alias("h"))
    sums = feats.select("id", bucket_of(F.col("h"), dim, True).alias("bucket"), sign_of(F.col("h"), True).alias("s")) \
        .groupBy("id", "bucket").agg(F.sum("s").alias("v"))
    return sums.filter(F.col("v") != 0)


def encode_sparse(df: DataFrame, id_col: str, text_col: str, dim: int = 384) -> DataFrame:
    """M1 (sparse form): (id, bucket, value) of the L2-normalised hashed vector.

    Two aggregations: per (id, bucket) sums (combined map-side), then the
    per-id norm via a window bounded by ``dim`` rows per id.
    """
    sums = _bucket_sums(df, id_col, text_col, dim)
    norms = sums.groupBy("id").agg(F.sqrt(F.sum(F.col("v") * F.col("v"))).alias("norm"))
    return sums.join(norms, "id").select(F.col("id").alias(id_col), "bucket", (F.col("v") / F.col("norm")).alias("value"))


@F.pandas_udf(ArrayType(DoubleType()))
def _scatter(idx, val, dim):
    """(indices, values) -> dense vector; one NumPy scatter per row of an Arrow batch."""
    import pandas as pd
    out = []
    for i, v, d in zip(idx, val, dim):
        x = np.zeros(int(d))
        if i is not None and len(i):
            x[np.asarray(i, dtype=np.int64)] = np.asarray(v, dtype=float)
        out.append(x)
    return pd.Series(out)


@F.pandas_udf(ArrayType(DoubleType()))
def _unit_scatter(idx, val, dim):
    """(indices, values) -> dense vector of length 1."""
    import pandas as pd
    out = []
    for i, v, d in zip(idx, val, dim):
        x, v = np.zeros(int(d)), np.asarray(v, dtype=float)
        x[np.asarray(i, dtype=np.int64)] = v / np.sqrt((v * v).sum())
        out.append(x)
    return pd.Series(out)


def to_dense(sparse: DataFrame, id_col: str, dim: int, out_col: str = "vector") -> DataFrame:
    """(id, bucket, value) -> (id, array<double>[dim]); ids without features
    are absent (``encode`` fills zero vectors).  Per-id lists are bounded by
    ``dim``; Spark has no scatter expression, so the scatter is an Arrow
    pandas UDF (linear in dim + nnz)."""
    m = sparse.groupBy(id_col).agg(F.collect_list("bucket").alias("_i"), F.collect_list("value").alias("_v"))
    return m.select(id_col, _scatter(F.col("_i"), F.col("_v"), F.lit(dim)).alias(out_col))


def zero_vector(dim: int) -> Column:
    return F.array_repeat(F.lit(0.0), dim)


def encode(df: DataFrame, id_col: str, text_col: str, dim: int = 384, out_col: str = "vector") -> DataFrame:
    """M1: df + dense hashed embedding of ``text_col`` (zero vector for empty text).

    The norm is taken from a row's own list of sums (whole numbers, so exact in any order):
    a join with norms would hash every feature a second time."""
    lists = _bucket_sums(df, id_col, text_col, dim).groupBy("id").agg(
        F.collect_list("bucket").alias("_i"), F.collect_list("v").alias("_v"))
    dense = lists.select(F.col("id").alias(id_col), _unit_scatter(F.col("_i"), F.col("_v"), F.lit(dim)).alias("_vec"))
    return df.join(dense, id_col, "left").withColumn(out_col, F.coalesce("_vec", zero_vector(dim))).drop("_vec")


def py_encode(text: str, dim: int = 384) -> np.ndarray:
    """The same hashing in Python (used per group by MMR and in tests)."""
    import regex
    words = regex.findall(r"[\p{L}\p{N}_]+", (text or "").lower())
    feats = words + [f"{a} {b}" for a, b in zip(words, words[1:])]
    v = np.zeros(dim)
    for f in feats:
        h = hashlib.md5(f.encode("utf-8")).hexdigest()
        v[int(h[:8], 16) % dim] += 1.0 if int(h[8:10], 16) % 2 == 0 else -1.0
    n = np.linalg.norm(v)
    return v / n if n > 0 else v


def projection_matrix(dim_in: int, dim_out: int, seed: int = 42) -> np.ndarray:
    """Gaussian random projection N(0, 1/dim_out), seeded (Q17)."""
    rng = np.random.default_rng(seed)
    return rng.normal(0.0, 1.0 / np.sqrt(dim_out), size=(dim_in, dim_out))


def random_project(df: DataFrame, col: str, dim_in: int, dim_out: int, seed: int = 42,
                   out_col: str | None = None) -> DataFrame:
    """M2: multiply every vector by a seeded constant matrix, one NumPy matmul
    per Arrow batch (the matrix is rebuilt from the seed in each task)."""
    out_col = out_col or col

    @F.pandas_udf(ArrayType(DoubleType()))
    def proj(vs):
        import pandas as pd
        m = projection_matrix(dim_in, dim_out, seed)
        if len(vs) == 0:
            return pd.Series([], dtype=object)
        x = np.vstack([np.asarray(v, dtype=float) for v in vs])
        return pd.Series(list(x @ m))
    return df.withColumn(out_col, proj(F.col(col)))


def meta_text(title: Column, domain: Column, keywords_text: Column) -> Column:
    from linkloom.functions.text import meta_text as mt
    return mt(title, domain, keywords_text)


def hybrid_embedding(df: DataFrame, id_col: str = "pos", dim: int = 384, seed: int = 42,
                     content_tokens: int | None = None, meta_weight: float = 1.0, content_weight: float = 0.4,
                     out_col: str = "embedding") -> DataFrame:
    """M3: [meta_weight * enc(meta_text), content_weight * project(enc(content))].

    content_tokens: head of the content in tokens (None: all of it)."""
    from linkloom.functions.text import content_head
    kt = F.col("keywords_text") if "keywords_text" in df.columns else F.lit("")
    base = df.withColumn("_meta", meta_text(F.col("title"), F.col("domain"), kt)) \
        .withColumn("_content", content_head(F.coalesce(F.col("contents"), F.lit("")), content_tokens))
    e = encode(base, id_col, "_meta", dim, "_mv")
    e = encode(e, id_col, "_content", dim, "_cv")
    e = random_project(e, "_cv", dim, dim // 3, seed, "_cp")
    emb = F.concat(F.transform("_mv", lambda x: x * meta_weight), F.transform("_cp", lambda x: x * content_weight))
    return e.withColumn(out_col, emb).drop("_meta", "_content", "_mv", "_cv", "_cp")


def combine_numeric(df: DataFrame, emb_col: str = "embedding", out_col: str = "features",
                    numeric=("path_depth", "days_since_epoch"), categorical=("is_subdomain",),
                    stats_from: DataFrame | None = None) -> DataFrame:
    """M4: standardise numeric columns (population std; constant -> 0; null ->
    mean, i.e. 0), append categorical as is, concatenate to the embedding.
    The statistics are one global aggregate (two numbers per column), taken
    from ``stats_from`` when given - a lighter DataFrame with the same
    numeric columns, so the embedding lineage is not computed twice."""
    numeric = [c for c in numeric if c in df.columns]
    categorical = [c for c in categorical if c in df.columns]
    if not numeric and not categorical:
        return df.withColumn(out_col, F.col(emb_col))
    src = (stats_from if stats_from is not None else df).select(*numeric) if numeric else None
    stats = src.agg(*[F.avg(c).alias(f"{c}__m") for c in numeric],
                    *[F.stddev_pop(c).alias(f"{c}__s") for c in numeric]).collect()[0] if numeric else None
    parts = []
    for c in numeric:
        m, s = stats[f"{c}__m"], stats[f"{c}__s"]
        if m is None:
            parts.append(F.lit(0.0))
            continue
        scale = s if s and s > 0 else 1.0
        parts.append(F.coalesce(((F.col(c) - F.lit(m)) / F.lit(scale)).cast("double"), F.lit(0.0)))
    parts += [F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in categorical]
    return df.withColumn(out_col, F.concat(F.col(emb_col), F.array(*parts)))


FEATURE_INFO = {
    "keywords_text": "keywords of the page in one string",
    "path_depth": "how many parts the path of the url has",
    "is_subdomain": "true when the host is below a registered domain",
    "days_since_epoch": "entry date as a day number",
}


def with_features(df: DataFrame, include=("keyword", "path", "subdomain", "date")) -> DataFrame:
    """Add only the named feature groups; descriptions go to the
    column metadata."""
    cols = {}
    if "path" in include:
        cols["path_depth"] = U.path_depth(F.col("url"))
    if "subdomain" in include:
        cols["is_subdomain"] = U.is_subdomain(F.col("domain"))
    if "date" in include and "date" in df.columns:
        cols["days_since_epoch"] = U.days_since_epoch(F.col("date"))
    out = df.withColumns(cols) if cols else df
    for name in cols:
        out = out.withMetadata(name, {"description": FEATURE_INFO[name]})
    if "keyword" in include and "keywords_text" in out.columns:
        out = out.withMetadata("keywords_text", {"description": FEATURE_INFO["keywords_text"]})
    return out


def build_features(df: DataFrame, include=("keyword", "path", "subdomain", "date"), dim: int = 384,
                   seed: int = 42, id_col: str = "pos") -> DataFrame:
    """M5: entries (+ clean_text, keywords) -> base columns -> P19 -> M3 -> M4."""
    from linkloom.functions.text import entry_content, keywords_text, raw_keywords
    base = df.withColumn("contents", entry_content(df))
    if "keywords" in df.columns:
        base = base.withColumn("keywords_text", keywords_text(F.col("keywords"))) \
            .withColumn("raw_keywords", raw_keywords(F.col("keywords")))
    else:
        base = base.withColumn("keywords_text", F.lit("")).withColumn("raw_keywords", F.lit("{}"))
    feats = with_features(base, include)
    emb = hybrid_embedding(feats, id_col=id_col, dim=dim, seed=seed)
    return combine_numeric(emb, stats_from=feats)
