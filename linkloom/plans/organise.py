"""The whole organiser as one lineage of DataFrame transforms.

entries -> dedup (A1) -> page text (J1 + P16 + H1 + H6) -> boilerplate fit
(A7) -> cleaning with boilerplate removal (T17) -> keywords (W4 + W6) ->
features (M5) -> clustering and labels (M12).  Lineage is cut after the text
join, the cleaning and the features (stage cache when ``cache_root`` is set,
else a reliable checkpoint).
"""

from __future__ import annotations

from dataclasses import asdict

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkloom.config import Settings
from linkloom.functions import text as T
from linkloom.functions import urls as U
from linkloom.operators import boilerplate as B
from linkloom.operators import clean as C
from linkloom.operators import cluster as CL
from linkloom.operators import entries as E
from linkloom.operators import html as H
from linkloom.operators import keywords as K
from linkloom.operators import topics as TP
from linkloom.operators import vectors as V
from linkloom.session import cut_lineage


def page_texts(pages: DataFrame, max_strings: int | None = None) -> DataFrame:
    """(url, scraped): visible text folded to ASCII; challenge pages and
    failed pages give ''; one text per url (lowest page_id)."""
    from linkloom.sources.pages import split_challenge_pages
    good, _ = split_challenge_pages(pages)
    vis = H.visible_text(good, max_strings)
    if "kind" in good.columns:
        # plain text is not parsed as markup
        plain = good.select("page_id", F.when(F.col("kind") == "text", F.col("html")).alias("_plain"))
        vis = vis.join(plain, "page_id").withColumn("visible_text", F.coalesce("_plain", "visible_text")).drop("_plain")
    # the winner of a url is picked on narrow rows; texts meet it by page_id
    first = good.groupBy("url").agg(F.min("page_id").alias("page_id"))
    return vis.join(first, "page_id").select("url", T.to_ascii(F.col("visible_text")).alias("scraped"))


def _stage(df: DataFrame, name: str, cache_root: str | None, fp: str | None, cfg: Settings) -> DataFrame:
    if cache_root:
        from linkloom.sources.sinks import StageCheckpoint
        return StageCheckpoint(cache_root, data_only=False).run(name, fp, lambda: df, settings=asdict(cfg))
    return cut_lineage(df)


def organise(entries: DataFrame, pages: DataFrame, cfg: Settings | None = None, algorithm: str = "hdbscan",
             zero_shot: bool = False, candidate_labels=None, cache_root: str | None = None,
             backend: str | None = None) -> DataFrame:
    """The organiser over ``entries`` and crawled ``pages`` (see the module text).

    backend: where keywords come from (else ``cfg.keyword_backend``): "tfidf" or "embedding"
    (both with maximal marginal relevance when ``cfg.keyword_diversity`` is set), or
    "topics": the words of each entry's topic, with columns topic_id and topic_prob."""
    cfg = cfg or Settings()
    fp = None
    if cache_root:
        from linkloom.sources.sinks import corpus_fingerprint
        # the key holds the entries, the pages with their content, and the settings
        fp = corpus_fingerprint(entries, *[c for c in ("pos", "url", "title", "date", "folder") if c in entries.columns]) \
            + corpus_fingerprint(pages, "page_id", "url", "html")
    ents = E.dedup_entries(entries)
    scraped = _stage(ents.join(page_texts(pages), "url", "left"), "scraped", cache_root, fp, cfg)
    bp = B.fit_boilerplate(scraped, "scraped", cfg.min_domain_size, cfg.domain_samples, cfg.phrase_freq,
                           cfg.ngram_range)
    cleaned = C.clean_entries(scraped, bp, max_tokens=cfg.max_tokens, sequence=cfg.filter_sequence)
    cleaned = _stage(cleaned, "cleaned", cache_root, fp, cfg)
    docs = cleaned.select("pos", T.title_plus_text(U.base_title(F.col("title"), F.col("domain")),
                                                    F.col("clean_text")).alias("kw_text"))
    kw = _with_keywords(docs, cleaned, cfg, backend or cfg.keyword_backend)
    feats = _stage(V.build_features(kw, cfg.features, cfg.hash_dim, cfg.seed), "embeddings", cache_root, fp, cfg)
    if algorithm == "kmeans":
        out = CL.cluster_and_label(feats, "kmeans", "features", "pos", n_clusters=cfg.n_clusters, seed=cfg.seed,
                                   zero_shot=zero_shot, candidate_labels=candidate_labels)
    elif algorithm in ("hdbscan", "density"):
        out = _density_pipeline(feats, cfg, zero_shot, candidate_labels)
    else:
        raise ValueError(f"Unsupported clustering algorithm: {algorithm}")
    keep = [c for c in ("pos", "url", "title", "domain", "date", "group_ids", "folder", "clean_text",
                        "keywords_text", "topic_id", "topic_prob", "raw_keywords", "path_depth", "is_subdomain", "days_since_epoch",
                        "cluster_id", "cluster_conf", "cluster_label", "zero_shot_label") if c in out.columns]
    return out.select(*keep)


def _with_keywords(docs: DataFrame, cleaned: DataFrame, cfg: Settings, backend: str) -> DataFrame:
    """``cleaned`` with column ``keywords`` from the chosen backend."""
    if backend == "topics":
        assign, words = TP.topics(docs, "pos", "kw_text", cfg.nr_topics, dim=cfg.hash_dim, seed=cfg.seed,
                                  top_n=cfg.top_k, algorithm="density", min_topic_size=cfg.min_cluster_size,
                                  min_samples=cfg.effective_min_samples)
        return TP.attach_topics(cleaned, assign, words, "pos", cfg.topic_threshold).withColumnRenamed("topic_keywords", "keywords")
    found = K.keywords(docs, "pos", "kw_text", cfg.top_k, scorer=backend, dim=cfg.hash_dim, diversity=cfg.keyword_diversity)
    kw = K.keyword_arrays(found, cleaned, "pos", "raw_kw")
    return kw.withColumn("keywords", K.refine_keywords(F.col("raw_kw"), 0.2)).drop("raw_kw")


def _density_pipeline(feats: DataFrame, cfg: Settings, zero_shot: bool, candidate_labels) -> DataFrame:
    """The default: clusters of the density hierarchy by excess of mass (M9), with
    membership strengths (M10)."""
    lab = CL.density_hierarchy(feats, cfg.effective_min_samples, cfg.min_cluster_size, "pos", "features")
    conf = feats.join(cut_lineage(lab), "pos")
    out = CL.cluster_keyword_labels(conf)
    if zero_shot:
        from linkloom.operators.joins import attach_cluster_label
        z = CL.score_labels(out, candidate_labels)
        out = attach_cluster_label(out, z.select("cluster_id", "zero_shot_label"), label_col="zero_shot_label")
    return out
