"""Registered queries give the same rows whatever the shuffle parallelism
"""

import math

import pytest

NAMES = [
    "p1_url_domain", "p8_base_title", "p13_folder_label", "p17_text_similarity", "s1_read_onetab",
    "s2_read_netscape", "a1_dedup_entries", "a2_domain_sizes", "w1_sample_per_domain", "w2_interleave_by_domain",
    "w3_crawl_schedule", "w7_top_domains", "t9_apply_filters", "t17_clean_entries", "a7_fit_boilerplate",
    "a8_disjoint_phrases", "j4_remove_boilerplate", "h1_visible_text", "h2_main_content", "h4_page_summary",
    "w4_keywords_tfidf", "w4_keywords_embedding", "w6_refine_keywords", "a14_ctfidf", "m1_encode_hash",
    "j7_assign_to_clusters", "j8_knn", "m8_density_cluster", "a11_cluster_keyword_labels", "j5_score_labels",
]


def _norm(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6)
    if isinstance(v, (list, tuple)):
        return tuple(_norm(x) for x in v)
    return v


def _rows(df):
    return sorted((tuple(_norm(x) for x in r) for r in df.collect()), key=repr)


@pytest.mark.parametrize("name", NAMES)
def test_same_rows_at_any_parallelism(spark, sf, name):
    import __spark_entry__ as entry
    q = entry.queries()[name]
    old = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "3")
        a = _rows(q(spark, sf))
        spark.conf.set("spark.sql.shuffle.partitions", "17")
        b = _rows(q(spark, sf))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
    assert a == b
