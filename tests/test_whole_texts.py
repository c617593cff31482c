"""Queries over whole texts where the original keeps a first part."""

from linkloom.plans.registry import load_all

QUERIES, _ = load_all()


def test_long_documents_are_not_overcleaned_for_their_length(spark, tmp_path):
    long = " ".join(f"word{i}x river" for i in range(20_000))
    spark.createDataFrame([(1, long), (2, "1 2 3 " * 50), (3, "plain river words here")], "doc_id long, text string").write.parquet(
        f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: r for r in QUERIES["t16_overcleaned_whole"](spark, str(tmp_path)).collect()}
    assert [got[i]["overcleaned"] for i in (1, 2, 3)] == [False, True, False]
    assert got[1]["n_clean"] > 0.9 * len(long)
    cut = {r["doc_id"]: r for r in QUERIES["t16_overcleaned"](spark, str(tmp_path)).collect()}
    assert cut[1]["overcleaned"] and cut[3]["n_clean"] == got[3]["n_clean"]


def test_long_pages_are_read_whole(spark, tmp_path):
    html = "<html><body>" + "".join(f"<p>Sentence number {i} of the page.</p>" for i in range(1200)) + "</body></html>"
    spark.createDataFrame([(1, "http://a.org/", html)], "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    get = lambda name, col: QUERIES[name](spark, str(tmp_path)).first()[col]
    assert "number 1199 " in get("h1_visible_text", "visible_text")
    assert "number 1199 " not in get("h1_visible_text_limited", "visible_text")
    assert "number 1199 " in get("h2_main_content", "main_text")
    assert len(get("h2_main_content_limited", "main_text").split()) <= 400
