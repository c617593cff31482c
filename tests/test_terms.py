"""Best terms without all their frequencies, and scores within the row."""

import random

import numpy as np
from pyspark.sql import functions as F

from linkloom.operators import html as H
from linkloom.operators import keywords as K


def _docs(spark):
    r = random.Random(7)
    words = [f"w{int(r.paretovariate(0.6)) % 400}" for _ in range(4000)]
    rows = [(i if i % 10 else i // 20, " ".join(r.choices(words, k=r.randint(0, 60)))) for i in range(150)]
    return spark.createDataFrame([*rows, (None, "w1 w2"), (500, None), (501, "")], "pos long, text string")


def _plain(scores):
    return {(r["id"], r["rank"]): (r["gram"], round(r["score"], 9)) for r in K.top_keywords(scores, 5).collect()}


def test_best_terms_are_those_of_all_frequencies(spark, monkeypatch):
    d = _docs(spark)
    want = _plain(K.tfidf_scores(d, "pos", "text", normalize=False))
    for known, ask in ((50_000, 32), (20, 6), (0, 1)):
        monkeypatch.setattr(K, "KNOWN", known)
        monkeypatch.setattr(K, "ASK", ask)
        got = K.best_terms(d, "pos", "text", 5).collect()
        assert {(r["id"], r["rank"]): (r["gram"], round(r["score"], 9)) for r in got} == want and len(got) == len(want)


def test_embedding_scores_of_shared_and_single_ids_agree(spark):
    d = _docs(spark)
    want = {(r["id"], r["gram"]): r["score"] for r in K._embedding_joined(d, "pos", "text", (1, 2), 384, None).collect()}
    got = {(r["id"], r["gram"]): r["score"] for r in K.embedding_scores(d, "pos", "text").collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 2e-9 for k in want)
    packed = K.embedding_scores(d, "pos", "text", packed=True)
    assert _plain(packed) == _plain(K.embedding_scores(d, "pos", "text"))
    long = packed.select("id", F.explode("scores").alias("s")).select("id", "s.gram", "s.score")
    rows = lambda x: sorted(tuple(r) for r in x.collect())
    assert rows(K.mmr(packed, 5, 0.5)) == rows(K.mmr(long, 5, 0.5))


def test_single_documents_are_scored_without_moving_their_candidates(spark):
    d = spark.range(20).select(F.col("id").alias("pos"), F.concat(F.lit("alpha beta "), F.col("id").cast("string")).alias("text"))
    plan = K.mmr(K.embedding_scores(d, "pos", "text", packed=True))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan


def test_elements_leave_a_batch_in_bounded_frames(spark, monkeypatch):
    import pandas as pd
    monkeypatch.setattr(H, "FRAME_ROWS", 50)
    html = "<html><body>" + "<p>some words here</p>" * 300 + "</body></html>"
    frames = list(H.element_frames([pd.DataFrame({"page_id": [1, 2, 3], "html": [html, None, html]})], "page_id", "html", True))
    whole = pd.concat(frames)
    assert max(map(len, frames)) <= 50 and len(whole) >= 600
    assert set(whole["page_id"]) == {1, 3} and not whole.duplicated(["page_id", "seq"]).any()


def test_hashed_candidates_of_a_worker_are_hashed_once(monkeypatch):
    import hashlib
    from linkloom.operators import vectors as V
    made = []
    monkeypatch.setattr(K, "md5", lambda x: made.append(x) or hashlib.md5(x))
    monkeypatch.setattr(K, "_hashes", {})
    grams = ["alpha", "beta", "alpha beta", "beta alpha", "alpha alpha", "alpha beta gamma", "é ß", "x" * 80]
    for dim in (7, 384):
        row, at, v = K._gram_vectors(grams, dim)
        for i, g in enumerate(grams):
            dense = np.zeros(dim)
            dense[at[row == i]] = v[row == i]
            norm = np.linalg.norm(dense)
            assert np.allclose(dense / (norm or 1.0), V.py_encode(g, dim))
    # a long feature is not kept
    assert len(made) == len(set(made)) + 1
    monkeypatch.setattr(K, "KNOWN_HASHES", 3)
    monkeypatch.setattr(K, "_hashes", {})
    assert K._codes(grams) == K._codes(grams) and len(K._hashes) <= 4
