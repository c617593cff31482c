"""Topics of the density hierarchy, and their merging."""

import random

import numpy as np
import pytest

from linkloom.operators import topics as TP


def plain_merge(vectors, k):
    """Nearest pair first; equal distances by ids."""
    ids = sorted(vectors)
    part = {i: i for i in ids}
    pairs = sorted((float(np.sqrt(((np.array(vectors[a]) - np.array(vectors[b])) ** 2).sum())), a, b)
                   for a in ids for b in ids if a < b)
    for _, a, b in pairs:
        if len(set(part.values())) <= k:
            break
        lo, hi = sorted((part[a], part[b]))
        part = {i: lo if p == hi else p for i, p in part.items()}
    return part


@pytest.mark.parametrize("k", [1, 4, 30])
def test_merging_is_nearest_pair_first(spark, k):
    rng = np.random.default_rng(k)
    vectors = {int(i): rng.normal(0, 1, 3).round(1).tolist() for i in rng.choice(500, 24, replace=False)}
    vectors |= {600: vectors[min(vectors)], 601: vectors[min(vectors)]}
    df = spark.createDataFrame(list(vectors.items()), "topic_id long, vec array<double>")
    got = {r["topic_id"]: r["merged"] for r in TP.merge_topics(df, k).collect()}
    assert got == plain_merge(vectors, k)


def test_density_topics_have_outliers_and_merge(spark):
    rng = random.Random(1)
    kinds = [["bread", "oven", "flour", "yeast"], ["goal", "match", "league", "coach"], ["chord", "guitar", "tune", "drum"]]
    rows = []
    for i in range(45):
        w = kinds[i % 3]
        rows.append((i, " ".join(w + [rng.choice(w) for _ in range(6)])))
    rows += [(100 + i, " ".join(f"odd{i}{k}" for k in range(8))) for i in range(5)] + [(200, None), (201, "")]
    df = spark.createDataFrame(rows, "pos long, text string")
    assign, words = TP.topics(df, "pos", "text", None, algorithm="density", min_topic_size=8, dim=64)
    got = {r["pos"]: (r["topic_id"], r["topic_prob"]) for r in assign.collect()}
    assert len(got) == 52 and len({got[i][0] for i in range(45)}) == 3
    assert all(got[i][0] == got[i + 3][0] for i in range(42)) and all(got[i][1] > 0 for i in range(45))
    # rows of no topic: outliers, or on the edge of a topic
    out = [i for i in range(100, 105) if got[i] == (-1, 0.0)]
    assert out and all(got[i][1] < 0.7 for i in range(100, 105))
    top = {}
    for r in words.collect():
        top.setdefault(r["topic_id"], []).append(r["word"])
    assert set(top) == {got[i][0] for i in range(3)} and set(kinds[1]) & set(top[got[1][0]])
    two, _ = TP.topics(df, "pos", "text", 2, algorithm="density", min_topic_size=8, dim=64)
    assert len({r["topic_id"] for r in two.collect()} - {-1}) == 2
    kept = {r["pos"]: r for r in TP.attach_topics(df, assign, words).collect()}
    assert kept[out[0]]["topic_id"] == -1 and kept[out[0]]["topic_keywords"] == [] and kept[0]["topic_keywords"]
    with pytest.raises(ValueError):
        TP.topics(df, "pos", "text", 2, algorithm="other")


def test_texts_are_encoded_once(spark, monkeypatch):
    """The fit, the confidence and the result of k-means topics read kept vectors; the caller reads written rows."""
    from linkloom.operators import vectors as V
    made, seen = V.encode, []

    def counted(df, *a):
        out = made(df, *a)
        counter = spark.sparkContext.accumulator(0)
        seen.append(counter)
        return out.rdd.map(lambda r: (counter.add(1), r)[1]).toDF(out.schema)

    monkeypatch.setattr(V, "encode", counted)
    df = spark.createDataFrame([(i, f"word{i % 3} bread{i % 3} tune{i % 3} odd{i}") for i in range(60)], "pos long, text string").repartition(3)
    assign, words = TP.topics(df, "pos", "text", 3)
    assert assign.count() == 60 and assign.select("topic_id").distinct().count() == 3 and words.count() > 0
    assert [c.value for c in seen] == [60]


def test_features_are_hashed_once(spark):
    from linkloom.operators import vectors as V
    df = spark.createDataFrame([(1, "Bread and bread oven"), (2, None), (3, ""), (4, "odd words, odd Words"), (4, "more")], "pos long, text string")
    enc = V.encode(df, "pos", "text", 16, "vec")
    assert enc._jdf.queryExecution().optimizedPlan().toString().count("md5(") == 1
    got = {(r["pos"], r["text"]): r["vec"] for r in enc.collect()}
    for key in ((1, "Bread and bread oven"), (2, None), (3, "")):
        assert np.allclose(got[key], V.py_encode(key[1], 16))
    assert got[4, "more"] == got[4, "odd words, odd Words"] and abs(np.linalg.norm(got[4, "more"]) - 1) < 1e-12
