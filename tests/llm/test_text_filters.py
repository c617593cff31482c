"""Decontamination, toxicity and the pipeline."""

import random

import numpy as np

import corpus_pipeline
from linkloom.llm import decontaminate as C
from linkloom.llm import toxicity as T
from linkloom.llm.common import stage, table
from test_dedup import python_dedup, python_fp
from linkloom.llm import simhash_gray as G


def edit(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a):
        new = [i + 1]
        for j, y in enumerate(b):
            new.append(min(row[j] + (x != y), row[j + 1] + 1, new[j] + 1))
        row = new
    return row[-1]


def test_edit_distances():
    rng = np.random.default_rng(0)
    a, b = rng.integers(0, 4, (50, 9)), rng.integers(0, 4, (50, 9))
    assert C.edit_distances(a, b).tolist() == [edit(x, y) for x, y in zip(a.tolist(), b.tolist())]


def test_items_are_found_with_edits(spark):
    rng = random.Random(8)
    vocabulary = [f"w{i}" for i in range(60)]
    items = [(i, " ".join(rng.choice(vocabulary) for _ in range(rng.randint(5, 40)))) for i in range(25)]
    docs = [(0, None), (1, ""), (2, "- ... !"), (3, items[3][1]), (3, items[3][1])]
    for d in range(4, 150):
        w = [rng.choice(vocabulary) for _ in range(rng.randint(0, 50))]
        if d % 2:
            c = items[rng.randrange(25)][1].split()
            for _ in range(rng.randint(0, len(c) // 4)):
                p = rng.randrange(len(c))
                c[p:p + rng.randint(0, 1)] = rng.choice([[], ["zz"], [rng.choice(vocabulary)]])
            at = rng.randint(0, len(w))
            w[at:at] = c
        docs.append((d, " ".join(x.upper() + "," if rng.random() < 0.1 else x for x in w)))
    docs += [(None, items[5][1]), (900, "filler " * 50000 + items[6][1])]
    bench = spark.createDataFrame([*items, (30, None), (31, "too few"), (None, "a b c d e f"), (32, items[0][1])], "item_id long, text string")
    df = spark.createDataFrame([(*r, 1, "x") for r in docs], "doc_id long, text string, item_id long, t string").repartition(3)
    want = {}
    for n, (d, t) in enumerate(docs):
        w = C.item_words(t)
        if d == 900:
            continue
        for i, it in [*items, (32, items[0][1])]:
            iw = it.split()
            limit = int(0.2 * len(iw) + 1e-9)
            best = min(((edit(w[s:s + len(iw)], iw), s) for s in range(len(w) - len(iw) + 1)), default=(99, 0))
            if best[0] <= limit:
                want.setdefault((d, i), []).append(best)
    for block in (500_000, 200):
        got = {}
        for r in C.contaminated(df, bench, block_words=block).collect():
            got.setdefault((r["doc_id"], r["item_id"]), []).append((r["edits"], r["start_word"]))
        assert got.pop((900, 6)) == [(0, 50000)]
        assert set(got) <= set(want) and len(got) >= 0.97 * len(want)
        assert sum(got[k] == want[k] for k in got) >= 0.95 * len(got)
    kept = C.drop_contaminated(df, bench)
    assert kept.columns == df.columns
    bad = {d for d, _ in got} | {900}
    assert sorted(str(r["doc_id"]) for r in kept.collect()) == sorted(str(d) for d, _ in docs if d not in bad)
    assert C.contaminated(df.limit(0), bench).count() == 0 and C.contaminated(df, bench.limit(0)).count() == 0


def corpus(rng, n):
    plain = [f"{a}{b}" for a in ("ber", "tol", "ran", "fim", "sed", "lop") for b in ("an", "ing", "er", "os", "ut", "al")]
    bad = ["stupid", "worthless", "idiot", "pathetic", "scum"]
    rows, labels = [], []
    for i in range(n):
        w = [rng.choice(plain) for _ in range(rng.randint(5, 60))]
        y = i % 4 == 0
        if y:
            for _ in range(2):
                w.insert(rng.randrange(len(w)), rng.choice(bad))
        rows.append((i, " ".join(w)))
        labels.append((i, int(y)))
    return rows, labels


def test_toxicity(spark):
    rows, labels = corpus(random.Random(3), 600)
    extra = [(1000, None), (1001, ""), (1002, "bertol $tup1d ranan"), (1003, "beran s t u p i d toling"), (1004, "you stuuuupid ferser"),
             (1005, "beran 1d10t. toling"), (1006, "s.c.u.m sedal"), (1007, "beran toling 10.1.2.3 x" * 3), (1008, "a b c d e f " * 20000), (None, "stupid idiot")]
    df = spark.createDataFrame([(*r, 0.5, 1, "k") for r in rows + extra + [rows[0]]], "doc_id long, text string, score double, predicted int, h string").repartition(3)
    lab = spark.createDataFrame([*[(*x, 7) for x in labels], (None, 1, 7), (3, None, 7), (1, 0, 7), (1000, 9, 7)], "doc_id long, toxic int, y int")
    model = T.train(df, lab)
    got = T.score_toxicity(df, model).collect()
    assert len(got) == len(rows) + len(extra) + 1
    p = {r["doc_id"]: r for r in got}
    truth = dict(labels)
    held = [r for r in got if r["held_out"]]
    assert len(held) > 80 and np.mean([r["predicted"] == truth.get(r["doc_id"], r["predicted"]) for r in held]) > 0.97
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in got)
    assert [p[i]["predicted"] for i in (1000, 1001, 1002, 1003, 1004, 1005, 1006, 1007)] == [0, 0, 1, 1, 1, 1, 1, 0]
    assert p[None]["predicted"] == 1 and p[None]["held_out"] is False
    kept = T.drop_toxic(df, model)
    assert kept.columns == df.columns and kept.count() == sum(r["predicted"] == 0 for r in got)
    none = T.train(df, lab.limit(0))
    assert {r["score"] < 0.01 for r in T.score_toxicity(df, none).collect()} == {True}
    assert T.score_toxicity(df.limit(0), T.train(df.limit(0), lab)).count() == 0


def test_pipeline_stages(spark):
    """Each stage on its own input, against brute force."""
    sf = "/root/testdata/sf0.001"
    docs = table(spark, sf, "documents")
    outs = []
    for name, step in corpus_pipeline.STAGES:
        outs.append((docs, stage(step(spark, docs, sf), f"test-{name}")))
        docs = outs[-1][1]
    rows = lambda d: [(r["doc_id"], r["text"]) for r in d.collect()]
    assert all(o.columns == outs[0][0].columns for _, o in outs[:-1])
    before, after = rows(outs[0][0]), rows(outs[0][1])
    predicted = dict(map(tuple, T.score_toxicity(outs[0][0], T.train(outs[0][0], table(spark, sf, "labels"))).select("doc_id", "predicted").collect()))
    assert sorted(after) == sorted(r for r in before if not predicted[r[0]])
    a = np.array([python_fp(t) for _, t in after], dtype=np.uint64)
    f = G.Forest(len(a))
    f.link(*np.nonzero(np.bitwise_count(a[:, None] ^ a[None, :]) <= 3))
    root = f.roots(np.arange(len(a)))
    assert sorted(rows(outs[1][1])) == sorted(min(r for r, g in zip(after, root) if g == c) for c in set(root))
    kept, cut = rows(outs[1][1]), dict(rows(outs[2][1]))
    for d, n, gone, sha in python_dedup(kept, 13):
        if gone == n and n:
            assert d not in cut
        else:
            import hashlib
            assert hashlib.sha256(b" ".join(cut[d].encode().split())).hexdigest() == sha
    bench = [C.item_words(r["text"]) for r in table(spark, sf, "benchmark").collect()]
    held = {d for d, t in cut.items() for i in bench if f" {' '.join(i)} " in f" {' '.join(C.item_words(t))} "}
    left = {d for d, _ in rows(outs[3][1])}
    assert left <= set(cut) - held and len(set(cut) - held - left) <= 3
    ends = {}
    for r in outs[4][1].collect():
        ends[r["doc_id"]] = ends.get(r["doc_id"], 0) + r["length"]
        assert r["offset"] + r["length"] <= 1024
    assert set(ends) == left
    assert corpus_pipeline.run(spark, sf).count() == outs[4][1].count()
