"""Pivot index, spanning tree, condensed tree and assignment against plain versions."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from linkloom.operators import hierarchy as HI
from linkloom.operators import metric as M

SCHEMA = "id long, vector array<double>"


def blobs(seed, n, dim=3, copies=True):
    rng = np.random.default_rng(seed)
    out = []
    centres = rng.normal(0, 12, (5, dim))
    for i in range(n):
        c = rng.integers(0, 6)
        x = rng.uniform(-25, 25, dim) if c == 5 else centres[c] + rng.normal(0, 0.3 + c * 0.5, dim)
        out.append(np.round(x, 2 if rng.random() < 0.7 else 0).tolist())
        if copies and rng.random() < 0.1:
            out += [out[rng.integers(0, len(out))]] * int(rng.integers(1, 4))
    return out


def table(spark, vectors, ids=None):
    return spark.createDataFrame(list(zip(ids or range(len(vectors)), vectors)), SCHEMA).repartition(3)


def distances(x):
    x = np.array(x, dtype=float)
    return np.sqrt(((x[:, None, :] - x[None, :, :]) ** 2).sum(-1))


def plain_tree(x, min_samples, mcs):
    """(label, probability) of every row: single linkage of mutual reachability, condensed, excess of mass."""
    d = distances(x)
    n = len(x)
    core = np.sort(d, axis=1)[:, min_samples - 1]
    w = np.maximum(np.maximum(d, core[:, None]), core[None, :])
    comp = {i: i for i in range(n)}
    edges = []
    for e, i, j in sorted((w[i, j], i, j) for i in range(n) for j in range(i + 1, n)):
        if comp[i] != comp[j]:
            edges.append((e, i, j))
            old = comp[j]
            comp = {k: comp[i] if c == old else c for k, c in comp.items()}
    comp, tree = {i: (i,) for i in range(n)}, None
    node = {i: i for i in range(n)}  # a row or (lambda, left, right, rows)
    for e, i, j in edges:
        a, b = comp[i], comp[j]
        both = a + b
        tree = (1 / max(e, HI.FLOOR), node[a[0]], node[b[0]], both)
        for k in both:
            comp[k] = both
            node[k] = tree
    rows = lambda t: (t,) if isinstance(t, int) else t[3]
    clusters = []  # dict(birth, parent, own: {row: lambda}, kids)

    def grow(t, birth, parent):
        c = {"birth": birth, "parent": parent, "own": {}, "kids": [], "size": len(rows(t))}
        clusters.append(c)
        while True:
            lam, left, right, _ = t
            big = [s for s in (left, right) if len(rows(s)) >= mcs]
            if len(big) == 2:
                for s in big:
                    c["kids"].append(grow(s, lam, c))
                return c
            for s in (left, right):
                if s not in big:
                    c["own"].update({r: lam for r in rows(s)})
            if not big:
                return c
            t = big[0]

    if n < mcs or tree is None:
        return [(-1, 0.0)] * n
    import sys
    sys.setrecursionlimit(10_000)
    root = grow(tree, 0.0, None)

    def value(c):
        c["stab"] = sum(v - c["birth"] for v in c["own"].values()) + sum((k["birth"] - c["birth"]) * k["size"] for k in c["kids"])
        below = sum(value(k) for k in c["kids"])
        c["chosen"] = not c["kids"] or c["stab"] >= below
        return max(c["stab"], below) if c["kids"] else c["stab"]

    value(root)
    out = [(-1, 0.0)] * n

    def name(c, top):
        if top is None and c["chosen"] and c is not root:
            top = c
        if top is not None:
            for r, v in c["own"].items():
                peak = max([*top["own"].values(), *[k["birth"] for k in top["kids"]]])
                out[r] = (id(top), min(v, peak) / peak)
        for k in c["kids"]:
            name(k, top)

    name(root, None)
    low = {}
    for r, (c, _) in enumerate(out):
        low[c] = min(low.get(c, r), r)
    return [(low[c] if c != -1 else -1, p) for c, p in out]


@pytest.mark.parametrize("seed, n, ms, mcs, chunk, piece", [
    (1, 200, 2, 5, 16, 20), (4, 160, 3, 4, 1024, 200_000)])
def test_tree_equals_plain_tree(spark, monkeypatch, seed, n, ms, mcs, chunk, piece):
    monkeypatch.setattr(M, "VISITORS", 50)
    x = blobs(seed, n)
    t = HI.DensityTree(table(spark, x), ms, mcs, chunk=chunk, piece_edges=piece)
    got = {r["id"]: (r["cluster_id"], r["probability"]) for r in t.rows.collect()}
    want = plain_tree(x, ms, mcs)
    assert len(got) == len(x) and {v for v, _ in want} - {-1}
    assert [got[i][0] for i in range(len(x))] == [v for v, _ in want]
    assert np.allclose([got[i][1] for i in range(len(x))], [p for _, p in want])


def test_deep_chain_of_splits(spark):
    """Clusters that split off one after another: a run of single open children."""
    x, at = [], 0.0
    for i in range(12):
        x += [[at + 0.01 * (i % 3 + 1) * j] for j in range(4)]
        at += 3.0 + 0.5 * i
    t = HI.DensityTree(table(spark, x), 2, 4, piece_edges=11, chunk=8)
    assert [r["cluster_id"] for r in t.rows.orderBy("id").collect()] == [v for v, _ in plain_tree(x, 2, 4)]


def test_best_values_of_random_trees(spark):
    rng = random.Random(2)
    parent = {0: None} | {i: rng.choice([i - 1, i - 1, i - 1, rng.randrange(i)]) for i in range(1, 50)}
    birth = {0: 0.0}
    for i in range(1, 50):
        birth[i] = birth[parent[i]] + rng.random()
    rows = [(i, p, birth[i], 5) for i, p in parent.items()]
    pts = [(k, h, birth[h] + rng.random() * 4) for k, h in enumerate(h for h in parent for _ in range(rng.randint(1, 5)))]
    got = HI.choose(spark.createDataFrame(rows, "head long, parent long, birth double, size long"),
                    spark.createDataFrame(pts, "id long, head long, lam double")).collect()
    kids = {i: [k for k in parent if parent[k] == i] for i in parent}
    stab = {i: sum(v - birth[i] for _, h, v in pts if h == i) + sum(5 * (birth[k] - birth[i]) for k in kids[i]) for i in parent}
    best, chosen = {}, {}
    for i in sorted(parent, reverse=True):
        below = sum(best[k] for k in kids[i])
        chosen[i] = i > 0 and (not kids[i] or stab[i] >= below)
        best[i] = max(stab[i], below) if kids[i] else stab[i]
    label = {}
    for i in sorted(parent):
        up = label.get(parent[i])
        label[i] = up if up is not None else i if chosen[i] else None
    assert {r["head"]: r["label"] for r in got} == label
    assert np.allclose([r["stability"] for r in got], [stab[r["head"]] for r in got])


def test_spanning_tree_weight_and_neighbours(spark, monkeypatch):
    monkeypatch.setattr(M, "VISITORS", 40)
    x = blobs(7, 220)
    ids = [7 * i % 1009 for i in range(len(x))]
    index = M.Index(table(spark, x, ids), chunk=12)
    rep = {}
    for i, v in sorted(zip(ids, x)):
        rep.setdefault(tuple(v), i)
    reps = sorted((i, v) for v, i in rep.items())
    d = distances([v for _, v in reps])
    got = {}
    for r in M.neighbours(index, 3).collect():
        got.setdefault(r["q"], []).append((r["rank"], r["other"], r["d"]))
    for a, (i, _) in enumerate(reps):
        want = sorted((d[a, b], reps[b][0]) for b in range(len(reps)) if b != a)[:3]
        assert [(o, e) for _, o, e in sorted(got[i])] == [(o, e) for e, o in want]
    pairs = {(r["i"], r["j"]) for r in M.range_pairs(index, 1.5).collect()}
    assert pairs == {(reps[a][0], reps[b][0]) for a in range(len(reps)) for b in range(a + 1, len(reps)) if d[a, b] <= 1.5}
    assert M.range_pairs(index, 1.5).count() == len(pairs)
    # core distances count copies
    full = distances([v for _, v in sorted(zip(ids, x))])
    cores = {r["q"]: r["core"] for r in M.core_distances(index, 4).collect()}
    order = {i: a for a, (i, _) in enumerate(sorted(zip(ids, x)))}
    assert all(c == np.sort(full[order[i]])[3] for i, c in cores.items())


def test_compared_pairs_on_clustered_rows(spark, monkeypatch):
    """Visits are far fewer than all chunks for all rows."""
    rng = np.random.default_rng(0)
    x = (rng.normal(0, 40, (30, 16))[rng.integers(0, 30, 3000)] + rng.normal(0, 0.5, (3000, 16))).tolist()
    index = M.Index(table(spark, x), chunk=64)
    seen = []
    real = M.meet
    monkeypatch.setattr(M, "meet", lambda v, *a: (seen.append(M.written_table(v, "t")), real(seen[-1], *a))[1])
    assert M.neighbours(index, 5).count() == 15_000
    n = index.chunks.select("chunk", "n")
    compared = sum(v.join(n, "chunk").agg(F.sum("n")).first()[0] for v in seen)
    assert compared < 0.1 * 3000 ** 2


def plain_predict(x, ms, mcs, q):
    d = distances(x)
    core = np.sort(d, axis=1)[:, ms - 1]
    out = []
    for v in q:
        to = distances([v, *x])[0, 1:]
        cq = np.sort(to)[ms - 2] if ms > 1 else 0.0
        w = np.maximum(np.maximum(to, core), cq)
        out.append((int(np.argmin(w)), 1 / max(w.min(), HI.FLOOR)))
    return out


def test_new_rows_join_the_tree(spark):
    x = blobs(9, 240, copies=False)
    x = [list(v) for v in dict.fromkeys(map(tuple, x))]
    t = HI.DensityTree(table(spark, x), 3, 6, chunk=20, piece_edges=50)
    rng = np.random.default_rng(1)
    q = (np.array(x)[rng.integers(0, len(x), 60)] + rng.normal(0, 0.8, (60, 3))).tolist() + [[500.0, 0.0, 0.0]]
    rows = table(spark, [*q, None, [1.0], [float("nan")] * 3], range(1000, 1064))
    got = {r["id"]: (r["cluster_id"], r["probability"]) for r in t.predict(rows).collect()}
    assert len(got) == 64 and got[1061] == got[1062] == got[1063] == got[1060][:1] + (0.0,) == (-1, 0.0)
    tree = {r["head"]: r for r in t.clusters.collect()}
    at = {r["id"]: r["head"] for r in t.rows.collect()}
    names = {r["label"]: (r["cluster_id"], r["peak"]) for r in t.labels.collect()}
    inside = 0
    for i, (near, lam) in enumerate(plain_predict(x, 3, 6, q)):
        h = at[near]
        while tree[h]["parent"] is not None and tree[h]["birth"] >= lam:
            h = tree[h]["parent"]
        label = tree[h]["label"]
        want = (-1, 0.0) if label is None else (names[label][0], min(lam, names[label][1]) / names[label][1])
        assert got[1000 + i][0] == want[0] and math.isclose(got[1000 + i][1], want[1], abs_tol=1e-9)
        inside += label is not None
    assert inside > 15


def test_rows_that_take_no_part(spark):
    df = spark.createDataFrame([(1, [0.0, 1.0]), (2, None), (3, []), (4, [1.0]), (5, [float("inf"), 0.0]), (None, [1.0, 1.0]), (6, [2.0, 1.0])], SCHEMA)
    index = M.Index(df)
    assert sorted(r["cls"] for r in index.classes.collect()) == [1, 6]
    t = HI.DensityTree(df, 2, 5)
    assert sorted(tuple(r) for r in t.rows.select("id", "cluster_id", "probability").collect()) == [(1, -1, 0.0), (6, -1, 0.0)]
    empty = HI.DensityTree(df.limit(0), 2, 5)
    assert empty.rows.count() == 0 and M.neighbours(M.Index(df.limit(0)), 2).count() == 0
    same = HI.DensityTree(spark.createDataFrame([(i, [1.0, 1.0]) for i in range(8)], SCHEMA), 2, 5)
    assert {r["cluster_id"] for r in same.rows.collect()} == {-1}


def test_vectors_travel_once_to_a_block(spark, monkeypatch):
    """Vectors without structure visit nearly all chunks; a block holds several of them."""
    monkeypatch.setattr(M, "VISITORS", 100)
    rng = np.random.default_rng(3)
    x = rng.normal(0, 1, (900, 24)).round(3)
    index = M.Index(table(spark, x.tolist()), chunk=8)
    assert index.chunks.count() > 60 and index.wide > 2
    sent = []
    real = M.written_table
    monkeypatch.setattr(M, "written_table", lambda df, name: (sent.append((name, real(df, name))), sent[-1][1])[1])
    got = {}
    for r in M.neighbours(index, 3).collect():
        got.setdefault(r["q"], []).append((r["rank"], r["other"]))
    d = distances(x)
    for i in range(900):
        want = sorted((d[i, j], j) for j in range(900) if j != i)[:3]
        assert [o for _, o in sorted(got[i])] == [j for _, j in want]
    visits = [v for name, v in sent if name == "metric-visits"]
    assert visits and all("v" not in v.columns for v in visits)
    blocks = index.chunks.select("block").distinct().count()
    assert blocks <= 2 * M.BLOCKS and visits[-1].count() <= 900 * blocks


def test_links_of_a_block_join_the_same_rows():
    import pyarrow as pa
    rng = np.random.default_rng(4)
    i, j = rng.integers(0, 300, 260), rng.integers(0, 300, 260)
    apart = i != j

    def parts(pairs):
        comp = {k: k for k in range(300)}
        for a, b in pairs:
            lo, hi = sorted((comp[a], comp[b]))
            comp = {k: lo if c == hi else c for k, c in comp.items()}
        return comp
    few = M.spanning_links(pa.table({"i": i[apart], "j": j[apart]}))
    assert few.num_rows < 300 and parts(zip(few["i"].to_pylist(), few["j"].to_pylist())) == parts(zip(i, j))


def test_an_index_of_many_chunks_has_few_blocks_and_links_the_same_rows(spark):
    rng = np.random.default_rng(5)
    v = np.concatenate([rng.normal(0, 0.05, (300, 4)), rng.normal(2, 0.4, (300, 4))]).round(4)
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "id long, vector array<double>")
    index = M.Index(df, chunk=6)
    assert index.chunks.count() >= 100
    # each row travels to every block at most
    assert index.chunks.select("block").distinct().count() <= 10
    d = np.sqrt(((v[:, None] - v[None]) ** 2).sum(-1))
    for eps in (0.02, 0.3):
        label = np.arange(len(v))
        while True:
            new = np.where(d <= eps, label[None, :], len(v)).min(axis=1)
            if (new == label).all():
                break
            label = new
        links = M.linked(index, index.classes.select("cls"), eps).collect()
        assert all(label[r["i"]] == label[r["j"]] for r in links)
        i, j = np.array([(r["i"], r["j"]) for r in links], dtype=np.int64).reshape(-1, 2).T
        assert (M._joined(np.arange(len(v)), i, j) == label).all()
