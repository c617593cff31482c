"""SimHash groups and substring dedup against brute force."""

import hashlib
import random
import re

import numpy as np
import xxhash

from linkloom.llm import simhash_gray as G
from linkloom.llm.debruijn import drop_repeats, keep_rest

SCHEMA = "doc_id long, text string, fp long, t long, component int, route long, doc long, id string"
EXTRA = (1, 2, 3, 4, 5, "x")


def python_fp(text, k=3):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", low)
    shingles = [" ".join(w[i:i + k]) for i in range(max(1, len(w) - k + 1))] if w else []
    hs = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if hs and 2 * sum(h >> b & 1 for h in hs) > len(hs))


def test_links_equal_all_pairs():
    rng = np.random.default_rng(0)
    points = []
    for base in rng.integers(0, 2 ** 63, 30).astype(np.uint64):
        x = int(base)
        for _ in range(50):
            y = x
            for k in rng.integers(0, 64, rng.integers(0, 4)):
                y ^= 1 << int(k)
            points.append(y)
            if rng.random() < 0.3:
                x = y
    p = np.unique(np.array(points, dtype=np.uint64))
    r = G.gray_rank(p)
    assert (G.gray_code(r) == p).all()
    c = p[np.argsort(r)]
    f, g = G.Forest(len(c)), G.Forest(len(c))
    f.link(*G.link_sorted(c, np.zeros(len(c), np.uint64), None, 3, chunk=50))
    g.link(*np.nonzero(np.bitwise_count(c[:, None] ^ c[None, :]) <= 3))
    every = np.arange(len(c))
    assert (f.roots(every) == g.roots(every)).all()


def near_copies(rng, n):
    words = [f"w{i}" for i in range(400)]
    out = []
    for _ in range(n):
        base = [rng.choice(words) for _ in range(rng.randint(1, 80))]
        for _ in range(rng.randint(1, 4)):
            c = list(base)
            if rng.random() < 0.6:
                c[rng.randrange(len(c))] = "X" + rng.choice(words)
            out.append(" ".join(c))
    return out


def test_simhash_groups_equal_brute_force(spark):
    rng = random.Random(5)
    texts = near_copies(rng, 60) + [None, "", " \t", "one", "One", "one two", "ÉÉ b c d", "long " * 30000]
    rows = [(i, t, *EXTRA) for i, t in enumerate(texts)] + [(0, texts[0], *EXTRA), (None, texts[1], *EXTRA), (None, "lonely words only here", *EXTRA)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    # small pieces: block values spread over several range partitions
    got = G.near_duplicates(df, 3, 3).collect()
    fps = [python_fp(r[1]) for r in rows]
    a = np.array(fps, dtype=np.uint64)
    f = G.Forest(len(a))
    f.link(*np.nonzero(np.bitwise_count(a[:, None] ^ a[None, :]) <= 3))
    root = f.roots(np.arange(len(a)))
    low = {}
    for i, r in enumerate(rows):
        if r[0] is not None:
            low[root[i]] = min(low.get(root[i], r[0]), r[0])
    sign = lambda x: x - 2 ** 64 if x >= 2 ** 63 else x
    want = sorted(((r[0], sign(fps[i]), low.get(root[i])) for i, r in enumerate(rows)), key=str)
    assert sorted(((r["id"], r["fp"], r["component_id"]) for r in got), key=str) == want
    kept = G.keep_one(df).collect()
    assert len(kept) == len(set(root)) and kept[0].asDict().keys() == set(df.columns)
    assert sorted(r["doc_id"] for r in kept if r["doc_id"] is not None) == sorted(low.values())
    assert G.near_duplicates(df.limit(0)).count() == 0


def test_links_over_pieces(spark):
    rng = np.random.default_rng(1)
    base = int(rng.integers(0, 2 ** 62))
    fps = {base ^ (1 << int(a)) ^ (1 << int(b)) for a, b in rng.integers(0, 62, (150, 2))} | {int(x) for x in rng.integers(0, 2 ** 62, 40)}
    df = spark.createDataFrame([(x,) for x in fps], "fp long")
    links = G.similar_links(df, 3, rows_a_piece=20).collect()
    order = sorted(fps)
    at = {x: i for i, x in enumerate(order)}
    a = np.array(order, dtype=np.uint64)
    f, g = G.Forest(len(a)), G.Forest(len(a))
    f.link(np.array([at[r["src"]] for r in links]), np.array([at[r["dst"]] for r in links]))
    g.link(*np.nonzero(np.bitwise_count(a[:, None] ^ a[None, :]) <= 3))
    every = np.arange(len(a))
    assert (f.roots(every) == g.roots(every)).all() and len(links) < 4 * 4 * len(a)


def python_dedup(rows, k):
    first = {}
    words = [(d, (t or "").encode().split()) for d, t in rows]
    for d, w in words:
        for i in range(len(w) - k + 1):
            if d is not None:
                g = tuple(w[i:i + k])
                first[g] = min(first.get(g, d), d)
    out = []
    for d, w in words:
        gone = set()
        for i in range(len(w) - k + 1):
            if d is not None and first[tuple(w[i:i + k])] < d:
                gone |= set(range(i, i + k))
        kept = b" ".join(x for i, x in enumerate(w) if i not in gone)
        out.append((d, len(w), len(gone), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def test_substring_dedup_equals_brute_force(spark):
    for seed, vocabulary, parts in ((1, 3, 1), (2, 40, 7), (3, 2000, 4)):
        rng = random.Random(seed)
        pool = [[f"w{rng.randrange(vocabulary)}" for _ in range(rng.randint(5, 60))] for _ in range(25)]
        rows = []
        for d in range(120):
            text = sum((rng.choice(pool)[rng.randint(0, 8):] if rng.random() < 0.6 else [f"u{rng.randrange(9 ** 6)}" for _ in range(9)]
                        for _ in range(rng.randint(0, 4))), [])
            rows.append((d * 3 % 127, (" \n" if d % 2 else " ").join(text)))
        rows += [(500, rows[7][1]), (rows[3][0], rows[3][1]), (501, None), (502, ""), (None, rows[5][1]), (503, "q " * 60000), (504, "q " * 70000)]
        df = spark.createDataFrame([(*r, *EXTRA) for r in rows], SCHEMA).repartition(parts)
        for k in (13, 6):
            got = drop_repeats(df, k, 3).collect()
            assert sorted((tuple(r) for r in got), key=str) == python_dedup(rows, k), (seed, k)
    rest = keep_rest(df, 13, 5)
    assert rest.columns == df.columns
    by_id = {r["doc_id"]: r["text"] for r in rest.collect()}
    assert by_id[501] is None and by_id[502] == "" and 504 not in by_id
    assert drop_repeats(df.limit(0)).count() == 0


def test_rows_of_one_id_with_other_texts(spark):
    a, b = " ".join(f"a{i}" for i in range(30)), " ".join(f"b{i}" for i in range(30))
    df = spark.createDataFrame([(1, a), (2, a), (2, b), (3, b)], "doc_id long, text string")
    got = sorted(tuple(r)[:3] for r in drop_repeats(df).collect())
    assert len(got) == 4 and got[0] == (1, 30, 0)
    assert sum(r[2] for r in got if r[0] == 2) in (0, 30)
