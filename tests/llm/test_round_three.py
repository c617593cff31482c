"""Merkle manifest, circulant MinHash and whitening against plain versions."""

import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from linkloom.llm import merkle, minhash, whitening

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
EXTRA = ("tree string, pos long, row long, cls long, band long, i int, x array<long>, n long, salt long, grp string, "
         "kids string, th long, component int, d1 long, head long")


def sha(s):
    return hashlib.sha256(s.encode()).hexdigest()


def enc(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def plain_lower(t):
    return None if t is None else "".join(c.lower() if "A" <= c <= "Z" else c for c in t)


def plain_manifest(rows, fan=16):
    """Climb of every leaf, by hand."""
    def up(level):
        return [sha("".join(level[i:i + fan])) for i in range(0, len(level), fan)]

    def build(level):
        levels = [level]
        while len(levels[-1]) > 1:
            levels.append(up(levels[-1]))
        return levels

    def walk(levels, pos, h):
        proof = ""
        for level in levels[:-1]:
            run = level[pos // fan * fan:pos // fan * fan + fan]
            at = pos % fan
            proof += "".join(run[:at] + run[at + 1:])
            h = sha("".join(run[:at] + [h] + run[at + 1:]))
            pos //= fan
        return h, proof

    leaf = {}
    for i, (doc_id, text, lang, source, n) in enumerate(rows):
        one = lambda t: sha(enc(doc_id) + enc(source) + enc(lang) + enc(n) + enc(t))  # noqa: B023, E731
        bad = doc_id is not None and zlib.crc32(str(doc_id).encode()) % 5 == 0
        leaf[i] = one(text), one(plain_lower(text)) if bad else one(text)
    groups = {}
    for i, r in enumerate(rows):
        groups.setdefault(r[3], []).append(i)
    order = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    trees = {}
    for s in order:
        groups[s].sort(key=lambda i: (rows[i][0] is not None, rows[i][0] or 0, leaf[i][0]))
        trees[s] = build([leaf[i][0] for i in groups[s]])
    top = build([trees[s][-1][0] for s in order])
    out = []
    for at, s in enumerate(order):
        for pos, i in enumerate(groups[s]):
            h, p = walk(trees[s], pos, leaf[i][1])
            h, q = walk(top, at, h)
            out.append((rows[i][0], leaf[i][0], trees[s][-1][0], top[-1][0], sha(p + q), h, h == top[-1][0]))
    return out


def spark_manifest(spark, rows, extra=False):
    df = spark.createDataFrame(rows, DOCS)
    if extra:
        df = df.select("*", *[F.lit(None).cast(t).alias(c) for c, t in (x.rsplit(" ", 1) for x in EXTRA.split(", "))])
    return [tuple(r) for r in merkle.manifest(df).collect()]


def random_rows(rng, n, sources):
    out = []
    for _ in range(n):
        text = rng.choice([None, "", "ABC d é", "x" * rng.randint(0, 50), "Word " * rng.randint(1, 5)])
        out.append((rng.choice([None, rng.randint(0, 500), rng.randint(0, 5)]), text, rng.choice([None, "en", ""]),
                    rng.choice(sources), rng.choice([None, 3])))
    return out


key = lambda r: tuple((x is not None, x) for x in r)


@pytest.mark.parametrize("n, sources", [(700, [None, "", "a", "a", "a", "b'\\", "é"]), (300, [f"s{i}" for i in range(60)]), (1, ["x"]),
                                        (18, ["x"]), (2, [None])])
def test_climb_equals_plain_manifest(spark, n, sources):
    rows = random_rows(random.Random(n), n, sources)
    rows += rows[:3]
    got, want = spark_manifest(spark, rows, extra=n == 18), plain_manifest(rows)
    assert sorted(got, key=key) == sorted(want, key=key)


def test_hot_node_rows_are_copied(spark, monkeypatch):
    monkeypatch.setattr(merkle, "MEETINGS", 2)
    rows = random_rows(random.Random(5), 400, ["a", "a", "b"])
    assert sorted(spark_manifest(spark, rows), key=key) == sorted(plain_manifest(rows), key=key)


def test_empty_tables(spark):
    assert spark_manifest(spark, []) == []
    assert minhash.near_duplicates(spark.createDataFrame([], DOCS)).collect() == []
    assert whitening.whiten(spark.createDataFrame([], "vec_id long, embedding array<float>")).collect() == []


# --- MinHash --------------------------------------------------------------------------
def plain_groups(rows, k=2):
    sets = []
    for _, text in rows:
        w = (text or "").encode().lower().split()
        sets.append(frozenset(tuple(w[i:i + k]) for i in range(max(1, len(w) - k + 1))) if w else frozenset())
    n = len(rows)
    part = list(range(n))
    for i in range(n):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 80 * len(sets[i] | sets[j]) and part[i] != part[j]:
                a, b = part[i], part[j]
                part = [a if p == b else p for p in part]
    low = {}
    for i, p in enumerate(part):
        if sets[i] and rows[i][0] is not None:
            low[p] = min(low.get(p, rows[i][0]), rows[i][0])
    return sorted(((rows[i][0], len(sets[i]), low.get(part[i]) if sets[i] else rows[i][0]) for i in range(n)), key=key)


def edited(rng, words, base, edits):
    out = list(base)
    for _ in range(edits):
        out[rng.randrange(len(out))] = rng.choice(words)
    return out


def test_groups_equal_all_pairs(spark):
    """Chains of edits keep similarities on both sides of the limit."""
    rng = random.Random(3)
    words = [f"W{i}" for i in range(500)]
    texts = [None, "", " \t ", "one", "ONE", "one two", "é É", "é é"]
    for _ in range(12):
        base = [rng.choice(words) for _ in range(rng.randint(5, 120))]
        for _ in range(rng.randint(2, 14)):
            base = edited(rng, words, base, max(1, len(base) // rng.choice([12, 16, 25, 40])))
            texts.append(" ".join(base))
            if rng.random() < 0.3:
                texts.append(" ".join(base).lower() + "\n")
    texts.append("long " + " ".join(str(i) for i in range(150_000)))
    texts.append("LONG " + " ".join(str(i) for i in range(150_000)))
    rows = [(i * 7 % 1009, t) for i, t in enumerate(texts)] + [(None, "one two"), (None, "quite alone"), (5, texts[20])]
    rows += [rows[12], rows[12], rows[30]]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    df = df.select("*", *[F.lit(None).cast(t).alias(c) for c, t in (x.rsplit(" ", 1) for x in EXTRA.split(", "))])
    want = plain_groups(rows)
    assert sorted((tuple(r) for r in minhash.near_duplicates(df).collect()), key=key) == want
    # blocks of three: most groups take several
    assert sorted((tuple(r) for r in minhash.near_duplicates(df, block=3).collect()), key=key) == want


def test_second_permutation_is_one_to_one_and_shifts():
    v = np.arange(1 << 16, dtype=np.uint32) * np.uint32(65537)
    room, side = np.empty_like(v), np.empty_like(v)
    a = minhash.turned(v, 5, room, side).copy()
    assert len(np.unique(a)) == len(v) and len(np.unique(minhash.scatter(v.astype(np.uint64) << np.uint64(32)))) == len(v)
    assert (a == minhash.turned(v + np.uint32(5), 0, room, side)).all()


def test_signatures_estimate_similarity():
    rng = np.random.default_rng(1)
    x = rng.integers(0, 2 ** 63, 90_000).astype(np.uint64)
    sets = [np.unique(x[:80_000]), np.unique(x[10_000:]), np.zeros(0, np.uint64), np.unique(x[:10])]
    sig = minhash.signatures(sets, 400)
    assert abs((sig[0] == sig[1]).mean() - 70 / 90) < 0.07
    assert (sig[2] == 0xFFFFFFFF).all()
    alone = minhash.signatures(sets[3:], 400)
    assert (alone[0] == sig[3]).all()


# --- whitening ------------------------------------------------------------------------
def check_whitening(spark, vectors, keep=8, settle=None):
    rows = [(i, v) for i, v in enumerate(vectors)]
    got = whitening.whiten(spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3), keep).withColumnRenamed(
        "id", "vec_id").toPandas()
    good = [(i, v) for i, v in rows if v and len(v) == 12 and all(c is not None and np.isfinite(c) for c in v)]
    x = np.array([[int(np.floor(1024 * c)) + 100_000 for c in v] for _, v in good], dtype=np.int64)
    n = len(x)
    c = (n * x - x.sum(0)) / n
    values, vecs = np.linalg.eigh(c.T @ c / n)
    values, vecs = values[::-1], vecs[:, ::-1]
    k = min(keep, int((values > values[0] * 1e-10).sum()))
    assert len(got) == n * k and set(got["n"]) == {n}
    dev = dict(zip([i for i, _ in good], [sum(int(y) ** 2 for y in n * r - x.sum(0)) for r in x]))
    assert dict(zip(got["vec_id"], got["deviation"])) == dev
    z = got.pivot(index="vec_id", columns="component", values="whitened").to_numpy()
    for j in range(k):
        e = got[got["component"] == j + 1]["explained"].iloc[0]
        assert abs(e / (values[j] / values.sum()) - 1) < 1e-9
    cov = (z - z.mean(0)).T @ (z - z.mean(0)) / n
    assert np.abs(cov - np.eye(k)).max() < 1e-8
    assert got["identity_error"].nunique() == 1 and got["identity_error"].iloc[0] < 1e-8
    return c, z, values, vecs


def test_components_equal_eigenvectors(spark):
    rng = np.random.default_rng(2)
    v = (rng.standard_normal((300, 12)) * np.linspace(3, 0.2, 12) + 5).tolist()
    v += [None, [], [1.0] * 11, [1.0] * 11 + [None], [float("nan")] * 12, [float("inf")] * 12, v[0]]
    c, z, values, vecs = check_whitening(spark, v)
    for j in range(8):
        want = c @ vecs[:, j] / np.sqrt(values[j])
        assert min(np.abs(z[:, j] - want).max(), np.abs(z[:, j] + want).max()) < 1e-7


def test_repeated_values_and_flat_spaces(spark):
    """Equal eigenvalues, constant dimensions and fewer rows than dimensions."""
    corners = [[s if i == j else 0.0 for i in range(12)] for j in range(12) for s in (1.0, -1.0)]
    check_whitening(spark, corners)
    flat = [[float(a), float(b), 3.0] + [0.0] * 9 for a in range(3) for b in range(3)]
    check_whitening(spark, flat)
    check_whitening(spark, np.random.default_rng(1).standard_normal((4, 12)).tolist())
    one = spark.createDataFrame([(1, [1.0, 2.0])], "vec_id long, embedding array<double>")
    assert whitening.whiten(one).collect() == []


def test_settles_early_with_a_second_look(spark):
    """Three equal large directions among small ones: one Krylov space would miss two."""
    rng = np.random.default_rng(4)
    x = np.zeros((3000, 40))
    at = rng.integers(0, 40, 3000)
    x[np.arange(3000), at] = rng.choice([-1, 1], 3000)
    x[:, 3:] *= 0.001
    x = x - x.mean(0)
    q = np.linalg.svd(x[:, :3], full_matrices=False)[0] * 100
    x[:, :3] = q
    rows = whitening.Rows(whitening.stage(whitening.whole_numbers(
        spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "vec_id long, embedding array<double>"),
        "vec_id", "embedding", 1024.0, 0), "t"))
    values, parts, _ = whitening.components(rows, 3)
    assert np.allclose(values / values[0], 1, atol=1e-3) and np.abs(parts[:, :3] @ parts[:, :3].T - np.eye(3)).max() < 1e-3


def test_deviation_beyond_long_is_null(spark):
    v = [[1e6 * (i % 2)] * 3 for i in range(30)]
    got = whitening.whiten(spark.createDataFrame(list(enumerate(v)), "vec_id long, embedding array<double>"), 1)
    assert got.where("deviation is null").count() == 30
