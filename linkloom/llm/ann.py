"""Nearest neighbours by largest inner product: a forest of random-projection
trees with one priority queue a query, and exact reranking of leaf candidates.

Equal vectors are one class (their smallest ids stand for them), so copies are
searched once.  Inner product becomes distance by one extra coordinate
(sqrt(M^2 - |x|^2), M the largest norm).  The trees are fitted on a bounded
sample of the classes (``sample`` of them, chosen by hash; all, if fewer): each
node splits between two random members, until a tree has about ``leaves`` leaves.  Every class is then indexed in every tree, as a row of its leaf.  A
query takes the subtrees of all trees from one queue, widest margin first, until
the visited leaves hold a given share of the rows.  Queries meet the rows of a leaf in its
own task; the exact double-precision product keeps the best k + 1 of each leaf,
and those are merged by query.

Broadcast: the trees, bounded by sample and number of trees.  Nothing else leaves
the executors except leaf sizes (bounded by the number of leaves).

Defined results: vectors that are null, empty, zero, of another length than the
most frequent one (ties: the shorter) or hold null or non-finite components take
no part, nor do rows with a null id; repeated rows count once; a query never
meets rows of its own id; ties go to the smaller id; fewer candidates than k
give them all; extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import heapq
import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from linkloom.llm.common import stage


def clean_vectors(df: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """(id, v) rows that take part."""
    x = df.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).alias("v")).where("id is not null and v is not null")
    x = x.where("forall(v, e -> e is not null and not isnan(e) and abs(e) <= 1.7976931348623157e308D) and exists(v, e -> e <> 0)")
    size = x.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").first()
    return x.where(F.size("v") == (size["n"] if size else 0))


def vector_classes(rows: DataFrame, keep: int) -> DataFrame:
    """(rep, v, ids): classes of equal vectors, with their ``keep`` smallest ids."""
    w = Window.partitionBy("v").orderBy("id")
    few = rows.distinct().withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= keep)
    return few.groupBy("v").agg(F.min("id").alias("rep"), F.sort_array(F.collect_list("id")).alias("ids")).select(
        "rep", "v", "ids")


class Tree:
    """Inner nodes: plane (normal, offset), children; child c < 0 is leaf ~c."""

    def __init__(self, x: np.ndarray, leaf: int, rng: np.random.Generator):
        self.normals, self.offsets, self.children, self.leaves = [], [], [], 0
        self.root = self._grow(x, np.arange(len(x)), leaf, rng)
        dim = x.shape[1]
        self.normals = np.array(self.normals, dtype=np.float32).reshape(-1, dim)
        self.offsets = np.array(self.offsets, dtype=np.float32)
        self.children = np.array(self.children, dtype=np.int64).reshape(-1, 2)

    def _grow(self, x, idx, leaf, rng):
        todo, root = [(idx, None, 0)], None
        while todo:
            idx, parent, side = todo.pop()
            node = self._split(x, idx, leaf, rng)
            if node is None:
                ref = ~self.leaves
                self.leaves += 1
            else:
                normal, offset, right = node
                ref = len(self.normals)
                self.normals.append(normal)
                self.offsets.append(offset)
                self.children.append([0, 0])
                todo += [(idx[~right], ref, 0), (idx[right], ref, 1)]
            if parent is None:
                root = ref
            else:
                self.children[parent][side] = ref
        return root

    @staticmethod
    def _split(x, idx, leaf, rng):
        if len(idx) <= leaf:
            return None
        for attempt in range(4):
            if attempt < 3:
                a, b = x[rng.choice(idx, 2, replace=False)]
                normal, offset = a - b, float((a - b) @ (a + b) / 2)
            else:  # lopsided so far: a random direction at the median
                normal = rng.standard_normal(x.shape[1]).astype(x.dtype)
                offset = float(np.median(x[idx] @ normal))
            right = x[idx] @ normal > offset
            if 0.05 * len(idx) <= right.sum() <= 0.95 * len(idx):
                return normal, offset, right
        return (normal, offset, right) if 0 < right.sum() < len(idx) else None

    def leaf_of(self, x: np.ndarray) -> np.ndarray:
        at = np.full(len(x), self.root, dtype=np.int64)
        while (inner := at >= 0).any():
            n = at[inner]
            right = np.einsum("ij,ij->i", x[inner], self.normals[n]) > self.offsets[n]
            at[inner] = self.children[n, right.astype(np.int64)]
        return ~at


def visited_leaves(q: np.ndarray, trees: list[Tree], sizes: list[np.ndarray], search: int) -> list[list[tuple[int, int]]]:
    """Leaves of each query, best first over all trees, until they hold ``search`` rows."""
    margins = [q @ t.normals.T - t.offsets for t in trees]
    out = []
    for i in range(len(q)):
        heap = [(-math.inf, k, t.root) for k, t in enumerate(trees)]
        m = [x[i] for x in margins]
        got, rows = [], 0
        while heap and rows < search:
            p, k, at = heapq.heappop(heap)
            if at < 0:
                if sizes[k][~at]:
                    got.append((k, int(~at)))
                    rows += sizes[k][~at]
                continue
            d = float(m[k][at])
            left, right = trees[k].children[at]
            heapq.heappush(heap, (max(p, d), k, int(left)))
            heapq.heappush(heap, (max(p, -d), k, int(right)))
        out.append(got)
    return out


def nearest(df: DataFrame, queries, k: int = 20, trees: int = 16, leaves: int = 256, sample: int = 40_000,
            search: float = 0.9, seed: int = 7, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: the k rows of largest inner product found for each query.

    queries: Column over ``id`` that says which rows are queries.  A tree has about
    ``leaves`` leaves.  search: rows that the visited leaves hold, over all trees
    and with repeats, as a share of all classes.  The default keeps recall over
    0.9 even for vectors without any structure; clustered vectors need far less."""
    spark = df.sparkSession
    rows = clean_vectors(df, id_col, vec_col)
    classes = stage(vector_classes(rows, k + 1), "ann-classes")
    asked = stage(rows.where(queries).distinct().join(classes.select("rep", "v"), "v").select("id", "rep"), "ann-queries")
    n, top2 = classes.select(F.count(F.lit(1)), F.max(F.expr("aggregate(v, 0D, (a, e) -> a + double(e) * double(e))"))).first()
    top2 = top2 or 1.0
    share = min(1.0, sample / max(n, 1))
    fit = classes.where(F.pmod(F.xxhash64("v"), F.lit(1_000_000)) < F.lit(int(share * 1_000_000) if share < 1 else 1_000_000))
    got = fit.orderBy("rep").select("v").toArrow().column("v")
    vecs = np.array(got.to_pylist(), dtype=np.float32) if len(got) else np.zeros((1, 1), np.float32)

    def lifted(x):
        rest = np.sqrt(np.maximum(0.0, top2 - np.einsum("ij,ij->i", x, x, dtype=np.float64)))
        return np.hstack([x, rest[:, None]]).astype(np.float32)

    rng = np.random.default_rng(seed)
    x = lifted(vecs)
    # random splits leave leaves about two thirds full
    leaf = max(32, math.ceil(1.5 * len(x) / leaves))
    forest = spark.sparkContext.broadcast([Tree(x, leaf, rng) for _ in range(trees)])
    budget = max(100 * k, math.ceil(search * n))

    def index(batches):
        for b in batches:
            if not len(b):
                continue
            x = lifted(np.stack(b["v"].to_numpy()).astype(np.float32))
            leaves = np.stack([t.leaf_of(x) for t in forest.value], axis=1)
            yield pd.DataFrame({"rep": b["rep"], "leaves": list(leaves)})

    placed = stage(classes.select("rep", "v").mapInPandas(index, "rep long, leaves array<long>")
                   .select("rep", F.posexplode("leaves").alias("tree", "leaf")), "ann-leaves")
    counts = placed.groupBy("tree", "leaf").count().toArrow()  # as many rows as leaves
    sizes = [np.zeros(t.leaves, dtype=np.int64) for t in forest.value]
    for a, b, c in zip(*(counts.column(i).to_pylist() for i in range(3))):
        sizes[a][b] = c
    sized = spark.sparkContext.broadcast(sizes)

    def visit(batches):
        for b in batches:
            if not len(b):
                continue
            q = np.stack(b["v"].to_numpy()).astype(np.float64)
            q *= math.sqrt(top2) / np.linalg.norm(q, axis=1, keepdims=True)
            q = np.hstack([q, np.zeros((len(q), 1))]).astype(np.float32)
            got = [(r, k, lf) for r, ls in zip(b["rep"], visited_leaves(q, forest.value, sized.value, budget)) for k, lf in ls]
            yield pd.DataFrame(got, columns=["rep", "tree", "leaf"])

    asked_classes = classes.join(asked.select("rep").distinct(), "rep", "left_semi").select("rep", "v")
    visits = asked_classes.mapInPandas(visit, "rep long, tree int, leaf long")
    with_vec = lambda t: t.join(classes.select("rep", "v"), "rep")
    # leaves per task: a group of leaves holds a few thousand rows, or one leaf if that is larger
    groups = max(1, math.ceil(n * trees / 4096))
    part = F.pmod(F.xxhash64("tree", "leaf"), F.lit(groups)).alias("part")
    rows_side = with_vec(placed).select(part, "tree", "leaf", "rep", "v")
    query_side = with_vec(visits).select(part, "tree", "leaf", "rep", "v")

    def rerank(q: pd.DataFrame, r: pd.DataFrame) -> pd.DataFrame:
        out = []
        r = dict(list(r.sort_values("rep").groupby(["tree", "leaf"], sort=False)))
        for key, qs in q.groupby(["tree", "leaf"], sort=False):
            if key not in r:
                continue
            ids = r[key]["rep"].to_numpy()
            x = np.stack(r[key]["v"].to_numpy()).astype(np.float64)
            for at in range(0, len(qs), 512):
                block = qs.iloc[at:at + 512]
                s = np.einsum("qd,nd->qn", np.stack(block["v"].to_numpy()).astype(np.float64), x)
                best = np.argsort(-s, axis=1, kind="stable")[:, :k + 1]
                out.append(pd.DataFrame({"q": np.repeat(block["rep"].to_numpy(), best.shape[1]), "rep": ids[best].ravel(),
                                         "score": np.take_along_axis(s, best, 1).ravel()}))
        return pd.concat(out) if out else pd.DataFrame({"q": [], "rep": [], "score": []}).astype(
            {"q": "int64", "rep": "int64", "score": "float64"})

    found = query_side.groupBy("part").cogroup(rows_side.groupBy("part")).applyInPandas(
        rerank, "q long, rep long, score double")
    found = found.groupBy("q", "rep").agg(F.max("score").alias("score"))
    w = Window.partitionBy("q").orderBy(F.desc("score"), "rep")
    found = found.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= k + 1)
    members = found.join(classes.select("rep", "ids"), "rep").select("q", "score", F.explode("ids").alias("id"))
    w = Window.partitionBy("q").orderBy(F.desc("score"), "id")
    best = (members.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= k + 1)
            .groupBy("q").agg(F.sort_array(F.collect_list(F.struct("rn", "id", "score"))).alias("best")))
    # every query of a class has the list of the class without its own id
    own = asked.join(best.withColumnRenamed("q", "rep"), "rep").select(
        F.col("id").alias("query_id"), F.expr(f"slice(filter(best, b -> b.id <> id), 1, {k})").alias("best"))
    return own.select("query_id", F.posexplode("best").alias("pos", "b")).select(
        "query_id", (F.col("pos") + 1).cast("int").alias("rank"), F.col("b.id").alias("vec_id"), F.col("b.score").alias("score"))
