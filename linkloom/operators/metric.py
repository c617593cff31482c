"""Exact neighbour search over a pivot index.

Rows of equal vectors are one class.  A bounded sample of classes are pivots; a
class lies in the cell of its nearest pivot, and a cell is cut into chunks of
bounded size along the distance to the pivot, so a hot cell is many chunks.  By the
triangle inequality a row with search radius ``rad`` needs to visit only

* cells with d(row, pivot) <= d(row, nearest pivot) + 2 rad (every member is nearer
  to its own pivot) and d(row, pivot) <= cell radius + rad, and in them
* chunks whose range of distances to the pivot meets d(row, pivot) +- rad.

Neighbours (``neighbours``), pairs in reach (``range_pairs``), linkage (``linked``)
and the cheapest edges of a spanning tree (``spanning_edges``) differ only in the
radius and in what a task keeps.  Chunks are packed into blocks; a visitor's vector
travels once to a block, with one bit for each chunk of it that is in reach, and the
visits themselves are found without vectors.  There are about ``BLOCKS`` blocks until
a block is ``BLOCK_BYTES`` large, so what travels grows with the rows, not with their
square.  A task holds one block and a bounded part of its visitors.  Pivots (at most
``MAX_PIVOTS``) and one row a cell are all that leaves the executors.

Defined results: rows with a null id, or whose vector is null, empty, of another
length than the most frequent one (ties: the shorter) or holds null or non-finite
entries take no part; ties go to smaller ids; an empty table gives an empty index.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkloom.operators.ranking import rank_within_group
from linkloom.session import written_table

MAX_PIVOTS = 1024
#: classes of a chunk, and visitors that meet it in one task (blocks of many chunks: in proportion)
CHUNK, VISITORS = 1024, 4096
#: blocks of an index while they are small, bytes and chunks of a block at most
BLOCKS, BLOCK_BYTES, BLOCK_CHUNKS = 8, 32 << 20, 60
#: rows of an Arrow batch that meet all pivots at once
SLICE = 1024


def clean_vectors(df: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """(id, v) rows that take part."""
    x = df.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<double>").alias("v")).where(
        "id is not null and size(v) > 0 and forall(v, e -> e is not null and not isnan(e) and abs(e) <= 1.7976931348623157e308D)")
    size = x.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").first()
    return x.where(F.size("v") == (size["d"] if size else 0))


def matrix(column, d: int) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, d)


def _numbers(column) -> np.ndarray:
    return column.to_numpy() if isinstance(column, pa.ChunkedArray) else column.to_numpy(zero_copy_only=False)


def _slices(batches):
    """Batches of at most ``SLICE`` rows: rows times pivots is what a step holds."""
    for b in batches:
        for at in range(0, b.num_rows, SLICE):
            yield b.slice(at, SLICE)


def about(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Distances of all rows of a and b by one matrix product (rounded; see Index.slack)."""
    d2 = (a * a).sum(1)[:, None] + (b * b).sum(1)[None, :] - 2 * (a @ b.T)
    return np.sqrt(np.maximum(d2, 0, out=d2), out=d2)


def exact(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Distances of corresponding rows; the same number whichever side a row is on."""
    return np.sqrt(((a - b) ** 2).sum(axis=1))


class Index:
    """Classes of equal vectors in cells and chunks.

    classes: cls (smallest id), m (rows), v, cell, r, chunk; chunks: chunk, cell, lo,
    hi, n, block, bit (its place there); members: id, v of the rows."""

    def __init__(self, df: DataFrame, id_col: str = "id", vec_col: str = "vector", chunk: int | None = None,
                 pivots: int | None = None):
        self.members = written_table(clean_vectors(df, id_col, vec_col), "metric-members")
        grouped = written_table(self.members.groupBy("v").agg(F.min("id").alias("cls"), F.count(F.lit(1)).alias("m"))
                                .select("cls", "m", "v"), "metric-classes")
        norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, e: a + e * e))
        about_all = grouped.agg(F.count(F.lit(1)).alias("n"), F.max(norm).alias("norm"), F.max(F.size("v")).alias("d")).first()
        self.n, self.d = about_all["n"], about_all["d"] or 1
        #: distances by matrix product are right to this much
        self.slack = 1e-6 * (about_all["norm"] or 0.0) + 1e-300
        chunk = chunk or CHUNK
        want = min(pivots or MAX_PIVOTS, max(1, -(-self.n // chunk)))
        sample = grouped.orderBy(F.xxhash64("cls"), "cls").limit(want).select("v").toArrow()  # at most MAX_PIVOTS rows
        self.pivots = matrix(sample.column("v"), self.d) if self.n else np.zeros((1, self.d))
        piv, d = self.pivots, self.d

        def cells(batches):
            for b in _slices(batches):
                v = matrix(b.column(2), d)
                cell = about(v, piv).argmin(axis=1)
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(cell.astype(np.int32)), pa.array(exact(v, piv[cell]))],
                                                 names=["cls", "m", "v", "cell", "r"])

        placed = grouped.mapInArrow(cells, "cls long, m long, v array<double>, cell int, r double")
        ranked = rank_within_group(placed, "cell", ["r", "cls"], "rn")
        self.classes = written_table(ranked.withColumn("chunk", F.col("cell").cast("long") * 2 ** 32 + F.expr(f"(rn - 1) div {chunk}"))
                                     .select("cls", "m", "v", "cell", "r", "chunk"), "metric-index")
        narrow = written_table(self.classes.groupBy("chunk", "cell").agg(
            F.min("r").alias("lo"), F.max("r").alias("hi"), F.count(F.lit(1)).alias("n")), "metric-chunks")
        total = narrow.count()
        #: chunks of a block
        self.wide = max(1, min(BLOCK_CHUNKS, BLOCK_BYTES // (8 * self.d * chunk), total // BLOCKS))
        order = rank_within_group(narrow.withColumn("_all", F.lit(0)), "_all", ["chunk"], "rn", 1 + total // 100_000).drop("_all")
        self.chunks = written_table(order.withColumn("block", F.expr(f"(rn - 1) div {self.wide}"))
                                    .withColumn("bit", F.expr(f"cast((rn - 1) % {self.wide} as int)")).drop("rn"), "metric-blocks")
        self.radii, self.sizes = self.per_cell(self.chunks, F.max("hi"), F.sum("n"))

    def per_cell(self, rows: DataFrame, *aggs) -> list[np.ndarray]:
        """One number a cell for each aggregate of ``rows`` (column cell); NaN for cells without rows."""
        out = [np.full(len(self.pivots), np.nan) for _ in aggs]
        for row in rows.groupBy("cell").agg(*aggs).collect():  # at most MAX_PIVOTS rows
            for o, x in zip(out, row[1:]):
                o[row[0]] = np.nan if x is None else x
        return out

    def member_classes(self) -> DataFrame:
        """id, cls of all rows, written once."""
        if not hasattr(self, "_named"):
            self._named = written_table(self.members.join(self.classes.select("cls", "v"), "v").select("id", "cls"), "metric-named")
        return self._named

    def place(self, queries: DataFrame) -> DataFrame:
        """q, v, chunk: the chunk that each query (q, v) would lie in."""
        piv, d = self.pivots, self.d

        def cells(batches):
            for b in _slices(batches):
                v = matrix(b.column(1), d)
                cell = about(v, piv).argmin(axis=1)
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(cell.astype(np.int32)), pa.array(exact(v, piv[cell]))],
                                                 names=["q", "v", "cell", "r"])

        at = queries.select("q", "v").mapInArrow(cells, "q long, v array<double>, cell int, r double")
        off = F.greatest(F.col("lo") - F.col("r"), F.col("r") - F.col("hi"), F.lit(0.0))
        near = at.select("q", "cell", "r").join(self.chunks, "cell").groupBy("q").agg(F.min_by("chunk", F.struct(off, "chunk")).alias("chunk"))
        return at.select("q", "v").join(near, "q")

    def visits(self, queries: DataFrame, least: int = 0) -> DataFrame:
        """q, rad, further columns of ``queries`` (q, v, rad, ...) but the vector, and chunk,
        block, bit: the chunks in reach.

        With ``least`` a radius shrinks to where that many classes lie for sure."""
        piv, radii, sizes, d, slack = self.pivots, self.radii, self.sizes, self.d, self.slack
        iv, ir = queries.columns.index("v"), queries.columns.index("rad")
        kept = [(i, f) for i, f in enumerate(queries.schema) if f.name != "v"]
        names = [f.name for _, f in kept]

        def reach(batches):
            for b in _slices(batches):
                v, rad = matrix(b.column(iv), d), _numbers(b.column(ir)).copy()
                to = about(v, piv)
                if least:
                    sure = np.where(sizes > least, to + radii + slack, np.inf)
                    rad = np.minimum(rad, sure.min(axis=1, initial=np.inf))
                near = (to <= to.min(axis=1, keepdims=True) + 2 * rad[:, None] + 4 * slack) & (to <= radii + rad[:, None] + 2 * slack)
                at, cell = np.nonzero(near)
                cols = [pa.array(rad[at]) if i == ir else b.column(i).take(pa.array(at)) for i, _ in kept]
                yield pa.RecordBatch.from_arrays([*cols, pa.array(cell.astype(np.int32)), pa.array(to[at, cell])],
                                                 names=[*names, "cell", "_to"])

        schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for _, f in kept) + ", cell int, _to double"
        hit = (F.col("lo") - 2 * slack <= F.col("_to") + F.col("rad")) & (F.col("hi") + 2 * slack >= F.col("_to") - F.col("rad"))
        return queries.mapInArrow(reach, schema).join(self.chunks.drop("n"), "cell").where(hit).drop("cell", "_to", "lo", "hi")


def meet(visits: DataFrame, home: DataFrame, task, schema: str, index: Index, queries: DataFrame, fold=None) -> DataFrame:
    """task(visitors, chunk rows) -> table, for every chunk and those of ``queries`` (q, v, ...)
    that visit it (``visits``: q, chunk, rad if the task wants it), a block and a bounded
    part of its visitors at a time.  fold(table) -> table thins out what a block gave."""
    places = index.chunks.select("chunk", "block", "bit")
    if "block" not in visits.columns:
        visits = visits.join(places, "chunk")
    rad = [F.max("rad").alias("rad")] if "rad" in visits.columns else []
    asked = written_table(visits.groupBy("q", "block").agg(F.expr("bit_or(shiftleft(1L, bit))").alias("_chunks"), *rad), "metric-visits")
    most = VISITORS * max(1, index.wide // 4)
    parts = asked.groupBy("block").agg((F.floor((F.count(F.lit(1)) - 1) / most) + 1).cast("long").alias("_parts"))
    left = asked.join(queries.select([c for c in queries.columns if c not in ("rad", "chunk")]), "q").join(parts, "block").withColumn(
        "_part", F.pmod(F.xxhash64("q"), F.col("_parts"))).drop("_parts")
    right = home.join(places, "chunk").drop("chunk").join(parts, "block").withColumn(
        "_part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_parts") - 1))).drop("_parts")
    right = right.select([F.col(c).alias(c) for c in right.columns])  # both sides may come from one table
    fields = [x.rsplit(" ", 1) for x in schema.split(", ")]
    none = pa.table({n: pa.array([], {"long": pa.int64(), "double": pa.float64()}[kind]) for n, kind in fields})

    def run(a, b):
        if not (a.num_rows and b.num_rows):
            return none
        reach, bits = _numbers(a.column("_chunks")), _numbers(b.column("bit"))
        b = b.take(pa.array(np.argsort(bits, kind="stable")))
        at, out = 0, [none]
        for bit, n in zip(*np.unique(bits, return_counts=True)):
            mine = reach >> int(bit) & 1 == 1
            if mine.any():
                out.append(task(a if mine.all() else a.filter(pa.array(mine)), b.slice(at, n)))
                if fold and sum(t.num_rows for t in out) > 500_000:
                    out = [fold(pa.concat_tables(out))]
            at += n
        found = pa.concat_tables(out)
        return fold(found) if fold and found.num_rows else found

    return left.groupBy("block", "_part").cogroup(right.groupBy("block", "_part")).applyInArrow(run, schema)


def first_rows(by: str, order: tuple, k: int = 1):
    """Fold of ``meet``: the first k rows of each ``by`` in rising ``order``."""
    def fold(t):
        rows = np.lexsort([_numbers(t.column(c)) for c in (*reversed(order), by)])
        g = _numbers(t.column(by))[rows]
        first = np.flatnonzero(np.r_[True, g[1:] != g[:-1]])
        nth = np.arange(len(g)) - np.repeat(first, np.diff(np.r_[first, len(g)]))
        return t.take(pa.array(rows[nth < k]))
    return fold


def spanning_links(t):
    """Fold of ``meet``: links i, j that join the same rows, at most one a row."""
    ids, ends = np.unique(np.r_[_numbers(t.column("i")), _numbers(t.column("j"))], return_inverse=True)
    label = _joined(np.arange(len(ids)), *np.split(ends, 2))
    apart = label != np.arange(len(ids))
    return pa.table({"i": ids[apart], "j": ids[label[apart]]})


def _joined(label: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Labels (places of the first of their kind) after rows i and j are joined."""
    while True:
        low, new = np.minimum(label[i], label[j]), label.copy()
        np.minimum.at(new, label[i], low)
        np.minimum.at(new, label[j], low)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def _nearest(k: int, d: int, slack: float, own: bool, bound: bool):
    """Task: the k nearest classes of each visitor, or only the distance that k of them lie within."""
    def task(a, b):
        q, c = _numbers(a.column("q")), _numbers(b.column("cls"))
        x, y = matrix(a.column("v"), d), matrix(b.column("v"), d)
        rad = None if bound else _numbers(a.column("rad"))
        out = []
        for at in range(0, len(q), 512):
            dist = about(x[at:at + 512], y)
            if own:
                dist[q[at:at + 512, None] == c[None, :]] = np.inf
            kth = np.partition(dist, k - 1, axis=1)[:, k - 1] if len(c) >= k else np.full(len(dist), np.inf)
            if bound:
                out.append((q[at:at + 512], kth + 2 * slack))
                continue
            i, j = np.nonzero(dist <= np.minimum(kth, rad[at:at + 512])[:, None] + 2 * slack)
            i = i + at
            e = exact(x[i], y[j])
            order = np.lexsort((c[j], e, i))
            i, j, e = i[order], j[order], e[order]
            first = np.flatnonzero(np.r_[True, i[1:] != i[:-1]]) if len(i) else np.zeros(0, np.int64)
            keep = np.arange(len(i)) - np.repeat(first, np.diff(np.r_[first, len(i)])) < k
            out.append((q[i[keep]], c[j[keep]], e[keep]))
        cols = [np.concatenate(z) for z in zip(*out)]
        return pa.table(dict(zip(["q", "rad"] if bound else ["q", "other", "d"], cols)))
    return task


def neighbours(index: Index, k: int, queries: DataFrame | None = None) -> DataFrame:
    """q, other, d, rank (from 1): the k nearest classes of every class of the index but
    itself, or of every row of ``queries`` (q, v); ties to the smaller class."""
    from pyspark.sql import Window
    own = queries is None
    home = index.classes.select("chunk", "cls", "v")
    start = home.select(F.col("cls").alias("q"), "v", "chunk") if own else index.place(queries)
    start = written_table(start, "metric-queries")
    rad = meet(start, home, _nearest(k, index.d, index.slack, own, True), "q long, rad double", index, start)
    visits = index.visits(start.select("q", "v").join(rad, "q"), least=k)
    found = meet(visits, home, _nearest(k, index.d, index.slack, own, False), "q long, other long, d double", index, start,
                 first_rows("q", ("d", "other"), k))
    w = Window.partitionBy("q").orderBy("d", "other")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def core_distances(index: Index, min_samples: int, queries: DataFrame | None = None, near: DataFrame | None = None) -> DataFrame:
    """q, core: the distance within which ``min_samples`` rows lie, the row itself and its
    copies counted (null where there are not that many).  near: their ``neighbours``, where known."""
    from pyspark.sql import Window
    need = min_samples - 1
    if queries is None:
        base = index.classes.select(F.col("cls").alias("q"), (F.col("m") - 1).alias("have"))
    else:
        base = queries.select("q", F.lit(0).cast("long").alias("have"))
    if need <= 0:
        return base.select("q", F.lit(0.0).alias("core"))
    near = (neighbours(index, need, queries) if near is None else near).join(index.classes.select(F.col("cls").alias("other"), "m"), "other")
    w = Window.partitionBy("q").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    steps = near.join(base, "q").withColumn("_upto", F.sum("m").over(w) + F.col("have"))
    reached = steps.where(F.col("_upto") >= need).groupBy("q").agg(F.min("d").alias("d"))
    return base.join(reached, "q", "left").select("q", F.when(F.col("have") >= need, F.lit(0.0)).otherwise(F.col("d")).alias("core"))


def range_pairs(index: Index, eps: float) -> DataFrame:
    """i, j, d: every pair of classes (i < j) within ``eps``, once."""
    d, slack = index.d, index.slack

    def task(a, b):
        q, c = _numbers(a.column("q")), _numbers(b.column("cls"))
        x, y = matrix(a.column("v"), d), matrix(b.column("v"), d)
        out = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
        for at in range(0, len(q), 512):
            i, j = np.nonzero((about(x[at:at + 512], y) <= eps + 2 * slack) & (q[at:at + 512, None] < c[None, :]))
            e = exact(x[i + at], y[j])
            ok = e <= eps
            out.append((q[i[ok] + at], c[j[ok]], e[ok]))
        return pa.table(dict(zip("ijd", [np.concatenate(z) for z in zip(*out)])))

    home = index.classes.select("chunk", "cls", "v")
    queries = index.classes.select(F.col("cls").alias("q"), "v", F.lit(float(eps)).alias("rad"))
    return meet(index.visits(queries), home, task, "i long, j long, d double", index, queries)


def linked(index: Index, rows: DataFrame, eps: float) -> DataFrame:
    """i, j: edges that connect exactly the classes ``rows`` (cls) within ``eps`` of each
    other: every task keeps a spanning set of the pairs it sees, never all of them."""
    d, slack = index.d, index.slack

    def task(a, b):
        q, c = _numbers(a.column("q")), _numbers(b.column("cls"))
        x, y = matrix(a.column("v"), d), matrix(b.column("v"), d)
        # visitors first, then the chunk's rows; pairs in reach are joined and forgotten, 512 visitors at a time
        ids = np.r_[q, c]
        label = np.arange(len(ids))
        for at in range(0, len(q), 512):
            dist = about(x[at:at + 512], y)
            i, j = np.nonzero(dist <= eps + 2 * slack)
            unsure = dist[i, j] > eps - 2 * slack
            i, j = i + at, j + len(q)
            near = ~unsure
            near[unsure] = exact(x[i[unsure]], y[j[unsure] - len(q)]) <= eps
            label = _joined(label, i[near], j[near])
        i, j = ids, ids[label]
        return pa.table({"i": i[i != j], "j": j[i != j]})

    home = index.classes.join(rows.select("cls"), "cls", "left_semi").select("chunk", "cls", "v")
    queries = home.select(F.col("cls").alias("q"), "v", F.lit(float(eps)).alias("rad"))
    return meet(index.visits(queries), home, task, "i long, j long", index, queries, spanning_links)


def spanning_edges(index: Index, cores: DataFrame) -> DataFrame:
    """a, b, w: a minimum spanning tree of the classes ``cores`` (q, core) under mutual
    reachability max(core a, core b, distance), by rounds of Borůvka.

    In each round every component takes its cheapest edge to another one (equal weights
    by the smaller, then the larger end, so no circle can arise) and components that
    are joined become one.  How far a component has to look is bounded first: by the
    cheapest edge inside its own chunks, and by the nearest cell that holds another
    component.  Rows whose core distance is beyond that bound do not search, and neither
    does the component with the most rows: the others join it."""
    d, slack = index.d, index.slack
    state = written_table(index.classes.join(cores.where("core is not null").withColumnRenamed("q", "cls"), "cls")
                          .select("cls", "v", "cell", "chunk", "core", F.col("cls").alias("comp")), "metric-state")
    rounds = []

    def inside(t):
        """Cheapest edge of each row to another component inside its chunk."""
        v, core, comp = matrix(t.column("v"), d), _numbers(t.column("core")), _numbers(t.column("comp"))
        best = np.full(len(v), np.inf)
        if (comp != comp[0]).any():
            for at in range(0, len(v), 512):
                w = np.maximum(np.maximum(about(v[at:at + 512], v), core[None, :]), core[at:at + 512, None])
                w[comp[at:at + 512, None] == comp[None, :]] = np.inf
                best[at:at + 512] = w.min(axis=1)
        return pa.table({"cls": _numbers(t.column("cls")), "bound": best + 2 * slack})

    def cheapest(a, b):
        q, c = _numbers(a.column("q")), _numbers(b.column("cls"))
        x, y = matrix(a.column("v"), d), matrix(b.column("v"), d)
        cx, cy, px, py = (_numbers(t.column(n)) for n in ("core", "comp") for t in (a, b))
        rad = _numbers(a.column("rad"))
        cols = {n: [] for n in ("comp", "w", "a", "b", "other")}
        for at in range(0, len(q), 512):
            w = np.maximum(np.maximum(about(x[at:at + 512], y), cy[None, :]), cx[at:at + 512, None])
            w[px[at:at + 512, None] == py[None, :]] = np.inf
            low = np.minimum(w.min(axis=1), rad[at:at + 512])
            i, j = np.nonzero((w <= low[:, None] + 2 * slack) & np.isfinite(w))
            i = i + at
            e = np.maximum(np.maximum(exact(x[i], y[j]), cy[j]), cx[i])
            lo, hi = np.minimum(q[i], c[j]), np.maximum(q[i], c[j])
            order = np.lexsort((hi, lo, e, px[i]))
            g = px[i][order]
            take = order[np.r_[True, g[1:] != g[:-1]]] if len(g) else order
            for n, z in zip(cols, (px[i], e, lo, hi, py[j])):
                cols[n].append(z[take])
        return pa.table({n: np.concatenate(z) for n, z in cols.items()})

    while True:
        parts = state.groupBy("comp").agg(F.count(F.lit(1)).alias("n")).agg(F.count(F.lit(1)), F.max_by("comp", F.struct("n", "comp"))).first()
        if parts[0] < 2:
            break
        most = parts[1]
        low, high, core_of = index.per_cell(state, F.min("comp"), F.max("comp"), F.max("core"))
        piv, radii = index.pivots, index.radii

        def beyond(batches, low=low, high=high, core_of=core_of):
            """The bound by whole cells: an edge to any member of a cell of another component."""
            for b in _slices(batches):
                v, core, comp = matrix(b.column(1), d), _numbers(b.column(3)), _numbers(b.column(4))
                to = np.maximum(np.maximum(about(v, piv) + radii + slack, core_of[None, :]), core[:, None])
                same = (low[None, :] == comp[:, None]) & (high[None, :] == comp[:, None])
                far = np.where(same | np.isnan(to), np.inf, to).min(axis=1)
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), b.column(3), b.column(4),
                                                  pa.array(np.minimum(far, _numbers(b.column(5))))],
                                                 names=["q", "v", "chunk", "core", "comp", "bound"])

        near = state.groupBy("chunk").applyInArrow(inside, "cls long, bound double")
        bounds = written_table(state.join(near, "cls").select("cls", "v", "chunk", "core", "comp", "bound").mapInArrow(
            beyond, "q long, v array<double>, chunk long, core double, comp long, bound double"), "metric-bounds")
        reach = bounds.groupBy("comp").agg(F.min("bound").alias("rad"))
        search = bounds.drop("chunk", "bound").where(F.col("comp") != most).join(reach, "comp").where("core <= rad").select("q", "v", "core", "comp", "rad")
        # chunks of one component only have nothing for that component
        only = state.groupBy("chunk").agg(F.min("comp").alias("_lo"), F.max("comp").alias("_hi"), F.min("core").alias("_core"))
        visits = index.visits(search).join(only, "chunk").where(
            "not (_lo = comp and _hi = comp) and _core <= rad").drop("_lo", "_hi", "_core")
        home = state.select("chunk", "cls", "v", "core", "comp")
        found = meet(visits, home, cheapest, "comp long, w double, a long, b long, other long", index, search,
                     first_rows("comp", ("w", "a", "b")))
        best = written_table(found.groupBy("comp").agg(F.min(F.struct("w", "a", "b", "other")).alias("e")).select(
            "comp", "e.w", "e.a", "e.b", "e.other"), "metric-best")
        rounds.append(best.select("a", "b", "w").distinct())
        links = best.select("comp", "other").unionByName(state.sparkSession.range(1).select(F.lit(most).alias("comp"), F.lit(most).alias("other")))
        state = written_table(state.join(_roots(links), "comp").select(
            "cls", "v", "cell", "chunk", "core", F.col("root").alias("comp")), "metric-state")
    if not rounds:
        return state.select(F.col("cls").alias("a"), F.col("cls").alias("b"), F.col("core").alias("w")).where("false")
    out = rounds[0]
    for r in rounds[1:]:
        out = out.unionByName(r)
    return written_table(out, "metric-edges")


def _roots(links: DataFrame) -> DataFrame:
    """comp, root of links comp -> other whose only circles are pairs that choose each
    other, and links to itself: pointers are doubled until they all end at the smaller of
    such a pair or at a link to itself."""
    back = links.select(F.col("comp").alias("other"), F.col("other").alias("back"))
    up = links.join(back, "other").select("comp", F.when((F.col("back") == F.col("comp")) & (F.col("comp") < F.col("other")), F.col("comp"))
                                          .otherwise(F.col("other")).alias("root"))
    while True:
        up = written_table(up, "metric-roots")
        step = up.join(up.select(F.col("comp").alias("root"), F.col("root").alias("next")), "root")
        if step.where("root <> next").isEmpty():
            return up
        up = step.select("comp", F.col("next").alias("root"))
