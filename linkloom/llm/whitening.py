"""Whitening of embeddings by Golub-Kahan-Lanczos bidiagonalisation.

Every entry c becomes the integer x = floor(scale * c) + shift; sums over rows are
exact integers.  The centred rows (n x - S) / n form the matrix X.  Starting from
a unit vector v, each step takes

    u = X v - beta u'          (distributed: every row gives its entry of u)
    v = X^T u - alpha v'       (distributed: rows are added up)

and takes off what is left of all earlier u and v (full reorthogonalisation).  The
entries of u are never stored: every left vector is X w with a known short w, so a
step is one stateless pass over the written rows, which a lost executor repeats,
and only dimension-sized sums come back, added up by Spark.  The alphas and betas
make the small bidiagonal matrix B with X V = U B; its singular values and right
vectors give eigenvalues s^2 / n and components.  Steps go on until the wanted
singular values have settled to double precision or all dimensions are spanned; a
space that closes early goes on from a new direction.

Defined results: rows whose vector is null, empty, of another length than the most
frequent one (ties: the shorter) or holds null or non-finite entries take no part;
null ids and repeated rows count and are returned; components without variance are
left out (one row, or equal rows only: no result); a deviation too large for a long
is null; components are told apart by falling eigenvalue, their sign makes their
largest entry positive; extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkloom.llm.common import stage


def whole_numbers(df: DataFrame, id_col: str, vec_col: str, scale: float, shift: int) -> DataFrame:
    """id, x (array of long) of the rows that take part."""
    x = df.select(F.col(id_col).alias("id"), F.col(vec_col).cast("array<double>").alias("v")).where(
        "size(v) > 0 and forall(v, c -> c is not null and abs(c) <= 1.7976931348623157e308D and not isnan(c))")
    size = x.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").first()
    return x.where(F.size("v") == (size["d"] if size else 0)).select(
        "id", F.expr(f"transform(v, c -> floor({float(scale)!r}D * c) + {int(shift)}L)").alias("x"))


def _matrix(column, d: int) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, d)


class Rows:
    """The written rows, with exact sums and passes over the centred ones."""

    def __init__(self, rows: DataFrame):
        self.df = rows
        sums = rows.select(F.posexplode("x").alias("i", "x")).groupBy("i").agg(
            F.count(F.lit(1)).alias("n"), F.sum(F.col("x").cast("decimal(38,0)")).alias("s"),
            F.max(F.abs("x")).alias("m")).toArrow().to_pylist()  # one row a dimension
        sums.sort(key=lambda r: r["i"])
        self.n = sums[0]["n"] if sums else 0
        self.d = len(sums)
        self.sums = [int(r["s"]) for r in sums]
        self.fits = all(self.n * r["m"] + abs(int(r["s"])) < 2 ** 62 for r in sums)

    def centred(self, x: np.ndarray) -> np.ndarray:
        """(n x - S) / n: exact before the division where the numbers fit."""
        if self.fits:
            return (self.n * x - np.array(self.sums, dtype=np.int64)) / self.n
        return x - np.array([s / self.n for s in self.sums])

    def total(self, of) -> np.ndarray:
        """Sum of ``of(centred block)``, a fixed number of doubles, over all blocks."""
        d, centred = self.d, self.centred

        def run(batches):
            out = None
            for b in batches:
                part = of(centred(_matrix(b.column(0), d)))
                out = part if out is None else out + part
            if out is not None:
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(out))), pa.array(out)], names=["i", "t"])

        got = self.df.select("x").mapInArrow(run, "i long, t double").groupBy("i").agg(F.sum("t").alias("t")).toArrow()
        out = np.zeros(got.num_rows)
        out[got.column("i").to_numpy()] = got.column("t").to_numpy()
        return out

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k != "df"}


def _off(x: np.ndarray, basis: list[np.ndarray]) -> np.ndarray:
    """x without what lies in the span of the basis (twice is enough)."""
    for _ in range(2):
        for b in basis:
            x = x - (b @ x) * b
    return x


def bidiagonalise(rows: Rows, keep: int, tiny: float, locked: list[np.ndarray], rng, tolerance: float = 1e-13):
    """(singular values, right vectors as rows, whether all is spanned) of the centred rows
    across the ``locked`` directions; the first ``keep`` have settled."""
    d = rows.d

    def fresh(vs):
        """A unit vector across all earlier ones."""
        x = _off(rng.standard_normal(d), [*locked, *vs])
        return x / np.linalg.norm(x)

    vs, ws, zs = [fresh([])], [], []  # right vectors, short forms of the left ones, X^T u
    alphas, betas = [], []
    while True:
        # short form of u = X v - beta u': the pass gives U^T u, u^T u and X^T u at once
        w = vs[-1] - (betas[-1] * ws[-1] if betas else 0.0)
        known = np.array(ws).reshape(-1, d)

        def both(c, w=w, known=known):
            u = c @ w
            return np.concatenate([(c @ known.T).T @ u, [u @ u], c.T @ u])

        got = rows.total(both)
        k = len(ws)
        along, square, z = got[:k], got[k], got[k + 1:]
        if k:  # full reorthogonalisation against all earlier left vectors
            w = w - along @ known
            square -= float(along @ along)
            z = z - along @ np.array(zs)
        alpha = math.sqrt(max(square, 0.0))
        if alpha > tiny:
            w, z = w / alpha, z / alpha
        else:
            alpha, w, z = 0.0, np.zeros(d), np.zeros(d)
        alphas.append(alpha)
        ws.append(w)
        zs.append(z)
        rest = _off(z - alpha * vs[-1], [*locked, *vs])
        beta = float(np.linalg.norm(rest))
        left, s, right = np.linalg.svd(np.diag(alphas) + np.diag(betas, 1))
        whole = len(vs) + len(locked) == d
        if whole or len(s) >= keep and beta > tiny and (beta * np.abs(left[-1, :keep]) <= tolerance * s[0]).all():
            return s, right @ np.array(vs), whole
        if beta > tiny:
            betas.append(beta)
            vs.append(rest / beta)
        else:
            betas.append(0.0)
            vs.append(fresh(vs))


def components(rows: Rows, keep: int, seed: int = 0):
    """(eigenvalues, components as rows, trace): at most ``keep``, by falling eigenvalue.

    One Krylov space holds one direction of a repeated singular value.  When the first
    have settled early, further spaces across them are searched until the largest
    value there is below all that are kept."""
    d, n, rng = rows.d, rows.n, np.random.default_rng(seed)
    trace = float(rows.total(lambda c: np.array([(c * c).sum()]))[0]) if n else 0.0
    if trace <= 0:
        return np.zeros(0), np.zeros((0, d)), 0.0
    tiny = math.sqrt(trace) * 1e-12
    s, v, whole = bidiagonalise(rows, keep, tiny, [], rng)
    s, v = s[:keep], v[:keep]
    while not whole and len(s) < d:
        more, across, whole = bidiagonalise(rows, 1, tiny, list(v), rng)
        if whole and len(s) + len(more) == d:
            s, v = np.r_[s, more], np.r_[v, across]
        elif len(s) >= keep and more[0] <= np.sort(s)[-keep]:
            break
        else:
            s, v = np.r_[s, more[:1]], np.r_[v, across[:1]]
    order = [i for i in np.argsort(-s, kind="stable")[:keep] if s[i] > tiny]
    parts = v[order].reshape(-1, d)
    parts /= np.linalg.norm(parts, axis=1, keepdims=True)
    top = np.abs(parts).argmax(axis=1)
    parts *= np.sign(parts[np.arange(len(parts)), top])[:, None]
    return s[order] ** 2 / n, parts, trace / n


def whiten(df: DataFrame, keep: int = 8, scale: float = 1024.0, shift: int = 100_000, id_col: str = "vec_id",
           vec_col: str = "embedding") -> DataFrame:
    """id, component (from 1), n, deviation, whitened, explained, identity_error: a row
    for every row that takes part and each of the first ``keep`` components."""
    rows = Rows(stage(whole_numbers(df, id_col, vec_col, scale, shift), "whitening-rows"))
    values, parts, trace = components(rows, keep)
    k, d, n, sums, fits = len(values), rows.d, rows.n, rows.sums, rows.fits
    schema = "component int, n long, deviation long, whitened double, explained double, identity_error double"
    if not k:
        return rows.df.select("id", *[F.lit(None).cast(t).alias(c) for c, t in (
            x.split() for x in schema.split(", "))]).where("false")
    turn = parts.T / np.sqrt(values)

    def moments(c):
        z = c @ turn
        return np.concatenate([z.sum(0), (z.T @ z).ravel()])

    m = rows.total(moments)
    covariance = m[k:].reshape(k, k) / n - np.outer(m[:k], m[:k]) / n ** 2
    error = float(np.abs(covariance - np.eye(k)).max())
    explained, centred = values / trace, rows.centred

    def deviations(x: np.ndarray):
        """Exact sums of (n x - S)^2; None where a long cannot hold them."""
        if fits:
            y = n * x - np.array(sums, dtype=np.int64)
            if float((y.astype(float) ** 2).sum(axis=1).max(initial=0)) < 2 ** 62:
                return (y * y).sum(axis=1).tolist()
        exact = [sum((n * a - s) ** 2 for a, s in zip(r, sums)) for r in x.tolist()]
        return [e if e < 2 ** 63 else None for e in exact]

    def run(batches):
        for b in batches:
            x = _matrix(b.column(1), d)
            z = centred(x) @ turn
            at = pa.array(np.repeat(np.arange(len(x)), k))
            dev = pa.array(deviations(x), type=pa.int64())
            size = len(x) * k
            yield pa.RecordBatch.from_arrays(
                [b.column(0).take(at), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(x))),
                 pa.array(np.full(size, n, dtype=np.int64)), dev.take(at), pa.array(z.ravel()),
                 pa.array(np.tile(explained, len(x))), pa.array(np.full(size, error))],
                names=["id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    kind = rows.df.schema["id"].dataType.simpleString()
    return rows.df.mapInArrow(run, f"id {kind}, {schema}")
