"""SimHash near-duplicates through a Gray-order hierarchical index.

Fingerprints: a bit is set when it is set in over half of the 64-bit hashes of a
text's word shingles (whole texts).  Distinct fingerprints link when they differ
in at most ``max_bits`` bits; components of links are the groups.

Search is exact.  With max_bits + 1 blocks of bits, linked fingerprints agree in
at least one block, so each fingerprint enters one copy of the index a block,
turned so that this block leads.  Each copy is sorted by Gray rank, which keeps
near patterns together, and cut into range partitions (a block value that holds
many fingerprints spreads over several).  Inside a partition the sorted
fingerprints form a tree: every ``fan`` neighbours give an upper node that
factors out the bits they share (mask and pattern).  The self join goes down
from the roots of a block value by pairs of nodes; a pair whose shared patterns
already differ in more than max_bits bits is pruned with everything below, and a
pair that cannot differ in more is linked as a whole.  Tasks keep a spanning
forest of the links they find, never all pairs.  Upper nodes of block values that
go on in another partition meet through a join on the block value, pruned the same
way; only the surviving pairs of pieces fetch their fingerprints.

Defined results: null or empty texts have fingerprint 0, which links like any
other; fewer words than a shingle: the whole word sequence is the one shingle;
null ids take part and are answered with their component (the smallest non-null
id, or null); repeated rows are kept; extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from linkloom.llm.common import connected_components, give_back, stage

_U = np.uint64


def fingerprint(text: str | None, words_in_shingle: int = 3, seed: int = 42) -> int:
    """SimHash of one text: A-Z lower-cased, words between ASCII white space."""
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    n = max(1, len(words) - words_in_shingle + 1)
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words])
    starts = [0, *ends[:n - 1].tolist()]
    stops = (ends[min(words_in_shingle, len(words)) - 1:] - 1).tolist()
    h64 = xxhash.xxh64_intdigest
    h = np.array([h64(joined[a:b], seed) for a, b in zip(starts, stops)], dtype=_U)
    # a batch of rows at a time bounds the bit matrix of a very long text
    ones = np.zeros(64, dtype=np.int64)
    for at in range(0, n, 65536):
        ones += np.unpackbits(h[at:at + 65536].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > n).tobytes(), "big")


def fingerprints(docs: DataFrame, words_in_shingle: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, t, fp): t is the xxhash64 of the text, fp the 64 bits as a signed number."""
    def run(batches):
        for b in batches:
            fps = np.array([fingerprint(t, words_in_shingle) for t in b.column(1).to_pylist()], dtype=_U).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(fps)], names=["id", "t", "fp"])
        give_back()

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"),
                       F.xxhash64(F.col(text_col)).alias("t")).mapInArrow(run, "id long, t long, fp long")


def rotate(fp: np.ndarray, bits) -> np.ndarray:
    """64-bit patterns turned left."""
    bits = _U(bits)
    return fp if bits == 0 else (fp << bits) | (fp >> (_U(64) - bits))


def gray_rank(x: np.ndarray) -> np.ndarray:
    """Place of each 64-bit pattern in the reflected Gray code."""
    x = x.copy()
    for s in (1, 2, 4, 8, 16, 32):
        x ^= x >> _U(s)
    return x


def gray_code(rank: np.ndarray) -> np.ndarray:
    return rank ^ (rank >> _U(1))


def block_ends(max_bits: int) -> list[int]:
    n = max_bits + 1
    return [64 * (i + 1) // n for i in range(n)]


class Forest:
    """Union-find over the positions of an array."""

    def __init__(self, n: int):
        self.up = np.arange(n)

    def roots(self, i: np.ndarray) -> np.ndarray:
        r = self.up[i]
        while (r != self.up[r]).any():
            r = self.up[r]
        return r

    def link(self, a: np.ndarray, b: np.ndarray) -> None:
        """Join a[i] with b[i]; rounds of hooking larger roots under smaller ones."""
        while len(a):
            ra, rb = self.roots(a), self.roots(b)
            open_ = ra != rb
            a, b, ra, rb = a[open_], b[open_], ra[open_], rb[open_]
            np.minimum.at(self.up, np.maximum(ra, rb), np.minimum(ra, rb))


def link_sorted(codes: np.ndarray, key: np.ndarray, side: np.ndarray | None, max_bits: int, fan: int = 16,
                chunk: int = 4_000) -> tuple[np.ndarray, np.ndarray]:
    """Spanning links (positions a, b) among Gray-sorted patterns of equal key.

    codes: sorted by (key, Gray rank); side: with two sides, only pairs that
    cross sides are asked for (others may be linked as well)."""
    n = len(codes)
    forest = Forest(n)
    if n < 2:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    # levels of nodes: start positions, OR and AND of the members; nodes never cross a key
    starts = [np.arange(n)]
    ors, ands = [codes], [codes]
    keys = [key]
    while True:
        k = keys[-1]
        first = np.flatnonzero(np.r_[True, k[1:] != k[:-1]])
        run = np.diff(np.r_[first, len(k)])
        if run.max() == 1:
            break
        in_run = np.arange(len(k)) - np.repeat(first, run)
        heads = np.flatnonzero(in_run % fan == 0)
        starts.append(heads)  # index of the first child one level down
        ors.append(np.bitwise_or.reduceat(ors[-1], heads))
        ands.append(np.bitwise_and.reduceat(ands[-1], heads))
        keys.append(k[heads])
    top = len(starts) - 1
    rep = [np.arange(n)]  # first member position of each node
    for lv in range(1, top + 1):
        rep.append(rep[-1][starts[lv]])
    size = [np.diff(np.r_[rep[lv], n]) for lv in range(top + 1)]
    kids = [None] + [np.diff(np.r_[starts[lv], len(starts[lv - 1])]) for lv in range(1, top + 1)]
    roots = np.flatnonzero(size[top] > 1)
    stack = [(top, roots, roots)]
    while stack:
        lv, a, b = stack.pop()
        if len(a) > chunk:
            half = len(a) // 2
            stack += [(lv, a[:half], b[:half]), (lv, a[half:], b[half:])]
            continue
        o, d = ors[lv], ands[lv]
        shared = ~(o[a] ^ d[a]) & ~(o[b] ^ d[b])
        least = np.bitwise_count((d[a] ^ d[b]) & shared)
        keep = least <= max_bits
        a, b = a[keep], b[keep]
        if not len(a):
            continue
        most = np.bitwise_count((o[a] | o[b]) ^ (d[a] & d[b]))
        whole = most <= max_bits
        if whole.any():
            # every pair below is a link: chain the members of both nodes
            wa, wb = a[whole], b[whole]
            forest.link(rep[lv][wa], rep[lv][wb])
            for x in (np.unique(np.r_[wa, wb]),):
                many = x[size[lv][x] > 1]
                if len(many):
                    s, c = rep[lv][many], size[lv][many] - 1
                    inner = np.repeat(s, c) + (np.arange(c.sum()) - np.repeat(np.cumsum(c) - c, c))
                    forest.link(inner, inner + 1)
            a, b = a[~whole], b[~whole]
        if lv == 0 or not len(a):
            continue
        # children pairs (i of a, j of b); for a == b only i <= j
        ka, kb = kids[lv][a], kids[lv][b]
        per = ka * kb
        pair = np.repeat(np.arange(len(a)), per)
        t = np.arange(per.sum()) - np.repeat(np.cumsum(per) - per, per)
        i = starts[lv][a][pair] + t // kb[pair]
        j = starts[lv][b][pair] + t % kb[pair]
        ok = (i < j) | ((i == j) & (size[lv - 1][i] > 1))
        i, j = i[ok], j[ok]
        # pairs of members that are linked already bring nothing new
        if lv == 1:
            new = forest.roots(i) != forest.roots(j)
            i, j = i[new], j[new]
        stack.append((lv - 1, i, j))
    all_ = np.arange(n)
    r = forest.roots(all_)
    return all_[r != all_], r[r != all_]


def similar_links(distinct_fps: DataFrame, max_bits: int = 3, rows_a_piece: int = 20_000) -> DataFrame:
    """(src, dst) links that connect exactly the fingerprints (column fp) within
    reach of each other: a spanning set, not all pairs."""
    ends = block_ends(max_bits)
    widths = [e - s for s, e in zip([0, *ends], ends)]
    width = min(widths)

    def turn(batches):
        for b in batches:
            fp = b.column(0).to_numpy().view(_U)
            for k, e in enumerate(ends):
                # block k leads: its first bit becomes the highest
                rank = gray_rank(rotate(fp, (e - widths[k]) % 64))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(fp), k, np.int32)),
                     pa.array((rank ^ _U(1 << 63)).view(np.int64))], names=["turn", "rank"])

    turned = distinct_fps.select("fp").mapInArrow(turn, "turn int, rank long")
    n = distinct_fps.count() * len(ends)
    pieces = max(distinct_fps.sparkSession.sparkContext.defaultParallelism, -(-n // rows_a_piece))
    placed = stage(turned.repartitionByRange(pieces, "turn", "rank").sortWithinPartitions("turn", "rank")
                   .withColumn("piece", F.spark_partition_id()), "gray-order")

    def parts(b: pd.DataFrame):
        rank = b["rank"].to_numpy().view(_U) ^ _U(1 << 63)
        t = b["turn"].to_numpy()
        key = (t.astype(_U) << _U(32)) | (rank >> _U(64 - width))
        return t, rank, key, gray_code(rank)

    def back(code, t):
        """Fingerprints of turned patterns."""
        out = code.copy()
        for k, e in enumerate(ends):
            m = t == k
            out[m] = rotate(code[m], (64 - (e - widths[k])) % 64)
        return out.view(np.int64)

    def inside(b: pd.DataFrame) -> pd.DataFrame:
        b = b.sort_values(["turn", "rank"], kind="stable")
        t, rank, key, code = parts(b)
        i, j = link_sorted(code, key, None, max_bits)
        return pd.DataFrame({"src": back(code[i], t[i]), "dst": back(code[j], t[j])})

    within = placed.groupBy("piece").applyInPandas(inside, "src long, dst long")

    # block values that lie in several pieces: upper node of each (value, piece)
    key_sql = (F.shiftrightunsigned(F.col("rank").bitwiseXOR(F.lit(-2 ** 63)), 64 - width)
               + F.col("turn").cast("long") * F.lit(2 ** 32))
    rank_bits = F.col("rank").bitwiseXOR(F.lit(-2 ** 63))
    keyed = placed.select("piece", "turn", "rank", key_sql.alias("key"),
                          rank_bits.bitwiseXOR(F.shiftrightunsigned(rank_bits, 1)).alias("code"))
    nodes = keyed.groupBy("key", "piece").agg(F.bit_or("code").alias("o"), F.bit_and("code").alias("d"))
    spread = nodes.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("key")
    nodes = stage(nodes.join(spread, "key"), "gray-nodes")
    l = nodes.select("key", F.col("piece").alias("p1"), F.col("o").alias("o1"), F.col("d").alias("d1"))  # noqa: E741
    r = nodes.select("key", F.col("piece").alias("p2"), F.col("o").alias("o2"), F.col("d").alias("d2"))
    pairs = l.join(r, "key").where("p1 < p2").where(F.expr(
        f"bit_count((d1 ^ d2) & ~(o1 ^ d1) & ~(o2 ^ d2)) <= {max_bits}")).select("key", "p1", "p2")
    pairs = stage(pairs, "gray-pairs")
    rows = keyed.select("key", "piece", "turn", "rank")
    both = (pairs.withColumn("piece", F.col("p1")).unionByName(pairs.withColumn("piece", F.col("p2")))
            .join(rows, ["key", "piece"]).select("key", "p1", "p2", "turn", "rank"))
    across = both.groupBy("key", "p1", "p2").applyInPandas(inside, "src long, dst long")
    return within.union(across)


def near_duplicates(docs: DataFrame, words_in_shingle: int = 3, max_bits: int = 3, id_col: str = "doc_id",
                    text_col: str = "text") -> DataFrame:
    """id, fp, component_id of every row: component_id is the smallest id that
    links of at most max_bits bits reach."""
    fps = stage(fingerprints(docs, words_in_shingle, id_col, text_col), "simhash")
    reps = fps.groupBy("fp").agg(F.min("id").alias("rep"))
    links = similar_links(reps.select("fp"), max_bits)
    groups = connected_components(links)
    named = reps.join(groups.withColumnRenamed("node", "fp"), "fp", "left").withColumn(
        "component", F.coalesce("component", "fp"))
    ids = named.groupBy("component").agg(F.min("rep").alias("component_id"))
    classes = stage(named.join(ids, "component").select("fp", "component", "component_id"), "simhash-classes")
    return fps.join(classes, "fp").select("id", "t", "fp", "component", "component_id")


def keep_one(docs: DataFrame, words_in_shingle: int = 3, max_bits: int = 3, id_col: str = "doc_id",
             text_col: str = "text") -> DataFrame:
    """One row of each group of ``docs``, all columns: the one with the smallest id (null last), then text hash."""
    groups = near_duplicates(docs, words_in_shingle, max_bits, id_col, text_col)
    best = groups.groupBy("component").agg(F.min(F.struct(F.col("id").isNull().alias("n"), "id", "t")).alias("b"))
    best = best.select(F.col("b.id").alias("_keep_id"), F.col("b.t").alias("_keep_t"))
    # a struct keeps the columns apart, whatever their names
    rows = docs.select(F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias("d"), docs[id_col].cast("long").alias("i"),
                       F.xxhash64(docs[text_col]).alias("h"))
    kept = rows.join(best.hint("shuffle_hash"), F.col("i").eqNullSafe(F.col("_keep_id")) & (F.col("h") == F.col("_keep_t")))
    # repeated rows of a kept document
    w = Window.partitionBy("_keep_id", "_keep_t").orderBy(F.lit(0))
    return kept.withColumn("_row", F.row_number().over(w)).where("_row = 1").select("d.*")
