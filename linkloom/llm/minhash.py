"""MinHash near-duplicates with circulant permutations, confirmed on full sets.

A document is the set of its word shingles.  Two permutations of the 32-bit
numbers make its whole signature: the first scatters the shingles, the second,
shifted round by k, gives coordinate k as the least image of the set.

1. Signatures.  One pass over the whole texts gives each row its set size, a
   128-bit digest of the set and ``bands`` hashes of ``rows`` coordinates each.
   Rows of equal sets are one class from here on (one partial aggregate), however
   many copies there are.
2. Candidates.  Classes with an equal band hash meet at the least class of the band,
   their head.  Only classes that meet another are read again; their sets are written
   once.
3. Confirmation on whole sets.  The classes that met at a head go to one task, in
   blocks of bounded size that all hold the head.  The head is compared with all of
   its block; classes in its component by then are done, the others are compared with
   all of the block.  Only links that join something leave the task, never pairs.
4. In groups of more than one block, the classes that are still apart from their
   head's component are compared with the classes of the other blocks.

With 5 coordinates a band and 32 bands two sets of similarity 0.8 share no band
with a chance of 3e-6 (less for more similar ones); nothing else is lost.

Defined results: null text and text without words have an empty set, are linked
with nothing and kept; fewer words than a shingle make one shingle of them all;
a null id is linked like others but never names a component unless it is alone
(then its component is null); repeated ids name one component each row of the id;
extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkloom.llm.common import connected_components, stage

_U, _V = np.uint64, np.uint32
_P1, _P2 = _U(0x9E3779B97F4A7C15), _U(0xFF51AFD7ED558CCD)
#: shingles that are worked on at once
PIECE = 1 << 16
#: bytes of words that a task remembers
MEMO_BYTES = 16 << 20


class _WordHash(dict):
    """Hash of a word; forgets all when the words remembered take MEMO_BYTES."""
    held = 0

    def __missing__(self, word: bytes) -> int:
        self.held += len(word) + 120
        if self.held > MEMO_BYTES:
            self.clear()
            self.held = len(word) + 120
        h = self[word] = xxhash.xxh64_intdigest(word, 7)
        return h


def shingle_set(text: str | None, k: int, memo: dict) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the shingles of a text."""
    words = (text or "").encode().lower().split()  # bytes: A-Z and ASCII white space only
    if not words:
        return np.zeros(0, _U)
    h = np.fromiter(map(memo.__getitem__, words), dtype=_U, count=len(words))
    n = max(1, len(h) - k + 1)
    out = h[:n].copy()
    for i in range(1, min(k, len(h))):
        out = (out ^ (out >> _U(31))) * _P1 + h[i:i + n]
    # a short sequence differs from the shingle that its words begin
    out = (out ^ (out >> _U(33)) ^ _U(min(k, len(h)))) * _P2
    return np.unique(out ^ (out >> _U(29)))


def scatter(x: np.ndarray) -> np.ndarray:
    """First permutation, on the upper halves of the shingle hashes."""
    v = (x >> _U(32)).astype(_V) * _V(0x85EBCA6B)
    v ^= v >> _V(13)
    v *= _V(0xC2B2AE35)
    v ^= v >> _V(16)
    return v


def turned(v: np.ndarray, shift: int, room: np.ndarray, side: np.ndarray) -> np.ndarray:
    """Second permutation, shifted round by ``shift``; all steps are one-to-one on 32 bits."""
    np.add(v, _V(shift), out=room)
    for bits, factor in ((16, 0x7FEB352D), (15, 0x846CA68B)):
        np.right_shift(room, _V(bits), out=side)
        np.bitwise_xor(room, side, out=room)
        np.multiply(room, _V(factor), out=room)
    np.right_shift(room, _V(16), out=side)
    return np.bitwise_xor(room, side, out=room)


def signatures(sets: list[np.ndarray], coordinates: int) -> np.ndarray:
    """Circulant MinHash signatures, one row a set (empty sets: all ones)."""
    out = np.full((len(sets), coordinates), 0xFFFFFFFF, dtype=_V)
    todo: list[tuple[int, np.ndarray]] = []
    size = 0

    def work():
        at = np.cumsum([0] + [len(s) for _, s in todo[:-1]])
        v = scatter(np.concatenate([s for _, s in todo]))
        room, side = np.empty_like(v), np.empty_like(v)
        low = np.empty((len(todo), coordinates), dtype=_V)
        for k in range(coordinates):
            low[:, k] = np.minimum.reduceat(turned(v, k, room, side), at)
        who = [i for i, _ in todo]  # a set has one part at most in a round
        out[who] = np.minimum(out[who], low)

    for i, s in enumerate(sets):
        for a in range(0, len(s), PIECE):
            part = s[a:a + PIECE]
            if a and todo or size + len(part) > PIECE:
                work()
                todo, size = [], 0
            todo.append((i, part))
            size += len(part)
    if todo:
        work()
    return out


def band_hashes(sig: np.ndarray, rows: int) -> np.ndarray:
    """One 64-bit hash a band; the band's number is part of it."""
    s = sig.astype(_U)
    bands = s.shape[1] // rows
    h = np.arange(1, bands + 1, dtype=_U)[None, :] * _P1
    for r in range(rows):
        h = (h ^ s[:, r::rows][:, :bands]) * _P2
        h ^= h >> _U(32)
    return h.view(np.int64)


def describe(docs: DataFrame, k: int, bands: int, rows: int, id_col: str, text_col: str) -> DataFrame:
    """id, row (a number of its own), th and tn (text hash and bytes), n, d1, d2
    (digest of the set), bands (null for empty sets)."""
    def run(batches):
        memo = _WordHash()
        for b in batches:
            sets = [shingle_set(t, k, memo) for t in b.column(4).to_pylist()]
            n = np.array([len(s) for s in sets], dtype=np.int64)
            h = band_hashes(signatures(sets, bands * rows), rows)
            digest = [xxhash.xxh3_128_digest(s.tobytes()) for s in sets]
            d = np.frombuffer(b"".join(digest), dtype=np.int64).reshape(-1, 2)
            # offsets of a row without words are null: the row's list is null
            at = pa.array([i * bands if m else None for i, m in enumerate(n)] + [len(n) * bands], type=pa.int32())
            yield pa.RecordBatch.from_arrays(
                [*[b.column(i) for i in range(4)], pa.array(n), pa.array(d[:, 0]), pa.array(d[:, 1]),
                 pa.ListArray.from_arrays(at, pa.array(h.ravel()))],
                names=["id", "row", "th", "tn", "n", "d1", "d2", "bands"])

    text = F.col(text_col)
    return docs.select(F.col(id_col).cast("long").alias("id"), F.monotonically_increasing_id().alias("row"),
                       F.xxhash64(text).alias("th"), F.octet_length(text).alias("tn"), text.alias("text")).mapInArrow(
        run, "id long, row long, th long, tn int, n long, d1 long, d2 long, bands array<long>")


def sets_of(docs: DataFrame, keys: DataFrame, k: int, id_col: str, text_col: str) -> DataFrame:
    """cls, s: the sets of the classes ``keys`` (cls, id, th, tn), read from their first row's text."""
    def run(batches):
        memo = _WordHash()
        for b in batches:
            sets = [shingle_set(t, k, memo).view(np.int64) for t in b.column(1).to_pylist()]
            ends = np.cumsum([0] + [len(s) for s in sets]).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([*sets, np.zeros(0, np.int64)])))],
                names=["cls", "s"])

    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(text_col).alias("th"),
                        F.octet_length(text_col).alias("tn"), F.col(text_col).alias("text"))
    on = texts["id"].eqNullSafe(keys["id"]) & (texts["th"] == keys["th"]) & (texts["tn"] == keys["tn"])
    # one plan at every size: the texts meet the keys by an exchange, the keys are the hashed side
    sets = stage(texts.join(keys.hint("shuffle_hash"), on).select("cls", "text").mapInArrow(run, "cls long, s array<long>"), "minhash-sets")
    again = sets.groupBy("cls").agg(F.count(F.lit(1)).alias("m")).where("m > 1")
    # rows that repeat both id and text give a class more than one equal set
    return sets if again.isEmpty() else stage(sets.dropDuplicates(["cls"]), "minhash-sets")


class Group:
    """Sets side by side, as places in the list of their distinct shingles."""

    def __init__(self, sets: list[np.ndarray]):
        self.size = np.array([len(x) for x in sets], dtype=np.int64)
        self.start = np.cumsum(self.size) - self.size
        distinct, self.at = np.unique(np.concatenate(sets), return_inverse=True)
        self.mark = np.zeros(len(distinct), dtype=bool)

    def similar(self, i: int, percent: int) -> np.ndarray:
        """Places of the sets that are similar to the i-th, itself included."""
        mine = self.at[self.start[i]:self.start[i] + self.size[i]]
        self.mark[mine] = True
        both = np.add.reduceat(self.mark[self.at].astype(np.int32), self.start)
        self.mark[mine] = False
        return np.flatnonzero(both * 100 >= (self.size + self.size[i] - both) * percent)


def _sets(column) -> list[np.ndarray]:
    """Rows of a list column as arrays."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat, ends = column.values.to_numpy(), column.offsets.to_numpy()
    return [flat[a:b] for a, b in zip(ends, ends[1:])]


def group_links(classes: np.ndarray, sets: list[np.ndarray], percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Spanning links (a, b) of the similar pairs of a group whose first class is compared
    with all, and after it every class that is not in its component yet."""
    label = np.arange(len(classes))
    group = Group(sets)
    for i in range(len(classes)):
        if i and label[i] == label[0]:
            continue
        joined = np.unique(label[group.similar(i, percent)])
        label[np.isin(label, joined)] = joined[0]
    away = label != np.arange(len(label))
    return classes[away], classes[label[away]]


LINKS = "a long, b long"


def star_links(members: DataFrame, sets: DataFrame, percent: int, block: int) -> DataFrame:
    """a, b: links inside blocks of at most about ``block`` of the classes that met at a head
    (members: head, cls, m = their number); the head is in every block."""
    parts = F.expr(f"(m + {block - 1}) div {block}")
    rows = members.select("head", "cls", F.pmod(F.xxhash64("cls"), parts).alias("part")).union(
        members.select("head", F.col("head").alias("cls"), F.explode(F.sequence(F.lit(0).cast("long"), parts - 1)).alias("part")).distinct())

    def run(t):
        cls, head = t.column("cls").to_numpy(), t.column("head")[0].as_py()
        order = np.lexsort((cls, cls != head))
        every = _sets(t.column("s"))
        a, b = group_links(cls[order], [every[i] for i in order], percent)
        return pa.table({"a": a, "b": b})

    return rows.join(sets, "cls").groupBy("head", "part").applyInArrow(run, LINKS)


def late_links(members: DataFrame, sets: DataFrame, percent: int, block: int) -> DataFrame:
    """a, b: links of the classes of large groups that are apart from their head's component
    with classes of other components of the group (members: head, cls, part, head_part)."""
    late = members.where("part <> head_part")
    n_late = late.groupBy("head").agg(F.expr(f"(count(1) + {block - 1}) div {block}").alias("late_parts"))
    n_all = members.groupBy("head").agg(F.expr(f"(count(1) + {block - 1}) div {block}").alias("all_parts"))
    numbers = n_late.join(n_all, "head")
    mine = lambda n: F.pmod(F.xxhash64("cls"), F.col(n))
    others = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    left = late.join(numbers, "head").select("head", "cls", "part", mine("late_parts").alias("x"), others("all_parts").alias("y"))
    right = members.join(numbers, "head").select("head", "cls", "part", others("late_parts").alias("x"), mine("all_parts").alias("y"))

    def run(a, b):
        empty = np.zeros(0, np.int64)
        out = [(empty, empty)]
        if a.num_rows and b.num_rows:
            n = a.num_rows
            group = Group([*_sets(a.column("s")), *_sets(b.column("s"))])
            cls, part = (np.r_[a.column(c).to_numpy(), b.column(c).to_numpy()] for c in ("cls", "part"))
            for i in range(n):
                hit = group.similar(i, percent)
                hit = hit[part[hit] != part[i]]
                hit = hit[np.unique(part[hit], return_index=True)[1]]  # one link a component
                out.append((np.full(len(hit), cls[i]), cls[hit]))
        x, y = (np.concatenate(z) for z in zip(*out))
        return pa.table({"a": x, "b": y})

    # both sides come from one table: the copy has columns of its own
    keys, names = ["head", "x", "y"], ["cls", "head", "part", "x", "y", "s"]
    left, right = (side.join(sets, "cls").select(*names).toDF(*names) for side in (left, right))
    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(run, LINKS)


def near_duplicates(docs: DataFrame, words_in_shingle: int = 2, percent: int = 80, bands: int = 32, rows: int = 5,
                    id_col: str = "doc_id", text_col: str = "text", block: int = 512) -> DataFrame:
    """id, n (set size), component_id of every row: the smallest id that links reach."""
    docs, k = docs.select(id_col, text_col), words_in_shingle
    about = stage(describe(docs, k, bands, rows, id_col, text_col), "minhash-rows")
    rep = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "th", "tn")).alias("rep")
    classes = stage(about.where("n > 0").groupBy("d1", "d2", "n").agg(
        F.min("row").alias("cls"), rep, F.first("bands").alias("bands")), "minhash-classes")
    banded = classes.select("cls", F.explode("bands").alias("band"))
    heads = banded.groupBy("band").agg(F.min("cls").alias("head"), F.count(F.lit(1)).alias("m")).where("m > 1")
    met = stage(banded.join(heads, "band").where("cls <> head").select("head", "cls").distinct(), "minhash-met")
    wanted = met.select(F.explode(F.array("head", "cls")).alias("cls")).distinct()
    keys = stage(classes.join(wanted, "cls").select("cls", "rep.id", "rep.th", "rep.tn"), "minhash-keys")
    sets = sets_of(docs, keys, k, id_col, text_col)
    members = stage(met.join(met.groupBy("head").agg(F.count(F.lit(1)).alias("m")), "head"), "minhash-members")
    links = stage(star_links(members, sets, percent, block), "minhash-links")
    parts = stage(connected_components(links, "a", "b"), "minhash-parts")

    # groups of more than one block: classes that are still apart from their head meet all blocks
    large = members.where(F.col("m") > block)
    part_of = lambda c: parts.select(F.col("node").alias(c), F.col("component").alias(f"{c}_part"))
    whole = large.select("head", "cls").union(large.select("head", F.col("head").alias("cls")).distinct())
    placed = stage(whole.join(part_of("cls"), "cls", "left").join(part_of("head"), "head", "left").select(
        "head", "cls", F.coalesce("cls_part", "cls").alias("part"), F.coalesce("head_part", "head").alias("head_part")), "minhash-large")
    more = stage(late_links(placed, sets, percent, block), "minhash-late")
    named = parts.select(F.col("node").alias("a"), F.col("component").alias("ca")), parts.select(
        F.col("node").alias("b"), F.col("component").alias("cb"))
    between = more.join(named[0], "a", "left").join(named[1], "b", "left").select(
        F.coalesce("ca", "a").alias("u"), F.coalesce("cb", "b").alias("v"))
    joined = connected_components(between, "u", "v").withColumnRenamed("node", "part").withColumnRenamed("component", "top")

    tops = classes.select("d1", "d2", "n", "cls", "rep.id").join(
        parts.select(F.col("node").alias("cls"), F.col("component").alias("part")), "cls", "left").withColumn(
        "part", F.coalesce("part", "cls")).join(joined, "part", "left").withColumn("top", F.coalesce("top", "part"))
    tops = stage(tops.select("d1", "d2", "n", "top", "id"), "minhash-tops")
    smallest = tops.groupBy("top").agg(F.min("id").alias("component_id"))
    final = stage(tops.join(smallest, "top").select("d1", "d2", "n", "component_id"), "minhash-named")
    return about.join(final, ["d1", "d2", "n"], "left").select(
        "id", "n", F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("id")).alias("component_id"))
