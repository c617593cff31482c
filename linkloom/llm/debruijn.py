"""Substring deduplication on a De Bruijn graph of token k-mers.

Words are tokens; a window of k words is an edge from its first k-1 words to its
last k-1.  An edge is repeated when its words also start in another document, and
a document loses the words of every window that also starts in a document with a
smaller id, judged on the input.

1. Seeds.  Every window has a minimizer (the least hash of its s-word parts), so
   equal windows have equal minimizers and about a fifth of the positions speak
   for all windows.  Minimizers of two documents are found in one shuffle.  Those
   that repeat inside a batch of documents are settled there and send one row, so
   a passage in a third of all documents is no hot key.
2. Edges.  Only windows with a repeated minimizer become edges, by the hash of
   their words.  Again a batch settles its own repeats; the rest meet by hash.  A
   repeated edge gets the source coordinate (document, position) of an
   occurrence with a smaller id.
3. Compaction.  Occurrences whose source runs along with them (both one word
   further) join into path pieces.  A piece that starts or ends inside a source is
   a branch there; the source's branch points, joined back, cut pieces into
   nonbranching paths.
4. Verification.  The 128-bit digest of each path's words is taken at its source
   coordinates and joined to the copies; only words whose digest agrees go.
Exact copies of whole documents are settled first, by the hash of their text.

Defined results: null text has no words; null doc_id rows are neither source nor
copy and are kept whole; texts under k words have no window; repeated rows
(same id and text) give repeated results; of different texts under one doc_id the
one with the least hash takes part, the others are kept whole; equal ids never
remove from each other; extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkloom.llm.common import give_back

_U = np.uint64
_P = _U(0x9E3779B97F4A7C15)
#: bytes of words that a task remembers
MEMO_BYTES = 16 << 20


class _WordHash(dict):
    held = 0

    def __missing__(self, word):
        self.held += len(word) + 150
        if self.held > MEMO_BYTES:
            self.forget()
        h = self[word] = xxhash.xxh64_intdigest(word, 11)
        return h

    def forget(self):
        self.clear()
        self.held = 0


_HASH = _WordHash()


def split_words(text: str) -> list[bytes]:
    """Words between ASCII white space, unchanged."""
    return text.encode().split()


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(_HASH.__getitem__, words), dtype=_U, count=len(words))


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(33))) * _U(0xFF51AFD7ED558CCD)
    return x ^ (x >> _U(29))


def gram_hashes(h: np.ndarray, k: int) -> np.ndarray:
    """Hash of every k consecutive words."""
    n = len(h) - k + 1
    out = h[:n].copy()
    for i in range(1, k):
        out *= _P
        out += h[i:n + i]
    return _mix(out)


def minimizers(h: np.ndarray, k: int, s: int) -> np.ndarray:
    """The minimizer hash of every window of k words."""
    g = gram_hashes(h, s)
    low = g[:len(h) - k + 1].copy()
    for i in range(1, k - s + 1):
        np.minimum(low, g[i:i + len(low)], out=low)
    return low


def _long(a) -> pa.Array:
    a = np.asarray(a)
    return pa.array(a.view(np.int64) if a.dtype == _U else a.astype(np.int64))


def _batch(names, *cols):
    return pa.RecordBatch.from_arrays([_long(c) for c in cols], names=names)


def _cat(parts, dtype=np.int64):
    return np.concatenate(parts) if parts else np.zeros(0, dtype)


def _seeds(k, s):
    names = ["route", "mh", "doc_id", "kind"]

    def run(batches):
        """kind 0: asks for a reply; 1: repeated in this batch, tells the others; 2: settled reply."""
        for b in batches:
            hs, ds = [], []
            for d, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                w = split_words(t)
                if len(w) >= k:
                    u = np.unique(minimizers(word_hashes(w), k, s))
                    hs.append(u)
                    ds.append(np.full(len(u), d, np.int64))
            mh, doc = _cat(hs, _U), _cat(ds)
            if not len(mh):
                continue
            order = np.lexsort((doc, mh))
            mh, doc = mh[order], doc[order]
            head = np.r_[True, mh[1:] != mh[:-1]]
            group = np.cumsum(head) - 1
            first = np.flatnonzero(head)
            last = np.r_[first[1:], len(mh)] - 1
            many = (doc[first] != doc[last])[group]
            tell = first[doc[first] != doc[last]]
            z = lambda n, v: np.full(n, v, np.int64)
            single, settled = ~many, many
            yield _batch(names, np.r_[mh[single], mh[tell], _mix(doc[settled].astype(_U))],
                         np.r_[mh[single], mh[tell], mh[settled]], np.r_[doc[single], doc[tell], doc[settled]],
                         np.r_[z(single.sum(), 0), z(len(tell), 1), z(settled.sum(), 2)])
        _HASH.forget()  # the worker lives on after its task
        give_back()
    return run, "route long, mh long, doc_id long, kind long"


def _whole_partition(batches):
    got = [[c.to_numpy(zero_copy_only=False) for c in b.columns] for b in batches if b.num_rows]
    return [np.concatenate(c) for c in zip(*got)] if got else None


def _replies(batches):
    """(doc_id, mh) of the minimizers that two documents hold."""
    got = _whole_partition(batches)
    if got is None:
        return
    _, mh, doc, kind = got
    done = kind == 2
    ask = np.flatnonzero(~done)
    order = ask[np.lexsort((doc[ask], mh[ask]))]
    m, d, told = mh[order], doc[order], kind[order] == 1
    out_d, out_m = [doc[done]], [mh[done]]
    if len(m):
        head = np.r_[True, m[1:] != m[:-1]]
        group = np.cumsum(head) - 1
        first = np.flatnonzero(head)
        last = np.r_[first[1:], len(m)] - 1
        many = (d[first] != d[last]) | np.logical_or.reduceat(told, first)
        hit = many[group] & ~told
        out_d.append(d[hit])
        out_m.append(m[hit])
    yield _batch(["doc_id", "mh"], _cat(out_d), _cat(out_m))


def _runs(doc, pos, odoc, opos):
    """Path pieces (doc, start, edges, odoc, ostart) of resolved occurrences."""
    order = np.lexsort((pos, doc))
    doc, pos, odoc, opos = doc[order], pos[order], odoc[order], opos[order]
    new = np.r_[True, (doc[1:] != doc[:-1]) | (pos[1:] != pos[:-1] + 1) | (odoc[1:] != odoc[:-1]) | (opos[1:] != opos[:-1] + 1)] \
        if len(doc) else np.zeros(0, bool)
    first = np.flatnonzero(new)
    return doc[first], pos[first], np.diff(np.r_[first, len(doc)]), odoc[first], opos[first]


_EDGE = ["route", "kh", "doc", "pos", "len", "odoc", "opos"]


def _edges(k, s):
    def run(batches):
        """Open edges (odoc -1) and pieces settled inside the batch (kh 0)."""
        for b in batches:
            kh, doc, pos = [], [], []
            for d, t, wanted in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2)):
                h = word_hashes(split_words(t))
                if len(h) < k:
                    continue
                hit = np.flatnonzero(np.isin(minimizers(h, k, s), wanted.values.to_numpy().view(_U)))
                kh.append(gram_hashes(h, k)[hit])
                pos.append(hit)
                doc.append(np.full(len(hit), d, np.int64))
            kh, doc, pos = _cat(kh, _U), _cat(doc), _cat(pos)
            if not len(kh):
                continue
            order = np.lexsort((pos, doc, kh))
            kh, doc, pos = kh[order], doc[order], pos[order]
            head = np.flatnonzero(np.r_[True, kh[1:] != kh[:-1]])
            src = np.repeat(head, np.diff(np.r_[head, len(kh)]))
            later = doc != doc[src]
            p = _runs(doc[later], pos[later], doc[src][later], pos[src][later])
            n, m = (~later).sum(), len(p[0])
            yield _batch(_EDGE, np.r_[kh[~later], _mix(p[0].astype(_U))], np.r_[kh[~later], np.zeros(m, _U)],
                         np.r_[doc[~later], p[0]], np.r_[pos[~later], p[1]], np.r_[np.ones(n, np.int64), p[2]],
                         np.r_[np.full(n, -1), p[3]], np.r_[np.full(n, -1), p[4]])
        _HASH.forget()
        give_back()
    return run, ", ".join(f"{c} long" for c in _EDGE) + ", open boolean"


def _resolve(batches):
    """Occurrences and pieces with a source: (doc, pos, len, odoc, opos)."""
    got = _whole_partition(batches)
    if got is None:
        return
    _, kh, doc, pos, n, odoc, opos = got[:7]
    open_ = got[7].astype(bool)
    names = ["doc", "pos", "len", "odoc", "opos"]
    if (~open_).any():
        yield _batch(names, doc[~open_], pos[~open_], n[~open_], odoc[~open_], opos[~open_])
    kh, doc, pos = kh[open_], doc[open_], pos[open_]
    if len(kh):
        order = np.lexsort((pos, doc, kh))
        kh, doc, pos = kh[order], doc[order], pos[order]
        head = np.flatnonzero(np.r_[True, kh[1:] != kh[:-1]])
        src = np.repeat(head, np.diff(np.r_[head, len(kh)]))
        later = doc != doc[src]
        yield _batch(names, doc[later], pos[later], np.ones(later.sum(), np.int64), doc[src][later], pos[src][later])


def _pieces(batches):
    """Joins occurrences of a document into pieces; all rows of a document are in the partition."""
    got = _whole_partition(batches)
    if got is None:
        return
    doc, pos, n, odoc, opos = got
    one = n == 1
    a = _runs(doc[one], pos[one], odoc[one], opos[one])
    yield _batch(["doc", "start", "len", "odoc", "ostart"], *[np.r_[x, y[~one]] for x, y in zip(a, got)])


def digest(words: list[bytes]) -> bytes:
    return xxhash.xxh128_digest(b" ".join(words))


def _path_digests(k):
    def run(batches):
        """Digest of the words of each path between neighbouring cuts of a source."""
        for b in batches:
            out = []
            for t, cuts in zip(b.column(1).to_pylist(), b.column(2).to_pylist()):
                w = split_words(t)
                out.append([digest(w[p:q + k - 1]) for p, q in zip(cuts, cuts[1:])])
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(out, type=pa.list_(pa.binary()))],
                                             names=["odoc", "cuts", "digests"])
    return run, "odoc long, cuts array<long>, digests array<binary>"


def covered_words(words: list[bytes], paths, k: int) -> np.ndarray:
    """Mask of the words of the paths [(start, cuts, digests)] whose digests agree."""
    edge = np.zeros(len(words) + 1, dtype=np.int64)
    for p in paths:
        start, cuts, digests = p["start"], p["cuts"], p["digests"]
        for a, b, want in zip(cuts, cuts[1:], digests):
            lo, hi = start + a - cuts[0], start + b - cuts[0] + k - 1
            if digest(words[lo:hi]) == want:
                edge[lo] += 1
                edge[hi] -= 1
    return np.cumsum(edge[:-1]) > 0


def _rest(docs: DataFrame, text_col: str):
    """The columns of a row beside its text, which is carried once, and whether that is null."""
    others = [F.col(c).alias(f"c{i}") for i, c in enumerate(docs.columns) if c != text_col]
    return F.struct(*others, F.col(text_col).isNull().alias("no_text")).alias("row")


def path_pieces(docs: DataFrame, k: int = 13, s: int = 5, id_col: str = "doc_id", text_col: str = "text",
                carry: bool = False):
    """(rows, live, pieces).  rows: doc_id, text, t (text hash), copy (the whole text is in a smaller
    document), aside (takes no part); live: rows that are neither.  pieces: doc, start, len, odoc,
    ostart: len edges of doc from start on run along the source odoc from ostart on.

    All tables are parts of one plan, so the exchange of the texts by doc_id is made once."""
    # no alias where none is needed: a redundant one keeps the optimizer from reusing the exchange of the texts
    ident = F.col("doc_id") if (id_col, dict(docs.dtypes)[id_col]) == ("doc_id", "bigint") else F.col(id_col).cast("long").alias("doc_id")
    x = docs.select(ident, F.coalesce(text_col, F.lit("")).alias("text"), *([_rest(docs, text_col)] * carry))
    x = x.where("doc_id is not null").withColumn("t", F.xxhash64("text"))
    h = x.select("doc_id", "t", F.sha2("text", 256).alias("sha"))
    first = h.groupBy("sha").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).where("first < last")
    copies = h.join(first, "sha").where("doc_id > first").select("doc_id", F.col("t").alias("copy_t"), F.lit(None).cast("long").alias("only_t"))
    mixed = h.groupBy("doc_id").agg(F.min("t").alias("a"), F.max("t").alias("b")).where("a <> b").select(
        "doc_id", F.lit(None).cast("long").alias("copy_t"), F.col("a").alias("only_t"))
    marks = copies.unionByName(mixed).groupBy("doc_id").agg(F.collect_set("copy_t").alias("copy_t"), F.min("only_t").alias("only_t"))
    x = x.join(marks.hint("shuffle_hash"), "doc_id", "left").select(
        "doc_id", "text", "t", *(["row"] * carry), F.coalesce(F.array_contains("copy_t", F.col("t")), F.lit(False)).alias("copy"),
        F.coalesce(F.col("only_t") != F.col("t"), F.lit(False)).alias("aside"))
    live = x.where("not copy and not aside")

    run, schema = _seeds(k, s)
    seeds = live.select("doc_id", "text").mapInArrow(run, schema).repartition("route")
    replies = seeds.mapInArrow(_replies, "doc_id long, mh long")
    wanted = replies.groupBy("doc_id").agg(F.collect_set("mh").alias("mhs"))
    run, schema = _edges(k, s)
    edges = (live.join(wanted.hint("shuffle_hash"), "doc_id").select("doc_id", "text", "mhs")
             .mapInArrow(run, schema.replace(", open boolean", "")))
    edges = edges.withColumn("open", F.col("odoc") == -1).repartition("route")
    resolved = edges.mapInArrow(_resolve, "doc long, pos long, len long, odoc long, opos long")
    pieces = resolved.repartition("doc").mapInArrow(_pieces, "doc long, start long, len long, odoc long, ostart long")
    return x, live, pieces


def drop_repeats(docs: DataFrame, k: int = 13, s: int = 5, id_col: str = "doc_id", text_col: str = "text",
                 keep_rows: bool = False) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 of every row.

    keep_rows: also kept_text (the text itself, where nothing went) and row (the other columns
    by position, and whether the text is null)."""
    x, live, pieces = path_pieces(docs, k, s, id_col, text_col, keep_rows)
    cuts = pieces.select(F.col("odoc").alias("doc_id"), F.explode(F.array(F.col("ostart"), F.col("ostart") + F.col("len"))).alias("c"))
    cuts = cuts.groupBy("doc_id").agg(F.sort_array(F.collect_set("c")).alias("cuts"))
    run, schema = _path_digests(k)
    sources = live.join(cuts.hint("shuffle_hash"), "doc_id").select("doc_id", "text", "cuts").mapInArrow(run, schema)
    at, to = F.array_position("cuts", F.col("ostart")), F.array_position("cuts", F.col("ostart") + F.col("len"))
    paths = pieces.join(sources, "odoc").select(
        "doc", "start", F.slice("cuts", at, (to - at + 1).cast("int")).alias("cuts"),
        F.slice("digests", at, (to - at).cast("int")).alias("digests"))
    paths = paths.groupBy(F.col("doc").alias("doc_id")).agg(F.collect_list(F.struct("start", "cuts", "digests")).alias("paths"))

    names = ["doc_id", "n_words", "n_removed", "kept_sha256"] + ["kept_text", "row"] * keep_rows
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string()]

    def finish(batches):
        for b in batches:
            rows = []
            for d, t, copy, paths in zip(*(b.column(i).to_pylist() for i in range(4))):
                w = split_words(t)
                if copy and len(w) >= k:
                    kept = []
                elif paths and not copy:
                    gone = covered_words(w, paths, k)
                    kept = [x for x, g in zip(w, gone) if not g]
                else:
                    kept = w
                joined = b" ".join(kept)
                row = [d, len(w), len(w) - len(kept), hashlib.sha256(joined).hexdigest()]
                rows.append(row + [joined.decode() if len(kept) < len(w) else t] * keep_rows)
            cols = list(zip(*rows)) or [[]] * (4 + keep_rows)
            yield pa.RecordBatch.from_arrays([*[pa.array(c, type=y) for c, y in zip(cols, kinds)],
                                              *([b.column(4)] if keep_rows else [])], names=names)

    schema = "doc_id long, n_words long, n_removed long, kept_sha256 string"
    if keep_rows:
        schema += f", kept_text string, row {docs.select(_rest(docs, text_col)).schema['row'].dataType.simpleString()}"
    row = ["row"] * keep_rows
    full = x.join(paths.hint("shuffle_hash"), "doc_id", "left").select(
        "doc_id", "text", "copy", F.when(~F.col("aside"), F.col("paths")).alias("paths"), *row)
    lone = docs.where(F.col(id_col).isNull()).select(
        F.lit(None).cast("long").alias("doc_id"), F.coalesce(text_col, F.lit("")).alias("text"), F.lit(False).alias("copy"),
        F.lit(None).cast("array<struct<start:bigint,cuts:array<bigint>,digests:array<binary>>>").alias("paths"),
        *([_rest(docs, text_col)] * keep_rows))
    return full.unionByName(lone).mapInArrow(finish, schema)


def keep_rest(docs: DataFrame, k: int = 13, s: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs``, all columns, without repeated windows; rows of which nothing is left go."""
    x = drop_repeats(docs, k, s, id_col, text_col, keep_rows=True).where("n_removed = 0 or n_removed < n_words")
    return x.select(*[F.when(~F.col("row.no_text"), F.col("kept_text")).alias(c) if c == text_col
                      else F.col(f"row.c{i}").alias(c) for i, c in enumerate(docs.columns)])
