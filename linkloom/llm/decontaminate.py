"""Benchmark decontamination: CGK embedding, bit-sampling LSH, exact edit check.

Words are tokens (lower case, punctuation at the ends dropped).  A benchmark item
of n words is found in a document where some run of words (``substrings``) or some
window of n words (the default) is within d = floor((1 - similarity) n) word edits
of it.

1. Gate, without loss.  An item within d edits of a run shares at least one of
   its d + 1 segments with it, near the same place.  Only windows that start
   within d words of such a seed, with n - d words of the item around, go on.
2. CGK.  A random walk copies a window into 3 n symbols: at step j it writes the
   word under the pointer and moves on if a random bit of (j, word) says so.  Two
   near windows fall into step again after an edit, so edit distance becomes
   Hamming distance.  Windows are padded where the document ends.
3. Bit-sampling LSH.  ``bits`` sampled places of the embedding are a signature;
   independent walks are tried.  Their number is set for each item length so that
   copies with the most edits allowed are found with probability ``recall``,
   measured on edited copies of the items.  Lengths that need more than
   ``max_repeats`` walks go without: all their seeds are verified.
4. Seeds of which a window meets the item in any walk are verified with the exact
   edit distance: the item against every run of words, or every window of n words,
   that the seed allows.  The best place is reported; n_words is that of the item.

The documents pass once, without a shuffle.  The items are broadcast in blocks of
at most ``block_words`` words; further items make further passes.

Defined results: null or empty texts match nothing; items with fewer than
``min_words`` words, null ids or null texts are not searched; repeated documents
and items give repeated matches (equal items each their own); ties go to the
smallest start; null doc_id is kept; extra columns are ignored.
"""

from __future__ import annotations

import math
import string

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkloom.llm.common import give_back

_EDGES = string.punctuation + "“”„«»‘’¿¡…–—"
_PAD = 0  # symbol after the end of a window; 1: word that no item holds
#: bytes of tokens that a task remembers
MEMO_BYTES = 16 << 20
#: bound on the words of windows held at once
CELLS = 400_000
#: edited copies of each kind that the number of walks is measured on
COPIES = 40


def normal(token: str) -> str:
    return token.lower().strip(_EDGES)


def item_words(text: str | None) -> list[str]:
    return [w for w in map(normal, (text or "").split()) if w]


class _Ids(dict):
    """Token -> symbol: 2 and up for words of items, 1 for others, -1 for bare punctuation."""

    def __init__(self, vocabulary: dict):
        super().__init__()
        self.vocabulary, self.held = vocabulary, 0

    def __missing__(self, token):
        w = normal(token)
        self.held += 2 * len(token) + 150
        if self.held > MEMO_BYTES:
            self.clear()
            self.held = 0
        got = self[token] = self.vocabulary.get(w, 1) if w else -1
        return got


def edit_distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Edit distance of each row of a with the same row of b."""
    rows, m = b.shape
    steps = np.arange(m + 1)
    prev = np.broadcast_to(steps, (rows, m + 1)).copy()
    for i in range(a.shape[1]):
        cur = np.empty_like(prev)
        cur[:, 0] = i + 1
        np.minimum(prev[:, :-1] + (a[:, i:i + 1] != b), prev[:, 1:] + 1, out=cur[:, 1:])
        prev = np.minimum.accumulate(cur - steps, axis=1) + steps
    return prev[:, -1]


def substring_distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Least edit distance of each row of a from the words of the same row of b that begin at each place."""
    rows, m = b.shape
    b = b[:, ::-1]
    steps = np.arange(m + 1, dtype=np.int32)
    prev = np.zeros((rows, m + 1), np.int32)
    for i in range(a.shape[1] - 1, -1, -1):
        cur = np.empty_like(prev)
        cur[:, 0] = a.shape[1] - i
        np.minimum(prev[:, :-1] + (a[:, i:i + 1] != b), prev[:, 1:] + 1, out=cur[:, 1:])
        prev = np.minimum.accumulate(cur - steps, axis=1) + steps
    return prev[:, :0:-1]


class Walks:
    """CGK walks over windows of up to ``longest`` words of a vocabulary."""

    def __init__(self, n_symbols: int, longest: int, repeats: int, bits: int, seed: int = 3):
        self.seeds = np.random.default_rng(seed).integers(1, 2 ** 62, size=repeats, dtype=np.uint64)
        self.bits, self.n_symbols = bits, n_symbols

    def moves(self, r: int, j: int, symbols: np.ndarray) -> np.ndarray:
        """The random bit of (walk, step, word)."""
        step = np.uint64((int(self.seeds[r]) + j * 0xD6E8FEB86659FD93) % 2 ** 64)
        x = (symbols.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15) + step
        x ^= x >> np.uint64(32)
        x *= np.uint64(0xD6E8FEB86659FD93)
        return ((x >> np.uint64(40)) & np.uint64(1)).astype(np.int64)

    def signature(self, windows: np.ndarray, r: int) -> np.ndarray:
        """Symbols at the sampled places of walk r, for rows of equal length."""
        rows, n = windows.shape
        places = np.random.default_rng(int(self.seeds[r]) % 2 ** 32 + n).choice(max(1, 2 * n), size=self.bits, replace=False)
        padded = np.concatenate([windows, np.full((rows, 1), _PAD, windows.dtype)], axis=1)
        at, out, every = np.zeros(rows, np.int64), np.zeros((rows, self.bits), windows.dtype), np.arange(rows)
        for j in range(int(places.max()) + 1):
            s = padded[every, at]
            for b in np.flatnonzero(places == j):
                out[:, b] = s
            at = np.minimum(at + self.moves(r, j, s), n)
        return out


class Items:
    """Search tables of one block of items; bounded by the block, broadcast to the tasks."""

    def __init__(self, rows, similarity: float, recall: float, bits: int, max_repeats: int = 64):
        self.ids = [i for i, _ in rows]
        words = [w for _, w in rows]
        self.vocabulary = {w: k + 2 for k, w in enumerate(sorted({x for ws in words for x in ws}))}
        self.seqs = [np.array([self.vocabulary[x] for x in ws], dtype=np.int64) for ws in words]
        self.edits = [int(math.floor((1 - similarity) * len(s) + 1e-9)) for s in self.seqs]
        self.radix = len(self.vocabulary) + 2
        seeds: dict[int, list] = {}
        for k, (s, d) in enumerate(zip(self.seqs, self.edits)):
            n, parts = len(s), d + 1
            for p in range(parts):
                lo, hi = n * p // parts, n * (p + 1) // parts
                q = self.gram(hi - lo)
                seeds.setdefault(q, []).append((self.code(s[lo:lo + q]), k, lo))
        self.seeds = {}
        for q, rows_ in seeds.items():
            rows_.sort()
            self.seeds[q] = [np.array(c, dtype=np.int64) for c in zip(*rows_)]
        longest = max(map(len, self.seqs))
        self.walks = Walks(self.radix, longest, max_repeats, bits)
        self.repeats = self.needed(recall, max_repeats)
        self.signatures = [[None] * (self.repeats[len(s)] or 0) for s in self.seqs]
        for n in sorted({len(s) for s in self.seqs}):
            same = [k for k, s in enumerate(self.seqs) if len(s) == n]
            for r in range(self.repeats[n] or 0):
                for k, sig in zip(same, self.walks.signature(np.stack([self.seqs[k] for k in same]), r)):
                    self.signatures[k][r] = sig

    def gram(self, length: int) -> int:
        """Words of a seed that fit a 64-bit code."""
        return max(1, min(length, 4, int(62 / math.log2(self.radix))))

    def code(self, words) -> int:
        c = 0
        for w in words:
            c = c * self.radix + int(w)
        return c

    def needed(self, recall: float, most: int) -> dict[int, int | None]:
        """Walks by item length for the wanted recall on edited copies; None: more than ``most``.

        Copies have only other words, lost words or added words, up to the limit; the kind
        that is found least counts.  Longer items need more walks, so once a length needs
        more than ``most`` the lengths above it are not measured."""
        rng, out, over = np.random.default_rng(11), {}, False
        for n in sorted({len(s) for s in self.seqs}):
            if over:
                out[n] = None
                continue
            same = [k for k, s in enumerate(self.seqs) if len(s) == n]
            of, copies = [], []
            for kind in range(3):
                for c in range(COPIES):
                    k = same[c * len(same) // COPIES if len(same) > COPIES else c % len(same)]
                    w = self.seqs[k].tolist()
                    for _ in range(self.edits[k]):
                        p = int(rng.integers(len(w)))
                        w[p:p + (kind != 2)] = [] if kind == 1 else [1]
                    of.append(k)
                    copies.append((w + [1] * n)[:n])
            x, y = np.array(copies, dtype=np.int64), np.stack([self.seqs[k] for k in of])
            met = np.zeros(len(of))
            for r in range(most):
                met += (self.walks.signature(x, r) == self.walks.signature(y, r)).all(axis=1)
            # a copy that no walk finds counts as lost for any number of walks
            miss = (1 - met / most).reshape(3, COPIES)
            out[n] = next((r for r in range(1, most + 1) if (miss ** r).mean(axis=1).max() <= 1 - recall), None)
            over = out[n] is None
        return out


def _candidates(a: np.ndarray, ends: np.ndarray, items: Items):
    """(item, start, document) of item-sized windows at a seed, unique, in one array of all documents.

    ends[d]: end of document d.  A start may lie outside its document when the copy lacks words."""
    known = np.r_[0, np.cumsum(a >= 2)]
    found = []
    for q, (codes, ks, offs) in items.seeds.items():
        if len(a) < q:
            continue
        at = np.flatnonzero(known[q:] - known[:-q] == q)
        doc = np.searchsorted(ends, at, "right")
        inside = at + q <= ends[doc]
        at, doc = at[inside], doc[inside]
        if not len(at):
            continue
        c = a[at].copy()
        for j in range(1, q):
            c = c * items.radix + a[at + j]
        lo, hi = np.searchsorted(codes, c, "left"), np.searchsorted(codes, c, "right")
        hit = np.flatnonzero(hi > lo)
        n = (hi - lo)[hit]
        i = np.repeat(lo[hit], n) + (np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n))
        found.append(np.stack([ks[i], np.repeat(at[hit], n) - offs[i], np.repeat(doc[hit], n)], axis=1))
    if not found:
        return (np.zeros(0, np.int64),) * 3
    return tuple(np.unique(np.concatenate(found), axis=0).T)


def _words(a: np.ndarray, start: np.ndarray, size: int, first: np.ndarray, end: np.ndarray) -> np.ndarray:
    """``size`` words from each start; _PAD outside the document [first, end)."""
    at = start[:, None] + np.arange(size)
    inside = (at >= first[:, None]) & (at < end[:, None])
    return np.where(inside, a[np.clip(at, 0, len(a) - 1)], _PAD)


def _enough(a, item, start, first, end, items: Items) -> np.ndarray:
    """Whether the words within d of a window can hold n - d words of the item.  Loses no copy."""
    ok = np.zeros(len(item), bool)
    order = np.argsort(item, kind="stable")
    cuts = np.flatnonzero(np.diff(item[order])) + 1
    for rows in np.split(order, cuts):
        s, d = items.seqs[item[rows[0]]], items.edits[item[rows[0]]]
        mine = np.unique(s)
        size = len(s) + 2 * d
        for at in range(0, len(rows), max(1, CELLS // size)):
            r = rows[at:at + max(1, CELLS // size)]
            x = _words(a, start[r] - d, size, first[r], end[r])
            near = mine[np.minimum(np.searchsorted(mine, x), len(mine) - 1)] == x
            ok[r] = near.sum(axis=1) >= len(s) - d
    return ok


def _meeting(a, item, start, first, end, n: int, items: Items) -> np.ndarray:
    """Whether a window that starts within d words of the given one meets its item in a walk; items of n words."""
    d = items.edits[item[0]]
    passed = np.zeros(len(item), bool)
    block = max(1, CELLS // ((2 * d + 1) * n))
    for at in range(0, len(item), block):
        hits = np.arange(at, min(at + block, len(item)))
        rep = np.repeat(hits, 2 * d + 1)
        s = start[rep] + np.tile(np.arange(-d, d + 1), len(hits))
        ok = (s >= first[rep]) & (s < end[rep])
        rep, s = rep[ok], s[ok]
        pairs, keep, back = np.unique(np.stack([item[rep], s], axis=1), axis=0, return_index=True, return_inverse=True)
        windows = _words(a, s[keep], n, first[rep[keep]], end[rep[keep]])
        met = np.zeros(len(pairs), bool)
        for r in range(items.repeats[n]):
            todo = np.flatnonzero(~met)
            if not len(todo):
                break
            want = np.stack([items.signatures[k][r] for k in pairs[todo, 0]])
            met[todo] = (items.walks.signature(windows[todo], r) == want).all(axis=1)
        passed[rep[met[back.ravel()]]] = True
    return passed


def find_items(texts: list[str | None], items: Items, ids: _Ids, substrings: bool = False):
    """(text, item, start, edits) of the best place of each pair of text and item found."""
    arrays, sizes = [], []
    for t in texts:
        tokens = (t or "").split()
        x = np.fromiter(map(ids.__getitem__, tokens), dtype=np.int64, count=len(tokens))
        x = x[x > 0]
        arrays += [x]
        sizes.append(len(x))
    a = np.concatenate(arrays) if arrays else np.zeros(0, np.int64)
    ends = np.cumsum(sizes)
    firsts = ends - sizes
    item, start, doc = _candidates(a, ends, items)
    if not len(item):
        return []
    ok = _enough(a, item, start, firsts[doc], ends[doc], items)
    item, start, doc = item[ok], start[ok], doc[ok]
    lens = np.asarray([len(x) for x in items.seqs])
    best: dict = {}
    for n in np.unique(lens[item]).tolist():
        m = np.flatnonzero(lens[item] == n)
        if items.repeats[n] is not None:
            m = m[_meeting(a, item[m], start[m], firsts[doc[m]], ends[doc[m]], n, items)]
        if not len(m):
            continue
        d = items.edits[item[m[0]]]
        size = n + 2 * d
        for at in range(0, len(m), max(1, CELLS // size)):
            r = m[at:at + max(1, CELLS // size)]
            first, end = firsts[doc[r]], ends[doc[r]]
            if substrings:
                x = _words(a, start[r] - d, size, first, end)
                dist = substring_distances(np.stack([items.seqs[k] for k in item[r]]), x)
                s = start[r][:, None] - d + np.arange(size)
                good = (dist <= d) & (s >= first[:, None]) & (s < end[:, None])
            else:
                s = start[r][:, None] + np.arange(-d, d + 1)
                inside = (s >= first[:, None]) & (s + n <= end[:, None])
                dist = np.full(s.shape, d + 1)
                which, _ = np.nonzero(inside)
                for lo in range(0, len(which), max(1, CELLS // n)):
                    part = slice(lo, lo + max(1, CELLS // n))
                    w = a[s[inside][part][:, None] + np.arange(n)]
                    flat = edit_distances(w, np.stack([items.seqs[k] for k in item[r[which[part]]]]))
                    dist[tuple(i[part] for i in np.nonzero(inside))] = flat
                good = dist <= d
            for row in np.flatnonzero(good.any(axis=1)):
                e = np.where(good[row], dist[row], d + 1)
                j = int(e.argmin())
                key, got = (int(doc[r[row]]), int(item[r[row]])), (int(e[j]), int(s[row, j]))
                if key not in best or got < best[key]:
                    best[key] = got
    return [(d, k, s - int(firsts[d]), e) for (d, k), (e, s) in sorted(best.items())]


SCHEMA = "doc_id long, item_id long, start_word long, n_words long, edits long, similarity double"


def item_blocks(benchmark: DataFrame, similarity: float, recall: float, bits: int, min_words: int, block_words: int,
                item_col: str, item_text: str):
    """Broadcast search tables of the items, block by block.

    The words of all items are counted before any are fetched, so each block has a checked size."""
    items = benchmark.select(F.col(item_col).cast("long").alias("i"), F.col(item_text).alias("t")).where(
        "i is not null and t is not null")
    words = items.select(F.coalesce(F.sum(F.size(F.split("t", r"\s+"))), F.lit(0))).first()[0]
    blocks = max(1, math.ceil(words / block_words))
    for b in range(blocks):
        rows = [(r["i"], item_words(r["t"])) for r in items.where(F.pmod(F.xxhash64("i", "t"), F.lit(blocks)) == b)
                .orderBy("i", "t").collect()]
        rows = [r for r in rows if len(r[1]) >= min_words]
        if rows:
            yield benchmark.sparkSession.sparkContext.broadcast(Items(rows, similarity, recall, bits))


def contaminated(docs: DataFrame, benchmark: DataFrame, similarity: float = 0.8, recall: float = 0.99, bits: int = 2,
                 min_words: int = 5, block_words: int = 500_000, id_col: str = "doc_id", text_col: str = "text",
                 item_col: str = "item_id", item_text: str = "text", substrings: bool = False) -> DataFrame:
    """doc_id, item_id, start_word, n_words, edits, similarity of every pair of document and item found."""
    x = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("t"))
    out = None
    for shared in item_blocks(benchmark, similarity, recall, bits, min_words, block_words, item_col, item_text):
        def run(batches, shared=shared):
            items = shared.value
            ids = _Ids(items.vocabulary)
            for batch in batches:
                docs_, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
                for at in range(0, len(texts), 2000):
                    got = find_items(texts[at:at + 2000], items, ids, substrings)
                    cols = list(zip(*[(docs_[at + d], items.ids[k], s, len(items.seqs[k]), e, 1 - e / len(items.seqs[k]))
                                      for d, k, s, e in got])) or [[]] * 6
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(c, type=pa.float64() if n == 5 else pa.int64()) for n, c in enumerate(cols)],
                        names=["doc_id", "item_id", "start_word", "n_words", "edits", "similarity"])
            del items, ids
            give_back()

        part = x.mapInArrow(run, SCHEMA)
        out = part if out is None else out.unionByName(part)
    return out if out is not None else docs.sparkSession.createDataFrame([], SCHEMA)


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, similarity: float = 0.8, recall: float = 0.99, bits: int = 2,
                      min_words: int = 5, block_words: int = 500_000, text_col: str = "text",
                      item_col: str = "item_id", item_text: str = "text", substrings: bool = False) -> DataFrame:
    """The rows of ``docs``, all columns, in which no item is found."""
    place = docs.columns.index(text_col)
    for shared in item_blocks(benchmark, similarity, recall, bits, min_words, block_words, item_col, item_text):
        def run(batches, shared=shared):
            items = shared.value
            ids = _Ids(items.vocabulary)
            for batch in batches:
                n, texts = batch.num_rows, batch.column(place)
                bad = {at + d for at in range(0, n, 2000)
                       for d, _, _, _ in find_items(texts.slice(at, 2000).to_pylist(), items, ids, substrings)}
                yield batch.filter(pa.array([i not in bad for i in range(n)], type=pa.bool_()))
            del items, ids
            give_back()

        docs = docs.mapInArrow(run, docs.schema)
    return docs
