"""Toxicity scores of text restored through a noisy channel.

Channel.  A writer hides a word by look-alike symbols (``$tup1d``), by letters
repeated or masked (``stuupid``, ``st*pid``, ``*diot``) and by letters set apart
(``s t u p i d``, ``s.t.u.p.i.d``).  Every token that shows such signs becomes a
character lattice: each sign may stand for its look-alikes, a repeated letter or
a separator may be dropped or end a word, a run of single letters may hold word
breaks.  Tokens of any length are read whole.  A Viterbi search under a character trigram model picks the most likely word.

Character model: trigram counts over the whole texts of all documents (28
symbols: break, a-z, other letter), added up by Spark, 21,952 numbers.

Score: on the restored words.  Document counts by label of hashed features (the
word and its first 4 to 8 letters) give shrunk log odds; a word weighs as its best
feature.  A logistic regression on a text's largest positive weights gives the
score.  Counts and regression use at most ``max_train`` labelled rows, chosen by
hash of the id (a bound that makes their broadcast safe); counts leave out the row
they are used for.  Only text is ever looked at.

Defined results: null or empty text has no words and the score of a text without
evidence; without labelled rows of both kinds every score is the share of toxic
ones (0 without any); labels with null id or value are ignored, of several labels
of an id the largest counts; repeated rows are scored alike; null doc_id has
held_out false; extra columns are ignored.
"""

from __future__ import annotations

import contextlib
import gc
import itertools
import re
from operator import itemgetter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkloom.llm.common import give_back, stage

N = 28  # symbols: 0 break, 1-26 a-z, 27 other letter
BINS = 1 << 19
#: bytes of tokens and readings that a task remembers
MEMO_BYTES = 80 << 20
#: pieces of tokens that a reader remembers, and their most signs
PIECES, PIECE = 30_000, 16
#: rows of a batch that are held as Python objects at once
ROWS = 512
#: characters of texts, after which no other text is scored side by side
CHARS = 2 << 20

# fixed values: letters that a sign may stand for
LOOKALIKES = {"0": "o", "1": "il", "3": "e", "4": "a", "5": "s", "6": "gb", "7": "t", "8": "b", "9": "g", "@": "a",
              "$": "s", "!": "i", "|": "il", "+": "t", "(": "c", "<": "c", "*": "aeiou", "#": "aeiou", "%": "aeiou"}
SEPARATORS = set(".-_*~'`^|,:;/\\")
#: separators that stand inside words only
INNER = set("*'`")
_LONG_RUN = re.compile(r"([^\W\d_])\1{3,}")
_REPEATS = re.compile(r"(?i)([^\W\d_])\1")
_ALONE = re.compile(rb"\x01{3,}")
_RUN = re.compile(r"(?i)([^\W\d_])\1\1")
_TWICE = re.compile(r"(.)\1", re.S)
#: two or more lower-case letters, none the same as the sign before it; letters beyond these are read with the signs
_PLAIN = re.compile(r"(?:([a-zß-öø-ÿ])(?<!\1\1)){2,}")
_SIGNS = re.compile(r"[^\W\d_][^\w\s]+[^\W\d_]|[^\W\d_][\d_@$!|+(<#%*]|[\d@$!|+(<#%*][^\W\d_]")
#: tokens, one a line, that show signs or a letter twice in a row
_ODD = re.compile(rf"(?im)^.*?(?:([^\W\d_])\1|{_SIGNS.pattern}).*$")
#: all but few of the tokens that _ODD does not find, told apart by Arrow: others are ASCII signs and letters of Latin-1
_LATIN = "a-zA-ZÀ-ÖØ-öø-ÿ"
_MAYBE = "|".join([rf"[^!-~¡¿«»{_LATIN}]", *(f"{c}{c}" for c in "abcdefghijklmnopqrstuvwxyzàáâãäåæçèéêëìíîïðñòóôõöøùúûüýþßÿ"),
                   rf"[{_LATIN}][^{_LATIN}0-9_]+[{_LATIN}]|[{_LATIN}][\d_@$!|+(<#%*]|[\d@$!|+(<#%*][{_LATIN}]"])
#: three single signs in a row, between what ``str.split`` takes for white space
_WHITE = r"\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
_THREE = rf"(?:\A|[{_WHITE}])[^{_WHITE}](?:[{_WHITE}]+[^{_WHITE}]){{2}}(?:[{_WHITE}]|\z)"
_EDGES = "\"'.,;:!?()[]{}<>“”„«»¿¡…"

_SYMBOL = np.zeros(256, dtype=np.int64)
for _i in range(26):
    _SYMBOL[97 + _i] = _SYMBOL[65 + _i] = _i + 1
_SYMBOL[128:] = 27


_SYMBOL_OF = {chr(c): int(_SYMBOL[c]) for c in range(128)}


def trigrams_of(texts: list) -> np.ndarray:
    """Counts of symbol trigrams of texts, each with a break before and after it."""
    framed = [("\n" + (t or "") + "\n").encode() for t in texts]
    s = _SYMBOL[np.frombuffer(b"".join(framed), dtype=np.uint8)].astype(np.uint16)
    if len(s) < 3:
        return np.zeros(N ** 3, dtype=np.int64)
    g = s[:-2] * np.uint16(N * N) + s[1:-1] * np.uint16(N) + s[2:]
    # none runs from one text into the next
    ends = np.cumsum([len(t) for t in framed])[:-1]
    g[ends - 1] = g[ends - 2] = N ** 3
    return np.bincount(g, minlength=N ** 3 + 1)[:N ** 3]


def char_trigrams(docs: DataFrame, text_col: str = "text") -> np.ndarray:
    """Counts of symbol trigrams over all texts, added up on the executors."""
    def run(batches):
        total = np.zeros(N ** 3, dtype=np.int64)
        for b in batches:
            for at in range(0, b.num_rows, ROWS):
                total += trigrams_of(b.column(0).slice(at, ROWS).to_pylist())
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["g", "n"])

    rows = docs.select(text_col).mapInArrow(run, "g long, n long").groupBy("g").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(N ** 3, dtype=np.float64)
    out[rows.column("g").to_numpy()] = rows.column("n").to_numpy()
    return out


def log_model(counts: np.ndarray) -> np.ndarray:
    """log p(c | a b), trigrams backed by bigrams and single symbols."""
    c3 = counts.reshape(N, N, N)
    c2, c1 = c3.sum(0), c3.sum((0, 1))
    p1 = (c1 + 1) / (c1.sum() + N)
    p2 = (c2 + 20 * p1) / (c2.sum(1, keepdims=True) + 20)
    p3 = (c3 + 20 * p2) / (c3.sum(2, keepdims=True) + 20)
    return np.log(p3)


def arcs_of(token: str, at: int, spaced: bool) -> list[tuple[str, float]]:
    """Arcs of the lattice over the sign at a place of a lower-case token: (letters, channel cost)."""
    ch, last, prev = token[at], len(token) - 1, token[at - 1] if at else ""
    arcs = []
    if ch.isalpha():
        arcs.append((ch, 0.0))
        if ch == prev:
            # doubled letters are ordinary, longer runs are not
            arcs.append(("", -1.0 if ch * 3 in token[max(0, at - 2):at + 3] else -4.0))
        if spaced and prev:
            arcs.append((" " + ch, -3.0))
    else:
        arcs += [(x, -1.0 if ch not in "*#%" else -2.0) for x in LOOKALIKES.get(ch, "")]
        if spaced and prev:
            arcs += [(" " + x, -4.0) for x in LOOKALIKES.get(ch, "")]
        # a mask at the edge stands for a letter; Reader also reads the token without it
        if ch in SEPARATORS and not (ch == "*" and at in (0, last)) or not arcs:
            arcs.append(("", -1.5))
            if not spaced and 0 < at < last and ch not in INNER:
                # between single signs a separator rather sets letters apart
                alone = any(not _pair(token[i:i + 2]) for i in (max(0, at - 2), at + 1)) \
                    or at < 2 or at > last - 2
                arcs.append((" ", -4.5 if alone else -0.5))
    return arcs


def restore(token: str, logp: list[float], spaced: bool = False, known: dict | None = None) -> str:
    """Most likely reading of a token's lattice (lower case; may hold word breaks).

    logp: flat list of log p(c | a b) at (a * 28 + b) * 28 + c.  Runs of a letter
    are cut to three first; time and memory are linear in the length.

    Neither the model nor the arcs of a sign look further than two signs, so what
    stands between runs of two or more plain letters is read by itself, with two letters
    of either run.  known: readings of such pieces, kept from token to token."""
    token = _LONG_RUN.sub(r"\1\1\1", token.lower())
    if spaced:
        return _reading(token, logp, True, False, False)
    if known is None:
        known = {}
    elif len(known) > PIECES:
        known.clear()
    out, at = [], 0
    for m in _PLAIN.finditer(token):
        start = m.start()
        if start > at:
            out.append(_piece(token[max(0, at - 2):start + 2], logp, at > 0, True, known))
        at = m.end()
        out.append(token[start:at])
    if at < len(token):
        out.append(_piece(token[max(0, at - 2):], logp, at > 0, False, known))
    return "".join(out)


def _piece(piece: str, logp: list[float], after: bool, before: bool, known: dict) -> str:
    key = (piece, after, before)
    got = known.get(key)
    if got is None:
        got = _reading(piece, logp, False, after, before)
        if len(piece) <= PIECE:
            known[key] = got
    return got


def _reading(token: str, logp: list[float], spaced: bool, after: bool, before: bool) -> str:
    """The best path through a token or a piece of one.

    after, before: its first, last two signs are plain letters of the runs beside it, and no part of the reading."""
    of = _SYMBOL_OF.get
    start, state, s, text = 0, 0, 0.0, None
    if after:
        start, state = 2, of(token[0], 27) * N + of(token[1], 27)
    elif not spaced:
        # the plain letters in front are one path
        for ch in token:
            if not ch.isalpha() or ch == token[start - 1:start]:
                break
            at_z = state * N + of(ch, 27)
            s += logp[at_z]
            state, text = at_z % (N * N), (text, ch)
            start += 1
    best = {state: (s, text)}  # 28 * symbol before last + last -> (score, letters as (letters before, letters))
    for at in range(start, len(token)):
        ch = token[at]
        nxt: dict = {}
        if not spaced and ch.isalpha() and ch != token[at - 1:at]:
            # the one arc of a plain letter
            z = of(ch, 27)
            if len(best) == 1:
                (state, (s, text)), = best.items()
                at_z = state * N + z
                best = {at_z % (N * N): (s + logp[at_z], (text, ch))}
                continue
            for state, (s, text) in best.items():
                at_z = state * N + z
                s += logp[at_z]
                state = at_z % (N * N)
                if state not in nxt or nxt[state][0] < s:
                    nxt[state] = (s, (text, ch))
            best = nxt
            continue
        arcs = arcs_of(token, at, spaced)
        for letters, cost in arcs:
            if len(letters) == 1:
                z = of(letters, 27)
                for state, (s, text) in best.items():
                    at_z = state * N + z
                    s += cost + logp[at_z]
                    state = at_z % (N * N)
                    if state not in nxt or nxt[state][0] < s:
                        nxt[state] = (s, (text, letters))
                continue
            if not letters:  # a dropped sign saves the model nothing
                for state, (s, text) in best.items():
                    s += cost - 2.0
                    if state not in nxt or nxt[state][0] < s:
                        nxt[state] = (s, text)
                continue
            marks = [of(c, 27) for c in letters]
            for state, (s, text) in best.items():
                s += cost
                for z in marks:
                    at_z = state * N + z
                    s += logp[at_z]
                    state = at_z % (N * N)
                if state not in nxt or nxt[state][0] < s:
                    nxt[state] = (s, (text, letters))
        best = nxt
    ends = [(s if before else s + logp[state * N], t) for state, (s, t) in best.items()]
    top = max(s for s, _ in ends)
    letters = max(_letters(t) for s, t in ends if s == top)
    return letters[:-2] if before else letters


def undouble(word: str, logp: list[float]) -> str:
    """``restore`` of a word of letters without a letter three times in a row.

    Its lattice has two arcs for each doubled letter and no others, and as the model
    looks back two symbols, and a letter that stays is the same letter, each pair is
    decided by the symbol before it and the one after it alone."""
    word = word.lower()
    of, out, done = _SYMBOL_OF.get, [], 0
    for m in _TWICE.finditer(word):
        # a pair's letters may differ where their symbols do not (letters beyond a-z)
        at, end = m.span()
        x = of(word[at - 1], 27) if at else 0
        c = of(word[at], 27)
        z = of(word[end], 27) if end < len(word) else 0
        both = logp[(x * N + c) * N + c] + logp[(c * N + c) * N + z]
        if logp[(x * N + c) * N + z] - 6.0 > both:
            out.append(word[done:at + 1])
            done = end
    if not done:
        return word
    out.append(word[done:])
    return "".join(out)


def _pair(two: str) -> bool:
    """Whether two signs can be letters of one word."""
    return len(two) == 2 and all(c.isalpha() or c in LOOKALIKES for c in two)


def _letters(link) -> str:
    out = []
    while link is not None:
        link, letters = link
        out.append(letters)
    return "".join(reversed(out))


class Reader:
    """Restored words of texts."""

    def __init__(self, logp: np.ndarray):
        self.logp = np.asarray(logp).ravel().tolist()
        self.pieces: dict = {}

    def best(self, token: str) -> list[str]:
        """Words of the best reading of one spelling."""
        if token.isalpha() and not _RUN.search(token):
            return [undouble(token, self.logp)]
        return restore(token, self.logp, known=self.pieces).split()

    def read(self, token: str) -> tuple[str, ...]:
        bare = token.strip(_EDGES)
        if not bare:
            return ()
        signs = (not bare.isalpha() or bare != token) and _SIGNS.search(token)
        if not signs and bare.isalpha():
            if not _RUN.search(bare):
                return (undouble(bare, self.logp),)
        if signs or _REPEATS.search(bare):
            # edges may be signs as well ("$tupid", "idio!", "*diot"): read both ways, letters decide
            return tuple(dict.fromkeys(w for t in dict.fromkeys((bare.strip("*"), bare, token)) if t for w in self.best(t)))
        return (bare.lower(),)

    def spaced(self, tokens) -> set[str]:
        """Words of runs of three or more single signs, whatever white space stands between them."""
        out: set[str] = set()
        alone = bytes(map((1).__eq__, map(len, tokens)))
        if alone.count(1) >= 3:
            for run in _ALONE.finditer(alone):
                out.update(restore("".join(tokens[run.start():run.end()]), self.logp, spaced=True).split())
        return out


def _strings(tokens: pa.Array) -> list[str]:
    """Python strings of tokens; one string that is split is much faster than one for each."""
    if len(tokens) < 2:
        return tokens.to_pylist()
    line = pc.binary_join(pa.ListArray.from_arrays([0, len(tokens)], tokens), pa.scalar("\n", tokens.type))
    return line[0].as_py().split("\n")


def singles(texts: pa.Array) -> list[bool]:
    """Whether a text holds three single signs in a row, for ``Reader.spaced``."""
    return pc.match_substring_regex(texts, _THREE).to_pylist()


@contextlib.contextmanager
def _no_cycles():
    """Reading makes many small tuples and no circles of them: nothing for the cycle collector to find."""
    on = gc.isenabled()
    gc.disable()
    try:
        yield
    finally:
        if on:
            gc.enable()


class Memo:
    """Token -> entries of its restored words; forgets all when MEMO_BYTES are held.

    entries(words): an entry for each word, None for one that is of no use."""

    def __init__(self, reader: Reader, entries):
        self.reader, self.entries, self.held = reader, entries, 0
        self.known: dict = {}  # a plain dict: set operations look its keys up

    def learn(self, tokens: set) -> None:
        if self.held > MEMO_BYTES:
            self.known.clear()
            self.held = 0
        new = tokens.difference(self.known)
        # most tokens show nothing to restore: these are words as they are (Reader.read)
        new = list(new)
        maybe = pc.match_substring_regex(pa.array(new, pa.large_string()), _MAYBE, ignore_case=True).to_numpy(zero_copy_only=False)
        odd = {m.group() for m in _ODD.finditer("\n".join(itertools.compress(new, maybe)))}
        plain = [t for t in new if t not in odd]
        new = list(odd)
        read = list(map(self.reader.read, new))
        bare = "\n".join([t.strip(_EDGES) for t in plain]).lower().split("\n") if plain else []
        every = self.entries([*filter(None, bare), *itertools.chain.from_iterable(read)])
        entries = iter(every)
        # most words have no entry
        self.known.update([(t, () if not w or (e := next(entries)) is None else (e,)) for t, w in zip(plain, bare)])
        for t, words in zip(new, read):
            self.known[t] = tuple([e for e in itertools.islice(entries, len(words)) if e is not None])
        self.held += 2 * (sum(map(len, plain)) + sum(map(len, new))) + 150 * (len(plain) + len(new)) + 250 * sum(e is not None for e in every)

    def words(self, texts: list):
        """The entries of the restored words of each text, one text after the other."""
        for at in range(0, len(texts), 64):
            part = [t or "" for t in texts[at:at + 64]]
            split = list(map(str.split, part))
            self.learn(set().union(*split))
            for tokens, alone in zip(split, singles(pa.array(part, pa.large_string()))):
                found = set(itertools.chain.from_iterable(filter(None, map(self.known.__getitem__, tokens))))
                if alone:
                    found.update(self.spaced(tokens))
                yield found

    def spaced(self, tokens: list):
        """The entries of words of single signs set apart."""
        words = self.reader.spaced(tokens)
        return [e for e in self.entries(list(words)) if e is not None] if words else []


PREFIXES = (4, 5, 6, 7, 8)
TOP = 8
_MIX = np.uint64(0x9E3779B97F4A7C15)
#: letters of a word that are hashed side by side; longer words are hashed one by one
_SIDE = 24


def _bin(h: np.ndarray) -> np.ndarray:
    return ((h ^ (h >> np.uint64(29))) * _MIX >> np.uint64(40)).astype(np.int64) % BINS


def bins_of_all(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashed features of words, flat, and their number for each word: its first letters
    (where it has more) and itself."""
    n = len(words)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    size = np.fromiter(map(len, words), dtype=np.int64, count=n)
    # longest first: the words that have a letter at a place are the first ones
    order = np.argsort(-size, kind="stable")
    width = int(min(_SIDE, max(size[order[0]], 1)))
    letters = np.array(words, dtype=f"U{width}").view(np.uint32).reshape(n, -1)[order]
    letters = np.ascontiguousarray(letters.T)
    having = np.searchsorted(-size[order], -np.arange(width + 1), side="left")  # words of more letters than that
    out = np.full((n, len(PREFIXES) + 1), -1, dtype=np.int64)
    h = np.zeros(n, np.uint64)
    for k in range(width):
        m, longer = having[k], having[k + 1]
        g = (h[:m] ^ letters[k, :m]) * _MIX
        h[:m] = g ^ (g >> np.uint64(31))
        if k + 1 in PREFIXES:
            out[order[:longer], k + 1 - PREFIXES[0]] = _bin(h[:longer] + np.uint64(k + 1))
    whole = np.zeros(n, np.uint64)
    whole[order] = h
    for i in order[:having[width]] if width == _SIDE else ():
        whole[i] = xxhash.xxh64_intdigest(words[i])
    out[:, -1] = _bin(whole)
    used = out >= 0
    return out[used], used.sum(axis=1)


def bins_of(word: str) -> list[int]:
    return bins_of_all([word])[0].tolist()


def evidence(weights) -> list[float]:
    """Regression inputs: the three largest positive word weights and the mean of the next five."""
    top = (sorted((w for w in weights if w > 0), reverse=True)[:TOP] + [0.0] * TOP)[:TOP]
    return [*top[:3], sum(top[3:]) / (TOP - 3)]


def strongest(pairs) -> list[float]:
    """``evidence`` of (word, weight) pairs by falling weight; a word, with its weight, may come several times."""
    top: dict = {}
    for pair in pairs:
        top[pair] = pair[1]
        if len(top) == TOP:
            break
    return evidence(top.values())


class Scorer:
    """Weights of words by document counts (toxic, clean) of their features."""

    def __init__(self, logp, toxic: np.ndarray, clean: np.ndarray, n_toxic: int, n_clean: int, shrink: float = 6.0):
        self.reader, self.toxic, self.clean = Reader(logp), toxic, clean
        p = n_toxic / max(1, n_toxic + n_clean)
        self.a, self.b = shrink * p, shrink * (1 - p)
        self.table = np.log((toxic + self.a) / self.a) - np.log((clean + self.b) / self.b)
        self.memo = Memo(self.reader, self.weigh)

    def weigh(self, words: list[str]) -> list:
        """(word, weight) of the words with evidence, None for others."""
        bins, sizes = bins_of_all(words)
        if not len(bins):
            return []
        top = np.maximum.reduceat(self.table[bins], np.cumsum(sizes) - sizes).tolist()
        return [(w, x) if x > 0 else None for w, x in zip(words, top)]

    def score_inputs(self, texts: list) -> list[list[float]]:
        out: list = []
        part, held = [], 0
        for t in texts:
            part.append(t or "")
            held += len(part[-1])
            if held > CHARS:
                out += self._inputs(part)
                part, held = [], 0
        return out + self._inputs(part) if part else out

    def _inputs(self, texts: list) -> list[list[float]]:
        column = pa.array(texts, pa.large_string())
        split = pc.utf8_split_whitespace(column)  # as str.split, but for empty tokens at a text's ends
        tokens = split.flatten().dictionary_encode()
        kinds = _strings(tokens.dictionary)
        self.memo.learn(set(kinds))
        known = list(map(self.memo.known.__getitem__, kinds))
        pairs = list(itertools.chain.from_iterable(known))
        n = len(pairs)
        size = np.fromiter(map(len, known), np.int64, len(known))
        by_weight = np.argsort(-np.fromiter(map(itemgetter(1), pairs), np.float64, n), kind="stable")
        rank = np.empty(n, np.int64)
        rank[by_weight] = np.arange(n)
        # each text's pairs by falling weight: the pairs of a token stand side by side
        token = tokens.indices.to_numpy()
        of = size[token]
        first = (np.cumsum(size) - size)[token] - (np.cumsum(of) - of)
        text = np.repeat(np.repeat(np.arange(len(texts)), pc.list_value_length(split).to_numpy()), of)
        key = np.sort(text * n + rank[np.repeat(first, of) + np.arange(len(text))])
        key = key[np.diff(key, prepend=-1) > 0]
        bounds = np.searchsorted(key, np.arange(len(texts) + 1) * n)
        out = []
        for i, alone in enumerate(singles(column)):
            found = (pairs[j] for j in by_weight[key[bounds[i]:bounds[i + 1]] - i * n])
            if alone:
                found = sorted([*found, *self.memo.spaced(texts[i].split())], key=itemgetter(1), reverse=True)
            out.append(strongest(found))
        return out

    def batch_inputs(self, column) -> np.ndarray:
        with _no_cycles():
            return np.array([x for at in range(0, len(column), ROWS) for x in self.score_inputs(column.slice(at, ROWS).to_pylist())]
                            ).reshape(-1, 4)

    def left_out_inputs(self, bins: np.ndarray, sizes: np.ndarray, own: int) -> list[float]:
        """Inputs of a text, given as bins of its words, whose label the counts hold: its own share is taken off."""
        if not len(bins):
            return evidence([])
        w = np.log((self.toxic[bins] - own + self.a) / self.a) - np.log((self.clean[bins] - (1 - own) + self.b) / self.b)
        return evidence(np.maximum.reduceat(w, np.cumsum(sizes) - sizes).tolist())


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.1) -> np.ndarray:
    """Weights with the intercept first; Newton steps, ridge on all but the intercept."""
    z = np.c_[np.ones(len(x)), x]
    w = np.zeros(z.shape[1])
    r = np.full(z.shape[1], ridge)
    r[0] = 1e-6
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + np.diag(r), z.T @ (p - y) + r * w)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w


def held_out(id_col="doc_id"):
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 5 == 0, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, max_train: int = 40_000, id_col: str = "doc_id", text_col: str = "text",
          label_col: str = "toxic"):
    """(log model, toxic counts, clean counts, n toxic, n clean, regression weights)."""
    logp = log_model(char_trigrams(docs, text_col))
    rows = (labels.select(F.col(id_col).cast("long").alias("i"), F.col(label_col).cast("int").alias("y"))
            .where("i is not null and y in (0, 1)").where(~held_out("i")).groupBy("i").agg(F.max("y").alias("y"))
            .orderBy(F.xxhash64("i"), "i").limit(max_train))
    # at most max_train pairs of numbers
    known = docs.select(F.col(id_col).cast("long").alias("i"), F.col(text_col).alias("t")).join(F.broadcast(rows), "i")
    spark = docs.sparkSession
    lm = spark.sparkContext.broadcast(logp)

    def read(batches):
        """Label, bins of all words and the number of bins of each word."""
        def entries(words):
            bins, sizes = bins_of_all(words)
            flat, ends = bins.astype(np.int32).tobytes(), np.cumsum(sizes).tolist()
            return [(w, flat[4 * (e - n):4 * e]) for w, e, n in zip(words, ends, sizes.tolist())]

        memo = Memo(Reader(lm.value), entries)
        for b in batches:
            for at in range(0, b.num_rows, ROWS):
                part = b.slice(at, ROWS)
                with _no_cycles():
                    bins = [sorted(x[1] for x in found) for found in memo.words(part.column(0).to_pylist())]
                yield pa.RecordBatch.from_arrays(
                    [part.column(1), pa.array([np.frombuffer(b"".join(x), np.int32) for x in bins], pa.list_(pa.int32())),
                     pa.array([[len(y) // 4 for y in x] for x in bins], pa.list_(pa.int32()))], names=["y", "bins", "sizes"])

    # read once: at most max_train rows, a few numbers a distinct word
    known = stage(known.select("t", "y").mapInArrow(read, "y int, bins array<int>, sizes array<int>"), "toxicity-known")

    def count(batches):
        total = np.zeros((2, BINS), dtype=np.int32)
        n = [0, 0]
        for b in batches:
            for y, bins in zip(b.column(0).to_pylist(), b.column(1)):
                n[y] += 1
                total[y, bins.values.to_numpy()] += 1
        if n[0] + n[1]:
            for at in range(0, BINS, 8192):
                yield pa.RecordBatch.from_arrays(
                    [pa.array([at]), pa.array([n[1]]), pa.array([n[0]]), pa.array([total[1, at:at + 8192].tobytes()]),
                     pa.array([total[0, at:at + 8192].tobytes()])], names=["at", "nt", "nc", "t", "c"])

    def add(p):
        import pandas as pd
        s = [np.sum([np.frombuffer(x, np.int32) for x in p[c]], axis=0, dtype=np.int32).tobytes() for c in ("t", "c")]
        return pd.DataFrame({"at": [p["at"].iloc[0]], "nt": [p["nt"].sum()], "nc": [p["nc"].sum()], "t": [s[0]], "c": [s[1]]})

    schema = "at long, nt long, nc long, t binary, c binary"
    parts = known.mapInArrow(count, schema).groupBy("at").applyInPandas(add, schema).toArrow().to_pylist()
    toxic, clean = np.zeros(BINS, np.int32), np.zeros(BINS, np.int32)
    nt = nc = 0
    for p in parts:
        toxic[p["at"]:p["at"] + 8192], clean[p["at"]:p["at"] + 8192] = np.frombuffer(p["t"], np.int32), np.frombuffer(p["c"], np.int32)
        nt, nc = p["nt"], p["nc"]
    if not nt or not nc:
        share = 1.0 if nt else 0.0
        return logp, toxic, clean, nt, nc, np.array([30.0 * (2 * share - 1), 0, 0, 0, 0])
    stats = spark.sparkContext.broadcast((logp, toxic, clean, nt, nc))

    def left_out(batches):
        s = Scorer(*stats.value)
        for b in batches:
            ys = b.column(0).to_pylist()
            x = [s.left_out_inputs(i.values.to_numpy(), n.values.to_numpy(), y) for y, i, n in zip(ys, b.column(1), b.column(2))]
            cols = list(zip(*x)) or [[]] * 4
            yield pa.RecordBatch.from_arrays([*[pa.array(c, type=pa.float64()) for c in cols], pa.array(ys, type=pa.int32())],
                                             names=["a", "b", "c", "d", "y"])

    got = known.mapInArrow(left_out, "a double, b double, c double, d double, y int").toArrow()
    x = np.stack([got.column(c).to_numpy() for c in "abcd"], axis=1)
    # rows come in any order; a fixed one makes the sums, and so the scores, repeatable
    y = got.column("y").to_numpy()
    order = np.lexsort((y, *x.T))
    return logp, toxic, clean, nt, nc, fit_logistic(x[order], y[order].astype(float))


def score_toxicity(docs: DataFrame, model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, score, predicted of every row."""
    m = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        *stats, w = m.value
        s = Scorer(*stats)
        for b in batches:
            x = s.batch_inputs(b.column(1))
            p = 1 / (1 + np.exp(-np.clip(w[0] + x @ w[1:], -30, 30)))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(p), pa.array((p >= 0.5).astype(np.int32))],
                                             names=["doc_id", "held_out", "score", "predicted"])
        del s
        give_back()

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("t"),
                       held_out(id_col).alias("h")).mapInArrow(
        run, "doc_id long, held_out boolean, score double, predicted int")


def drop_toxic(docs: DataFrame, model, text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns, that are not predicted toxic."""
    m = docs.sparkSession.sparkContext.broadcast(model)
    place = docs.columns.index(text_col)

    def run(batches):
        *stats, w = m.value
        s = Scorer(*stats)
        for b in batches:
            x = s.batch_inputs(b.column(place))
            yield b.filter(pa.array(w[0] + x @ w[1:] < 0))
        del s
        give_back()

    return docs.mapInArrow(run, docs.schema)
