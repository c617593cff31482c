"""Toxicity: work shared between tokens and texts gives what each gives by itself."""

import random

import numpy as np
import pyarrow as pa
from test_obfuscation import reader

from linkloom.llm import toxicity as T

ALPHABET = "abcdeéßiostupd" * 3 + "ñяʰ²١İſ1$*.-@!30'_(«»¿…,"


def words(rng, n):
    out = []
    for _ in range(n):
        w = "".join(rng.choice(ALPHABET) * rng.choice([1, 1, 1, 2, 4]) for _ in range(rng.randint(1, 12)))
        out.append(w + rng.choice(["", "", "!!", "$$$", "###", "***"]))
    return out


def test_pieces_of_a_token_read_as_the_whole_lattice(monkeypatch):
    r, rng = reader(), random.Random(7)
    for token in words(rng, 2000):
        cut = T._LONG_RUN.sub(r"\1\1\1", token.lower())
        whole = T._reading(cut, r.logp, False, False, False)
        assert T.restore(token, r.logp, known=r.pieces) == T.restore(token, r.logp) == whole, token
    calls = []
    monkeypatch.setattr(T, "_reading", lambda *a, f=T._reading: calls.append(a) or f(*a))
    fresh = T.Reader(np.array(r.logp))
    for i in range(3000):
        fresh.read("river" + "".join(rng.choices("abcd", k=12)) + "tones###")
    # doubled letters between the same few letters, one piece for all endings
    assert len(calls) < 1500


def test_forgotten_pieces_are_read_again(monkeypatch):
    monkeypatch.setattr(T, "PIECES", 3)
    r, rng = reader(), random.Random(8)
    for token in words(rng, 300):
        assert T.restore(token, r.logp, known=r.pieces) == T.restore(token, r.logp)
        assert len(r.pieces) < 30


def test_scores_of_texts_side_by_side(monkeypatch):
    r, rng = reader(), random.Random(9)
    counts = np.random.default_rng(1).poisson(2, (2, T.BINS)).astype(np.int32)
    spaces = [" ", " ", "\n", "\x0b", "\x1c", "\x1f", "\x85", "\xa0", " ", " ", " ", " ", "　", "  "]
    kinds = words(rng, 60) + ["river", "River", "river,", "a", "s", "é"]
    texts = [None, "", " \t ", "s t u p i d", " x\xa0y　z"]
    texts += ["".join(rng.choice(kinds) + rng.choice(spaces) for _ in range(rng.randint(0, 60))) for _ in range(200)]
    s = T.Scorer(np.array(r.logp), *counts, 50, 50)

    def one(text):
        tokens = (text or "").split()
        found = {w for t in tokens for w in s.reader.read(t)} | s.reader.spaced(tokens)
        return T.evidence([e[1] for e in s.weigh(sorted(found)) if e])

    asked = []
    learn = T.Memo.learn
    monkeypatch.setattr(T.Memo, "learn", lambda self, tokens: asked.append(len(tokens)) or learn(self, tokens))
    want = [one(t) for t in texts]
    assert s.batch_inputs(pa.array(texts)).tolist() == want and len(asked) == 1
    monkeypatch.setattr(T, "CHARS", 100)  # texts past the bound are scored in turn
    assert s.batch_inputs(pa.array(texts)).tolist() == want and len(asked) > 50
    # the regression's rows are read by words()
    memo = T.Memo(s.reader, s.weigh)
    assert [T.evidence([x for _, x in found]) for found in memo.words(texts)] == want


def test_white_space_is_that_of_split():
    signs = [chr(i) for i in range(0x3100)]
    assert T.singles(pa.array([f"ab a{c}b{c}c ab" for c in signs])) == [len(f"a{c}b{c}c".split()) == 3 for c in signs]
    assert T.singles(pa.array(["a b c", "ab c d", "a b cd", "  a  b\n c ", ""])) == [True, False, False, True, False]


def test_trigrams_of_texts_do_not_run_on():
    rng = random.Random(5)
    texts = [None, "", "a", "b", *("".join(rng.choices("abé z\n", k=rng.randint(0, 9))) for _ in range(300)), None]
    want = np.zeros(T.N ** 3, np.int64)
    for t in texts:
        s = T._SYMBOL[np.frombuffer(f"\n{t or ''}\n".encode(), np.uint8)]
        np.add.at(want, s[:-2] * T.N * T.N + s[1:-1] * T.N + s[2:], 1)
    assert T.trigrams_of(texts).tolist() == want.tolist() and not T.trigrams_of([]).any()
