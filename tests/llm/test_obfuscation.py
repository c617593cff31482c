"""Words hidden in long or joined tokens, and kinds of obfuscation at their edges."""

import random

import numpy as np

from linkloom.llm import toxicity as T

TEXT = ("you are a stupid idiot and a worthless scum they said that it is not the right way to speak to people "
        "all of us should write little letters and be kind to each other in the end it will do good to you too ")


def reader():
    s = T._SYMBOL[np.frombuffer(("\n" + TEXT * 40 + "\n").encode(), dtype=np.uint8)]
    return T.Reader(T.log_model(np.bincount(s[:-2] * T.N * T.N + s[1:-1] * T.N + s[2:], minlength=T.N ** 3).astype(float)))


def test_long_and_joined_tokens():
    r = reader()
    assert r.read("st" + "u" * 60 + "pid") == ("stupid",)
    for sep in "._-":
        token = sep.join(["the", "right", "way", "to", "speak", "to", "people", "you", "are", "stup1d", "they", "said"])
        assert len(token) > 40 and {"people", "stupid", "said"} <= set(r.read(token))
    assert set(r.read("you.1d10t")) >= {"you", "idiot"}
    assert r.read("s.t.u.p.i.d") == ("stupid",) and r.read("s.c.u.m") == ("scum",)
    assert T.bins_of("x" * 40 + "stupid")[-1] != T.bins_of("x" * 40 + "kind")[-1]
    long = ".".join(["people"] * 20_000 + ["1d10t"])
    assert "idiot" in r.read(long)


def test_spaced_doubled_and_masked_words():
    r = reader()
    assert r.spaced("you s\t t  u\np i d".split()) == {"stupid"} and r.spaced("an  a l l  in".split()) == {"all"}
    phrase = "thatitisnottherightwaytospeaktopeople"
    # more than 200 signs give no pieces of words
    assert all(r.spaced(phrase * n) == r.spaced(phrase * 3) for n in range(4, 30))
    assert r.read("stuupid") == ("stupid",) and r.read("StUupid") == ("stupid",)
    assert r.read("all") == ("all",) and r.read("letters") == ("letters",) and r.read("little") == ("little",)
    assert "idiot" in r.read("*diot") and "worthless" in r.read("*worthless*")
    assert any(w.startswith("idio") and len(w) == 5 for w in r.read("idio*"))


def readings(token, logp, spaced):
    """Best reading of a lattice by trying every path."""
    token = T._LONG_RUN.sub(r"\1\1\1", token.lower())
    paths = [("", 0.0)]
    for at in range(len(token)):
        paths = [(text + letters, cost + c - (2.0 if not letters else 0.0)) for text, cost in paths
                 for letters, c in T.arcs_of(token, at, spaced)]
    best = (-np.inf, "")
    for text, cost in paths:
        z = [0, 0, *[T._SYMBOL_OF.get(c, 27) for c in text], 0]
        cost += sum(logp[(a * T.N + b) * T.N + c] for a, b, c in zip(z, z[1:], z[2:]))
        best = max(best, (round(cost, 9), text))
    return best


def test_viterbi_equals_every_path():
    r, rng = reader(), random.Random(0)
    signs = "aeiostupdé1$*.-@!30" + "abcdefghijklmnopqrstuvwxyz"
    for i in range(300):
        token = "".join(rng.choice(signs) for _ in range(rng.randint(1, 7)))
        token += rng.choice(["", token[-1], token[-1] * 2])
        spaced = i % 3 == 0
        want = readings(token, r.logp, spaced)
        got = T.restore(token, r.logp, spaced)
        z = [0, 0, *[T._SYMBOL_OF.get(c, 27) for c in got], 0]
        assert got == want[1] or abs(want[0] - readings_of(token, got, r.logp, spaced)) < 1e-6, (token, got, want, z)


def readings_of(token, text, logp, spaced):
    """Score of one reading, the best of its paths."""
    token = T._LONG_RUN.sub(r"\1\1\1", token.lower())
    costs = {"": 0.0}
    for at in range(len(token)):
        new = {}
        for t, cost in costs.items():
            for letters, c in T.arcs_of(token, at, spaced):
                if text.startswith(t + letters):
                    new[t + letters] = max(new.get(t + letters, -np.inf), cost + c - (2.0 if not letters else 0.0))
        costs = new
    z = [0, 0, *[T._SYMBOL_OF.get(c, 27) for c in text], 0]
    return costs[text] + sum(logp[(a * T.N + b) * T.N + c] for a, b, c in zip(z, z[1:], z[2:]))


def test_doubled_letters_equal_the_lattice():
    r, rng = reader(), random.Random(1)
    for _ in range(3000):
        word = "".join(c * rng.choice([1, 1, 2]) for c in rng.choices("etaoinsrhldcumfpgwybvkxjqzé", k=rng.randint(1, 9)))
        if not T._RUN.search(word):
            assert T.undouble(word, r.logp) == T.restore(word, r.logp), word


def test_memo_forgets_in_bytes(monkeypatch):
    monkeypatch.setattr(T, "MEMO_BYTES", 10_000)
    memo = T.Memo(reader(), lambda words: [(w, 1.0) for w in words])
    for i in range(100):
        texts = [f"word{i}-{k} stuupid {'x' * 500}{i}{k}" for k in range(3)]
        assert all({("stupid", 1.0)} <= found for found in memo.words(texts))
        assert len(memo.known) < 100


def test_features_tell_first_letters_and_lengths_apart():
    words = ["a", "stup", "stupid", "stupidity", "idiotic", "idiot", "é" * 9, "x" * 40 + "a", "x" * 40 + "b", "stupidity" * 2 + "abcdef"]
    bins, sizes = T.bins_of_all(words)
    assert sizes.tolist() == [1, 1, 3, 6, 4, 2, 6, 6, 6, 6]
    of = {w: set(T.bins_of(w)) for w in words}
    assert [b for w in words for b in T.bins_of(w)] == bins.tolist()
    assert of["stupid"] & of["stupidity"] and not of["stup"] & of["idiot"] and of["idiot"] & of["idiotic"]
    assert of["x" * 40 + "a"] != of["x" * 40 + "b"] and len(of["x" * 40 + "a"] & of["x" * 40 + "b"]) == 5
    # a word is another feature than the same letters at the start of a longer one
    assert T.bins_of("stup")[0] != T.bins_of("stupid")[0]
    assert T.bins_of_all([]) [0].tolist() == []


def test_tokens_with_nothing_to_restore_are_words_without_being_read(monkeypatch):
    reader = T.Reader(T.log_model(np.random.default_rng(0).poisson(3, T.N ** 3).astype(float)))
    asked = []
    read = T.Reader.read
    monkeypatch.setattr(T.Reader, "read", lambda self, t: asked.append(t) or read(self, t))
    signs = random.Random(3)
    alphabet = "abcde fgéßİǅ ABC aa bb 01$@*!.,'-_\"(«»¿ñ \x1c\x85ʰ…²"
    plain = {"river", "River,", "\"stone.", "1984", "…", "été."}
    odd = {"st*pid", "$tupid", "stuupid", "l8r"}
    tokens = plain | odd | set("".join(signs.choice(alphabet) for _ in range(4000)).split())
    memo = T.Memo(reader, lambda words: [w if len(w) % 3 else None for w in words])
    memo.learn(tokens)
    assert not plain & set(asked) and odd <= set(asked)
    assert memo.known == {t: tuple(w for w in read(reader, t) if len(w) % 3) for t in tokens}


def test_reading_a_batch_leaves_the_collector_as_it_was():
    import gc

    import pyarrow as pa
    seen = []

    class Watched(T.Scorer):
        def score_inputs(self, texts):
            seen.append(gc.isenabled())
            return super().score_inputs(texts)

    zero = np.zeros(T.BINS, np.int32)
    scorer = Watched(T.log_model(np.zeros(T.N ** 3)), zero, zero, 1, 1)
    for on in (True, False):
        (gc.enable if on else gc.disable)()
        try:
            assert scorer.batch_inputs(pa.array(["some st*pid words", None])).shape == (2, 4)
            assert gc.isenabled() == on
        finally:
            gc.enable()
    assert seen == [False, False]
