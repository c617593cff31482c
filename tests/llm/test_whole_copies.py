"""Decontamination of copies that are shorter or longer than their item, and of long items."""

import random

from linkloom.llm import decontaminate as C
from test_text_filters import edit


def best_run(words, item):
    """(edits, start) of the run of words nearest to the item, the first of equals."""
    return min(((min(edit(words[s:e], item) for e in range(s, min(len(words), s + 2 * len(item)) + 1)), s)
                for s in range(len(words))), default=(99, 0))


def test_substring_distances():
    rng = random.Random(1)
    for _ in range(20):
        item, words = [[rng.randrange(2, 6) for _ in range(n)] for n in (6, 11)]
        got = C.substring_distances(*(C.np.array([x]) for x in (item, words)))[0].tolist()
        assert got == [min(edit(words[s:e], item) for e in range(s, 12)) for s in range(11)]


def test_shorter_and_longer_copies_are_found(spark):
    rng = random.Random(4)
    vocabulary = [f"w{i}" for i in range(300)]
    items = [(i, [rng.choice(vocabulary) for _ in range(rng.choice((15, 38, 59)))]) for i in range(12)]
    docs = []
    for i, it in items:
        d = len(it) // 5
        for kind in ("delete", "insert", "mixed", "alone"):
            c = list(it)
            for _ in range(1 if kind == "alone" else d):
                p = rng.randrange(len(c))
                if kind in ("delete", "alone") or kind == "mixed" and rng.random() < 0.5:
                    del c[p]
                else:
                    c.insert(p, "zz")
            around = [] if kind == "alone" else [rng.choice(vocabulary) for _ in range(20)]
            docs.append((len(docs), " ".join(around[:10] + c + around[10:])))
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(2)
    bench = spark.createDataFrame([(i, " ".join(w)) for i, w in items], "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]): (r["edits"], r["start_word"])
           for r in C.contaminated(df, bench, substrings=True).collect()}
    want = {(d, d // 4): best_run(t.split(), items[d // 4][1]) for d, t in docs}
    assert set(got) <= set(want) and len(got) >= 0.9 * len(want)
    assert all(got[k] == want[k] for k in got)
    assert sum(k in got for k in want if k[0] % 4 == 3) >= 11
    kept = {r["doc_id"] for r in C.drop_contaminated(df, bench, substrings=True).collect()}
    assert kept == {d for d, _ in docs} - {d for d, _ in got}


def test_long_items_among_short_ones():
    rng = random.Random(6)
    vocabulary = [f"w{i}" for i in range(3000)]
    rows = [(i, [rng.choice(vocabulary) for _ in range(n)]) for i, n in enumerate([15] * 65 + [59] * 6 + [300] * 10)]
    items = C.Items(rows, 0.8, 0.99, 2)
    assert items.repeats[15] and items.repeats[300] is None
    texts, want = [], set()
    for k, w in rows[65:]:
        for change in ("zz", None):
            c = list(w)
            for p in sorted(rng.sample(range(len(c)), len(c) // 5), reverse=True):
                c[p:p + 1] = [change] if change else []
            want.add((len(texts), k))
            texts.append(" ".join(["x"] * 9 + c + ["y"] * 9))
    got = {(d, k) for d, k, _, _ in C.find_items(texts, items, C._Ids(items.vocabulary), True)}
    assert {p for p in want if p[1] >= 71} <= got <= want and len(got) >= len(want) - 1
