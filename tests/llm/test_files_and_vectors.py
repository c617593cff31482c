"""WARC round trips, packing, nearest neighbours."""

import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from linkloom.llm import packing as P
from linkloom.llm import warc as W
from linkloom.llm.ann import nearest

TOKENIZER = "byte_bpe_50k.json"


def test_chunks_round_trip():
    rng = random.Random(2)
    for _ in range(200):
        payload = "".join(rng.choice(["a", "é", "€", "\r\n", "WARC/1.1\r\n", "0\r\n\r\n", "𝄞"]) for _ in range(rng.randint(0, 60))).encode()
        pieces = W.chunked(payload, rng.randint(1, 9))
        body = b"".join(pieces)
        assert W.dechunk(body) == payload and b"WARC/1.1\r\n" not in body
        for p in pieces:
            p.decode()
    for bad in (b"5\r\nab", b"zz\r\n", b"", b"2\r\nabXX0\r\n\r\n"):
        with pytest.raises(ValueError):
            W.dechunk(bad)


def test_warc_round_trip(spark):
    big = "<html>" + "é€ WARC/1.1\r\n" * 300 + "</html>"
    rows = [(1, "http://a/1", big), (2, "http://a/2", big), (3, None, big), (4, "http://a/4", "small"), (5, "x\r\ny", "small"),
            (6, "http://a/6", None), (7, "http://a/7", ""), (None, "http://a/n", big), (8, "u", "z" * 1000), (9, "u", "z" * 999),
            (10, "u", "z" * 999), (4, "http://a/4", "small"), (11, "http://a/11", "w" * 200_000), (12, "u", big + "!"), (12, "u", big + "!")]
    df = spark.createDataFrame([(*r, "d", "b") for r in rows], "page_id long, url string, html string, digest string, block string")
    got = W.round_trip(df, chunk_bytes=100, segment_bytes=700, records_a_file=20).collect()
    assert len(got) == len(rows) and not [r for r in got if r["problem"]]
    want = []
    for i, _, h in rows:
        p = (h or "").encode()
        same = [j for j, _, x in rows if x == h and j is not None]
        top = max(same) if len(p) >= 1000 and same else i
        visit = i is not None and top != i
        want.append((i, len(p), hashlib.sha1(p).hexdigest(), "revisit" if visit else "response", top if visit else None))
    assert sorted(((r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in got), key=str) == sorted(want, key=str)
    assert W.round_trip(df.limit(0)).count() == 0


def test_damaged_segments_are_reported(spark, tmp_path):
    df = spark.createDataFrame([(1, "u", "a" * 5000), (2, "v", "b" * 50)], "page_id long, url string, html string")
    W.write_archives(df, str(tmp_path / "w"), segment_bytes=1000, chunk_bytes=500)
    records = W.read_records(spark, str(tmp_path / "w"))
    assert records.where("type = 'continuation'").count() >= 4
    for broken, problem in ((records.where("segment <> 2"), "segments missing or in conflict"), (records.where("segment <> 1 or page_id = 2"), "first segment missing"),
                            (records.withColumn("total", F.col("total") + 1), "total length differs")):
        out = {r["page_id"]: r["problem"] for r in W.reassemble(broken).collect()}
        assert out.pop(2) is None and list(out.values()) == [problem]


def test_chunked_encoding_equals_whole(spark):
    path = public_tokenizers.path(TOKENIZER)
    tk = Tokenizer.from_file(path)
    rng = random.Random(4)
    texts = ["", " ", "  ", "a  b", " lead", "trail ", "x\n\ny z", "<|endoftext|> hi", "a <|endoftext|> b", "q\n r", "\n", "  y", "a　 b c", "it's 12,5 it 's"]
    texts += ["".join(rng.choice(["ab", "é", " ", "\n", "1", "'s", ",", "the", "\t", "字"]) for _ in range(rng.randint(0, 40))) for _ in range(300)]
    # every kind of letter, digit, mark and space next to every other
    every = [chr(c) for c in [*range(0x0, 0xD800, 5), *range(0xE000, 0x20000, 11)]]
    texts += [" ".join(f"a{c}b1{c}2 {c}{c}x !{c}! {c} {c}1\n{c}" for c in every[at:at + 64]) for at in range(0, len(every), 64)]
    texts += [" " * 5000, "ab" * 5000, "é" * 5000, "\n \n" * 2000, "<|endoftext|>" * 3, "<|endoftext"]
    assert P.encoder(path).fast is not None
    for t, ids in zip(texts, P.batch_ids(texts, path)):
        assert np.frombuffer(ids, "<u4").tolist() == tk.encode(t, add_special_tokens=False).ids, t


def test_other_vocabularies_are_encoded_by_their_library():
    path = public_tokenizers.path("word_bpe_49k.json")
    e, tk = P.Encoder(path), Tokenizer.from_file(path)
    assert e.fast is None
    assert np.frombuffer(e.ids("Hello, the  World"), "<u4").tolist() == tk.encode("Hello, the  World", add_special_tokens=False).ids


@pytest.mark.parametrize("limits", [(64, 1000, 64), (64, 3, 64), (64, 1000, 20), (50, 7, 33)])
def test_place_keeps_limits(limits):
    rng = random.Random(3)
    sizes = [rng.choice([0, 1, 2, 64, 65, 500, rng.randint(1, 200)]) for _ in range(300)]
    loss = [rng.randint(0, n) for n in sizes]
    pieces, seqs = P.place(sizes, loss, limits)
    cover, seq = {}, {}
    for i, s, n, q, o in pieces:
        assert n > 0
        cover.setdefault(i, []).append((s, n))
        seq.setdefault(q, []).append((o, n, max(0, s + n - max(s, loss[i]))))
    for i, n in enumerate(sizes):
        at = 0
        for s, m in sorted(cover.get(i, [])):
            assert s == at
            at += m
        assert at == n
    assert sorted(seq) == list(range(seqs))
    for parts in seq.values():
        at = 0
        for o, n, _ in sorted(parts):
            assert o == at
            at += n
        assert at <= limits[0] and len(parts) <= limits[1] and sum(x[2] for x in parts) <= limits[2]


def test_pack_documents(spark):
    rng = random.Random(1)
    texts = [None, "", "a", "a", "word " * 9000] + [" ".join(rng.choice(["alpha", "beta", "gamma,", "é"]) for _ in range(rng.randint(1, 900))) for _ in range(60)]
    rows = [(i, t, 1, 2, "x") for i, t in enumerate(texts)] + [(None, "null id", 1, 2, "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, start long, offset long, ids string").repartition(3)
    got = P.pack_documents(df, TOKENIZER).collect()
    tk = Tokenizer.from_file(public_tokenizers.path(TOKENIZER))
    ids = {i: tk.encode(t or "", add_special_tokens=False).ids + [0] for i, t, *_ in rows}
    seen = {i: [] for i in ids}
    total, seq = 0, {}
    for r in got:
        part = ids[r["doc_id"]][r["start"]:r["start"] + r["length"]]
        assert len(part) == r["length"] and r["doc_tokens"] == len(ids[r["doc_id"]])
        assert r["ids_crc32"] == zlib.crc32(np.asarray(part, "<u4").tobytes())
        seen[r["doc_id"]].append((r["start"], r["length"]))
        seq.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for i, parts in seen.items():
        assert [s for s, _ in sorted(parts)] == np.cumsum([0] + [n for _, n in sorted(parts)]).tolist()[:-1]
        assert sum(n for _, n in parts) == len(ids[i])
    sizes = [sum(n for _, n in p) for p in seq.values()]
    assert max(sizes) <= 1024 and sum(1024 - s for s in sizes if s & (s - 1)) == 0
    assert P.pack_documents(df.limit(0), TOKENIZER).count() == 0


def brute(rows, k):
    ok = [(i, np.asarray(v, float)) for i, v in rows if i is not None and v is not None and len(v) == 8 and None not in v
          and np.isfinite(np.asarray(v, float)).all() and np.any(np.asarray(v, float) != 0)]
    out = {}
    for i, q in ok:
        if i % 20 == 0:
            out[i] = sorted({(-float(x @ q), j) for j, x in ok if j != i})[:k]
    return out


def test_nearest_equals_brute_force_on_a_full_search(spark):
    rng = np.random.default_rng(3)
    rows = [(i, rng.integers(-5, 6, 8).astype(float).tolist()) for i in range(400)]
    rows += [(400 + i, rows[7][1]) for i in range(60)] + [(500, None), (520, [0.0] * 8), (540, [float("nan")] * 8), (560, [1.0, None] * 4),
                                                         (580, [float("inf")] + [1.0] * 7), (600, [1.0] * 7), (None, rows[3][1]), rows[20]]
    df = spark.createDataFrame([(*r, "a", 1, 2) for r in rows], "vec_id long, embedding array<double>, rep string, tree int, v int").repartition(4)
    got = {}
    for r in nearest(df, F.col("id") % 20 == 0, trees=4, leaves=8, search=5.0).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((-r["score"], r["vec_id"], r["rank"]))
    want = brute(rows, 20)
    assert got.keys() == want.keys()
    for q, best in want.items():
        assert [x[1] for x in got[q]] == [j for _, j in best], q
        assert [x[2] for x in got[q]] == list(range(1, 21)) and np.allclose([x[0] for x in got[q]], [s for s, _ in best])


def test_nearest_recall_and_small_tables(spark):
    df = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    data = df.select("vec_id", "embedding").collect()
    x = np.array([r[1] for r in data], dtype=float)
    ids = np.array([r[0] for r in data])
    got = {}
    for r in nearest(df, F.col("id") % 20 == 0).collect():
        got.setdefault(r["query_id"], set()).add(r["vec_id"])
    hit = total = 0
    for q in ids[ids % 20 == 0]:
        s = x @ x[ids == q][0]
        s[ids == q] = -np.inf
        best = set(ids[np.lexsort((ids, -s))[:20]].tolist())
        hit, total = hit + len(best & got[q]), total + 20
    assert hit / total >= 0.9
    few = df.where("vec_id in (0, 1, 2)")
    assert [r["vec_id"] for r in nearest(few, F.col("id") % 20 == 0).collect()] in ([1, 2], [2, 1])
    assert nearest(df.limit(0), F.col("id") % 20 == 0).count() == 0
    assert nearest(df.where("vec_id = 0"), F.col("id") % 20 == 0).count() == 0
