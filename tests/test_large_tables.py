"""What larger tables brought up: rows and sizes that the small ones do not have."""

from linkloom.plans.registry import load_all

QUERIES, _ = load_all()


def test_an_empty_text_is_not_overcleaned(spark, tmp_path):
    spark.createDataFrame([(1, ""), (2, "1 2 3 " * 50), (3, "plain river words here"), (4, None)], "doc_id long, text string").write.parquet(
        f"{tmp_path}/documents.parquet")
    for name in ("t16_overcleaned", "t16_overcleaned_whole", "t16_overcleaned_limited"):
        got = {r["doc_id"]: (r["overcleaned"], r["n_clean"]) for r in QUERIES[name](spark, str(tmp_path)).collect()}
        assert got[1] == (False, 0) and got[2] == (True, 0) and got[3][0] is False and got[4][0] is None


def test_rows_climb_deep_trees_by_doubling(spark, monkeypatch):
    import random

    from linkloom.operators import hierarchy
    written = []
    plain = hierarchy.written_table
    monkeypatch.setattr(hierarchy, "written_table", lambda df, name: written.append(name) or plain(df, name))
    rng = random.Random(5)
    # a chain of 200 clusters with some side branches; births fall on the way up, some are equal
    tree, birth = [(0, None, 0.0, None)], {0: 0.0}
    for i in range(1, 260):
        up = i - 1 if i < 200 else rng.randrange(200)
        birth[i] = birth[up] + rng.choice([0.0, 0.5, 1.0])
        tree.append((i, up, birth[i], i if i % 3 else None))
    rows = [(q, rng.randrange(260), rng.choice([0.0, birth[rng.randrange(260)], rng.uniform(0, 120)])) for q in range(500)]
    known = {h: (p, b, lab) for h, p, b, lab in tree}
    want = {}
    for q, h, lam in rows:
        while known[h][0] is not None and known[h][1] >= lam:
            h = known[h][0]
        want[q] = (lam, known[h][2])
    rows.append((1000, None, 1.0))
    want[1000] = (1.0, None)
    got = hierarchy.climb(spark.createDataFrame(tree, "head long, parent long, birth double, label long"),
                          spark.createDataFrame(rows, "q long, head long, lam double"))
    assert {r["q"]: (r["lam"], r["label"]) for r in got.collect()} == want
    assert len(written) < 15


def test_streamed_keywords_ask_for_shared_terms_only(spark, tmp_path):
    import random

    from linkloom.operators import keywords as K
    from linkloom.plans.q_streaming import ranged_files
    rng = random.Random(3)
    words = [f"word{i}" for i in range(60)]
    rows = [(i % 90 if i < 100 else None, " ".join(rng.choices(words, k=30)) + f" only{i}") for i in range(110)]  # ids that repeat, null ids
    d = spark.createDataFrame(rows, "doc_id long, text string")
    d.write.parquet(f"{tmp_path}/documents.parquet")
    freq, n = K.document_frequencies(d, "doc_id", "text")
    assert n == 91 and freq.where("df < 2 or gram like 'only%'").isEmpty()
    full = K.term_counts(d, "doc_id", "text").groupBy("gram").count()
    assert {tuple(r) for r in freq.collect()} == {tuple(r) for r in full.where("count > 1").collect()}
    got = {tuple(r) for r in QUERIES["r2_stream_keywords"](spark, str(tmp_path)).collect()}
    want = K.keywords(d, "doc_id", "text", 10).selectExpr("doc_id", "keyword", "round(score, 4)", "rank")
    assert got == {tuple(r) for r in want.collect()}
    ranged_files(d, "doc_id", f"{tmp_path}/files", 5)
    files = spark.read.parquet(f"{tmp_path}/files").selectExpr("doc_id", "_metadata.file_name as f")
    assert files.count() == 100 and files.groupBy("doc_id").agg({"f": "max"}).count() == files.distinct().count() == 90


def test_clusters_do_not_hash_texts_again_when_read(spark, sf):
    out = QUERIES["m12_cluster_and_label"](spark, sf)
    assert "regexp_extract_all" not in out._jdf.queryExecution().optimizedPlan().toString()
    assert out.count() == spark.read.parquet(f"{sf}/documents.parquet").count()


def test_patterns_that_cannot_match_are_not_searched(spark):
    from pyspark.sql import functions as F

    from linkloom.functions import patterns as PT
    texts = ["Javascript is required", "ENABLE  JavaScrıpt now", "cooKieſ please enable", "404 Error", "access  denied", "your browser is not supported",
             "you are being redirected", "accept all cookİes", "we use cookies", "privacy policy", "terms of service", "Copyright 2020",
             "all riGhtſ reserved", "```code``` `x`", "a.py 0123456789abcdef0123456789abcdef", "x $a$ $$b$$ {c} [1, 2] 3 Jan 2020", "me@home.org #a1b2c3 1.2.3.4 a/b/c/d",
             "00000000-0000-0000-0000-000000000000", "main menu Tools sIgn up hİde clicK here share this newsletter related posts", "1, 2, 3 é  [ ] ( ) { } __ ~",
             "main`x`menu read{y}more log[1]in", "xfrom asimport nothing at all here", "", None]
    d = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, text string").withColumn("folded", PT.caseless(F.col("text")))
    every = PT.resolve_sequence(None)
    for some in [every, *[[p] for p in PT.NEEDS]]:
        both = d.select(PT.apply_patterns(F.col("text"), some).alias("a"), PT.apply_patterns(F.col("text"), some, F.col("folded")).alias("b"))
        assert both.where("not (a <=> b)").isEmpty()
    sought = d.where("id = 21").select(*[PT._needed(F.col("text"), p, F.col("folded")).alias(f"p{i}") for i, p in enumerate(every)]).first()
    assert sum(p == PT.NEVER for p in sought) >= len(PT.NEEDS) - 1


def test_near_duplicate_lines_by_a_bounded_distance(spark):
    import random

    from pyspark.sql import functions as F

    from linkloom.operators import html as H
    rng = random.Random(9)

    def changed(line):
        x = list(line)
        for _ in range(rng.randrange(0, 1 + len(x) // 4)):
            x[rng.randrange(len(x))] = rng.choice(["", "a", "é", "zz"])
        return "".join(x)
    rows = []
    for i in range(60):
        lines = ["".join(rng.choices("abé ", k=rng.randrange(0, 40))) for _ in range(6)]
        rows.append((i, "\n".join(lines + [changed(x) for x in lines if x])))
    d = spark.createDataFrame(rows, "id int, text string")
    got = d.select("id", H.drop_near_duplicate_lines(F.col("text")).alias("x"))
    assert "FLOOR" in got._jdf.queryExecution().optimizedPlan().toString().upper()
    pairs = d.select("id", F.posexplode(F.split("text", "\n")).alias("p", "l"))
    close = {(r[0], r[1], r[2]) for r in pairs.alias("a").join(pairs.alias("b"), "id").where("a.p < b.p").where(
        H.near_duplicate_ratio(F.col("a.l"), F.col("b.l")) >= 85).select("id", "a.p", "b.p").collect()}
    for i, text in got.collect():
        lines, kept = rows[i][1].split("\n"), []
        for k in range(len(lines)):
            if not any((i, j, k) in close for j in kept):
                kept.append(k)
        assert text == "\n".join(lines[k] for k in kept)


def test_topics_keep_vectors_without_texts(spark, monkeypatch):
    from linkloom.operators import topics as TP
    seen = []
    plain = TP.CL.kmeans
    monkeypatch.setattr(TP.CL, "kmeans", lambda df, *a, **b: seen.append(df.columns) or plain(df, *a, **b))
    d = spark.createDataFrame([(i, f"river {i % 3} stone {i % 5}") for i in range(30)], "pos long, text string")
    assign, _ = TP.topics(d, "pos", "text", 3, dim=16)
    assert seen == [["pos", "vec"]] and assign.count() == 30
