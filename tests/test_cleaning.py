"""Cleaning groups and boilerplate removal against Python ``re`` - the regex
engine the original patterns were written for."""

import re

from pyspark.sql import functions as F

from linkloom.functions import patterns as PT

PY_FLAGS = {"i": re.IGNORECASE}


def py_pattern(p):
    m = re.match(r"^\(\?([a-zA-Z]+)\)", p)
    flags = 0
    if m:
        for ch in m.group(1):
            flags |= PY_FLAGS.get(ch, 0)
        p = p[m.end():]
    return re.compile(p, flags)


LITERAL = ("see [1, 2] and `x=1` in main.py #a1b2c3 a/b/c Privacy  Policy {k} ```code here``` "
           "aliasimport fromage __init__ ~~x~~ Click here! 12, 13, 14 v1.2.3.4 10.0.0.1 "
           "user@example.com 3rd March 2024 123e4567-e89b-12d3-a456-426614174000 "
           "deadbeefdeadbeefdeadbeefdeadbeef we use cookies; café naïve Ünïcödé $x+y$ $$z$$ [] () {}")


def test_every_group_matches_python_re(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    lit = spark.createDataFrame([(-1, LITERAL), (-2, "JavaScript is required"), (-3, "x\nimport os")],
                                "doc_id long, text string")
    df = docs.unionByName(lit)
    rows = df.collect()
    for name, pats in PT.REGISTRY.items():
        got = {r[0]: r[1] for r in df.select("doc_id", PT.apply_patterns(F.col("text"), pats)).collect()}
        for r in rows:
            exp = r.text
            for p in pats:
                exp = py_pattern(p).sub(" ", exp)
            assert got[r.doc_id] == exp, (name, r.doc_id)


def test_yaml_order_and_unknown_groups():
    yaml = "filter_sequence:\n  - LATEX_PATTERNS\n  - NOPE\n  - CITATION_PATTERNS\n"
    names = PT.load_filter_order(yaml)
    assert names == ["LATEX_PATTERNS", "NOPE", "CITATION_PATTERNS"]
    assert PT.resolve_sequence(names) == PT.LATEX_PATTERNS + PT.CITATION_PATTERNS


def py_remove(text, phrases):
    for p in sorted(phrases, key=lambda s: (-len(s), s)):
        if len(p.split()) > 1:
            text = re.sub(r"\b" + re.escape(p) + r"\b", " ", text, flags=re.IGNORECASE)
        else:
            text = text.replace(p, " ")
    text = re.sub(r" {2,}", " ", text)
    text = re.sub(r"\n\s*\n", "\n\n", text)
    return text.strip()


def test_j4_matches_python_re(spark, sf):
    from linkloom.operators import boilerplate as B
    from linkloom.sources.tables import docs_as_entries
    d = docs_as_entries(spark.read.parquet(f"{sf}/documents.parquet"))
    bp = B.fit_boilerplate(d, "scraped", freq=0.1)
    lists = {r.domain: r.phrases for r in B.phrase_lists(bp).collect()}
    assert lists, "fixture must produce phrases"
    got = {r.pos: r.filtered for r in B.remove_boilerplate(d, bp, "scraped", out_col="filtered").collect()}
    for r in d.collect():
        phrases = lists.get(r.domain)
        exp = r.scraped if not phrases or not r.scraped or r.scraped.isspace() else py_remove(r.scraped, phrases)
        assert got[r.pos] == exp, r.pos


def test_disjoint_phrases(spark):
    from linkloom.operators.boilerplate import disjoint_phrases
    bp = spark.createDataFrame([("d", "alpha beta gamma"), ("d", "beta x"), ("d", "delta"), ("d", "Gamma z"),
                                ("e", "one two")], "domain string, phrase string")
    got = sorted((r.domain, r.phrase) for r in disjoint_phrases(bp).collect())
    assert got == [("d", "alpha beta gamma"), ("d", "delta"), ("e", "one two")]


def test_phrases_are_removed_as_by_single_patterns(spark):
    """The fold equals pattern after pattern, also where a removal makes a new phrase."""
    import random
    from linkloom.operators import boilerplate as B
    rng = random.Random(5)
    words = ["ab", "Ab", "x", "x y", "AB x", "straße", "ſo", "SO it", "so it", "K l", "k L", "İz b", "ΣΑΣ α", "a.b c", "axb", "a b"]
    rows = [(i, [rng.choice(words) for _ in range(rng.randint(0, 6))],
             rng.choice([" ", "", "\n"]).join(rng.choice(words + ["K l", "σας α", "iz b", "\n \n"]) for _ in range(rng.randint(0, 12)))) for i in range(400)]
    df = spark.createDataFrame(rows, "id long, phrases array<string>, text string")

    def old(text, phrases):
        def step(t, p):
            multi = F.size(F.split(F.trim(p), r"(?U)\s+")) > 1
            return F.when(multi, F.regexp_replace(t, F.concat(F.lit(r"(?iU)\b\Q"), p, F.lit(r"\E\b")), F.lit(" "))).otherwise(
                F.replace(t, p, F.lit(" ")))
        t = F.regexp_replace(F.aggregate(phrases, text, step), " {2,}", " ")
        return B.strip(F.regexp_replace(t, r"(?U)\n\s*\n", "\n\n"))
    out = df.select("text", "phrases", B.remove_phrases(F.col("text"), F.col("phrases")).alias("a"), old(F.col("text"), F.col("phrases")).alias("b"))
    assert [r for r in out.collect() if r["a"] != r["b"]] == []


def test_the_pattern_chain_runs_once(spark):
    from linkloom.functions import text as T
    from linkloom.operators import clean as C
    df = spark.createDataFrame([(1, "\u00c9t\u00e9 d'or import x `q` main.py here two words"), (2, None), (3, "more")], "id long, text string").repartition(2)
    for c in (C.clean_column(F.col("text")), C.basic_clean(F.col("text"))):
        # it stands in the plan once, however often its tokens are read
        plan = df.select(c.alias("c"))._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count(r"accept\s+(?:all\s+)?cookies") == 1
    # with Python functions before and after it
    folded = df.select("id", T.to_ascii(C.clean_column(F.col("text"), sequence=["CODE_PATTERNS"])).alias("c"))
    assert dict(folded.collect()) == {1: "Ete d'or import two words", 2: "", 3: ""}
