"""Per-domain boilerplate learning (A3-A8, W1, U1, U4) and removal (J4), S7 sink.

Fitting explodes sentences / line edges / short n-grams of all texts of a domain
and counts them with map-side partial aggregation; ``samples`` limits it to the
first entries of every domain (W1, a ``WindowGroupLimit``).  Removal joins each entry to its
domain's phrase list (AQE broadcasts it when the measured size is small and
splits skewed domains otherwise) and folds the phrases over the text with
native expressions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linkloom.functions.patterns import caseless
from linkloom.functions.text import mostly_stopwords, strip
from linkloom.operators.ranking import first_per_group

WORD = r"[\p{L}\p{N}_]+"   # a word in both Java and RE2 (Python's Unicode \w)


def sample_valid_texts(df: DataFrame, text_col: str = "scraped", min_domain_size: int = 3,
                       samples: int | None = None, min_text_length: int = 3,
                       locked: DataFrame | None = None) -> DataFrame:
    """Texts of domains with at least ``min_domain_size`` entries (all of them, or
    W1's first ``samples`` entries); texts longer than ``min_text_length`` kept.
    Domains in ``locked`` (already fitted) are skipped (U4)."""
    sizes = df.groupBy("domain").agg(F.count(F.lit(1)).alias("_size")).filter(F.col("_size") >= min_domain_size)
    if locked is not None:
        sizes = sizes.join(locked.select("domain").distinct(), "domain", "left_anti")
    texts = df.select("domain", "pos", F.col(text_col).alias("text"))
    if samples is None:
        picked = texts.join(sizes.select("domain"), "domain", "left_semi")
    else:
        # rank on the narrow (domain, pos) projection only - texts never enter the
        # window sort - then keep rows up to each domain's cut-off position (one
        # row per domain: AQE broadcasts it when small, else a skew-split join)
        keys = first_per_group(df.select("domain", "pos"), "domain", "pos", samples)
        cut = keys.groupBy("domain").agg(F.max("pos").alias("_cut")).join(sizes.select("domain"), "domain", "left_semi")
        picked = texts.join(cut, "domain").filter(F.col("pos") <= F.col("_cut")).drop("_cut")
    valid = picked.filter(F.col("text").isNotNull() & (F.length("text") > min_text_length))
    n_docs = valid.groupBy("domain").agg(F.count(F.lit(1)).alias("n_docs"))
    return valid.join(n_docs, "domain").select("domain", "pos", "text", "n_docs")


def _min_count(freq: float) -> Column:
    return F.greatest(F.lit(2), F.floor(F.col("n_docs") * F.lit(freq)).cast("bigint"))


def _frequent(counts: DataFrame, freq: float, test_stopwords: bool, min_len: int | None, max_len: int | None):
    """Occurrences >= max(2, int(n_docs * freq)) plus optional tests."""
    cond = F.col("n") >= _min_count(freq)
    if test_stopwords:
        cond = cond & ~mostly_stopwords(F.col("phrase"))
    if min_len is not None:
        cond = cond & (F.length("phrase") >= min_len) & (F.length("phrase") <= max_len)
    return counts.filter(cond)


def common_sentences(texts: DataFrame, freq: float = 0.75, ngram_range=(2, 10)) -> DataFrame:
    """A3: sentences split on [.!?]+, stripped, length >= 2, frequent, 2-10 chars."""
    lo, hi = ngram_range
    s = texts.select("domain", "n_docs", F.explode(F.split("text", r"[.!?]+")).alias("phrase")) \
        .select("domain", "n_docs", strip(F.col("phrase")).alias("phrase")) \
        .filter(F.length("phrase") >= lo)
    # the length test does not depend on the count: apply it before the shuffle
    s = s.filter(F.length("phrase") <= hi)
    counts = s.groupBy("domain", "n_docs", "phrase").agg(F.count(F.lit(1)).alias("n"))
    return _frequent(counts, freq, True, lo, hi).select("domain", "phrase", F.lit("sentence").alias("kind"), "n")


def common_line_edges(texts: DataFrame, freq: float = 0.75, min_len: int = 2) -> DataFrame:
    """A4: lines longer than 15 chars; first/last 30 chars stripped; frequent."""
    lines = texts.select("domain", "n_docs", F.explode(F.split("text", "\n")).alias("line")) \
        .select("domain", "n_docs", strip(F.col("line")).alias("line")) \
        .filter(F.length("line") > 15)
    edges = lines.select("domain", "n_docs", F.explode(F.array(
        F.struct(F.lit("prefix").alias("kind"), strip(F.substring("line", 1, 30)).alias("phrase")),
        F.struct(F.lit("suffix").alias("kind"), strip(F.expr("right(line, 30)")).alias("phrase")))).alias("e")) \
        .select("domain", "n_docs", "e.kind", "e.phrase").filter(F.length("phrase") >= min_len)
    counts = edges.groupBy("domain", "n_docs", "kind", "phrase").agg(F.count(F.lit(1)).alias("n"))
    return _frequent(counts, freq, True, None, None).select("domain", "phrase", "kind", "n")


def ngrams_upto_chars(words: Column, n_lo: int, n_hi: int, max_chars: int) -> Column:
    """All word n-grams (n_lo <= n < n_hi) no longer than ``max_chars``.

    Built by ``zip_with`` over shifted copies of the word array: the (n)-gram
    at i extends the (n-1)-gram at i by word i+n-1, one linear pass per size.
    An over-long gram is nulled and never extended, and sizes above
    (max_chars+1)//2 are not generated at all (n words need 2n-1 chars).
    """
    top = min(n_hi - 1, (max_chars + 1) // 2)
    out = []
    grams = words
    for n in range(2, top + 1):
        nxt = F.slice(words, n, F.greatest(F.size(words), F.lit(1)))
        grams = F.zip_with(grams, nxt, lambda g, w: F.when(
            g.isNotNull() & w.isNotNull() & (F.length(g) + F.length(w) + 1 <= max_chars),
            F.concat(g, F.lit(" "), w)))
        if n >= n_lo:
            out.append(F.filter(grams, lambda g: g.isNotNull()))
    return F.flatten(F.array(*out)) if out else F.array().cast("array<string>")


def common_ngrams(texts: DataFrame, freq: float = 0.75, ngram_range=(2, 10)) -> DataFrame:
    """A5: lower-cased words, n = lo..hi-1, joined; frequent, not mostly
    stopwords, 2-10 characters (length filter applied before the shuffle)."""
    lo, hi = ngram_range
    words = texts.select("domain", "n_docs",
                         F.regexp_extract_all(F.lower(F.col("text")), F.lit(WORD), 0).alias("words"))
    grams = words.select("domain", "n_docs", F.explode(ngrams_upto_chars(F.col("words"), lo, hi, hi)).alias("phrase")) \
        .filter(F.length("phrase") >= lo)
    counts = grams.groupBy("domain", "n_docs", "phrase").agg(F.count(F.lit(1)).alias("n"))
    return _frequent(counts, freq, True, lo, hi).select("domain", "phrase", F.lit("ngram").alias("kind"), "n")


def fit_boilerplate(df: DataFrame, text_col: str = "scraped", min_domain_size: int = 3, samples: int | None = None,
                    freq: float = 0.75, ngram_range=(2, 10), locked: DataFrame | None = None) -> DataFrame:
    """Union of A3 + A4 + A5 per domain, distinct (domain, phrase).

    Returns ``(domain, phrase, kind, n)``; ``kind`` is the first kind that
    found the phrase (sentence < prefix < suffix < ngram), ``n`` its largest count.
    """
    texts = sample_valid_texts(df, text_col, min_domain_size, samples, locked=locked)
    parts = common_sentences(texts, freq, ngram_range).unionByName(common_line_edges(texts, freq)) \
        .unionByName(common_ngrams(texts, freq, ngram_range))
    order = F.when(F.col("kind") == "sentence", 0).when(F.col("kind") == "prefix", 1) \
        .when(F.col("kind") == "suffix", 2).otherwise(3)
    return (parts.withColumn("_o", order).groupBy("domain", "phrase")
            .agg(F.min_by("kind", "_o").alias("kind"), F.max("n").alias("n")))


def phrase_lists(boilerplate: DataFrame) -> DataFrame:
    """(domain, phrases): longest first, ties by phrase - the order removal uses."""
    return (boilerplate.select("domain", "phrase").distinct()
            .groupBy("domain")
            .agg(F.array_sort(F.collect_list(F.struct((-F.length("phrase")).alias("k"), F.col("phrase").alias("p"))))
                 .alias("_ps"))
            .select("domain", F.transform("_ps", lambda s: s["p"]).alias("phrases")))


def remove_phrases(text: Column, phrases: Column) -> Column:
    """J4 on one text: multi-word phrases as whole words ignoring case, single
    words as literal case-sensitive substrings, each replaced by a space;
    then spaces collapsed, blank-line runs -> one blank line, strip."""
    def step(acc, p):
        t, low = acc["t"], acc["low"]
        multi = F.size(F.split(strip(p), r"(?U)\s+")) > 1
        # most phrases are not in the text: a plain search decides before a pattern is built
        here = F.when(multi, F.contains(low, caseless(p))).otherwise(F.contains(t, p))
        new = F.when(multi, F.regexp_replace(t, F.concat(F.lit(r"(?iU)\b\Q"), p, F.lit(r"\E\b")), F.lit(" "))) \
            .otherwise(F.replace(t, p, F.lit(" ")))
        return F.when(here, F.struct(new.alias("t"), caseless(new).alias("low"))).otherwise(acc)
    start = F.struct(text.alias("t"), caseless(text).alias("low"))
    folded = F.aggregate(phrases, start, step)["t"]
    folded = F.regexp_replace(folded, " {2,}", " ")
    folded = F.regexp_replace(folded, r"(?U)\n\s*\n", "\n\n")
    return strip(folded)


def remove_boilerplate(df: DataFrame, boilerplate: DataFrame, text_col: str = "clean_text",
                       when: Column | None = None, out_col: str | None = None) -> DataFrame:
    """Left join each entry to its domain's phrases; unknown domains and
    empty / blank texts pass through unchanged."""
    lists = phrase_lists(boilerplate)
    joined = df.join(lists, "domain", "left")
    t = F.col(text_col)
    applies = F.col("phrases").isNotNull() & (F.size("phrases") > 0) & t.isNotNull() & ~t.rlike(r"^(?U)\s*$")
    if when is not None:
        applies = applies & when
    return joined.withColumn(out_col or text_col, F.when(applies, remove_phrases(t, F.col("phrases"))).otherwise(t)) \
        .drop("phrases")


def disjoint_phrases(boilerplate: DataFrame) -> DataFrame:
    """Per domain, longest first (ties by phrase), keep a phrase only if
    none of its lower-cased tokens was seen in a kept phrase."""
    lists = phrase_lists(boilerplate)
    init = F.struct(F.array().cast("array<string>").alias("seen"), F.array().cast("array<string>").alias("out"))

    def step(acc, p):
        toks = F.array_distinct(F.filter(F.split(F.lower(p), r"(?U)\s+"), lambda x: x != ""))
        clash = F.arrays_overlap(acc["seen"], toks)
        return F.when(clash, acc).otherwise(
            F.struct(F.array_union(acc["seen"], toks).alias("seen"), F.array_append(acc["out"], p).alias("out")))
    kept = lists.select("domain", F.aggregate("phrases", init, step)["out"].alias("kept"))
    return kept.select("domain", F.explode("kept").alias("phrase"))


# --- S7: boilerplate map sink / source ----------------------------------------
def write_boilerplate(boilerplate: DataFrame, path: str, override: bool = False) -> bool:
    """Sorted phrase list per domain as JSON lines; an existing map is kept
    unless ``override``.  Returns True when written."""
    spark = boilerplate.sparkSession
    jvm = spark.sparkContext._jvm
    hpath = jvm.org.apache.hadoop.fs.Path(path)
    fs = hpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if fs.exists(hpath) and not override:
        return False
    out = boilerplate.groupBy("domain").agg(F.sort_array(F.collect_set("phrase")).alias("phrases"))
    out.write.mode("overwrite").json(path)
    return True


def read_boilerplate(spark, path: str) -> DataFrame:
    """Loaded domains count as locked: ``fit_boilerplate(locked=...)`` skips them."""
    m = spark.read.schema("domain STRING, phrases ARRAY<STRING>").json(path)
    return m.select("domain", F.explode("phrases").alias("phrase"), F.lit("loaded").alias("kind"),
                    F.lit(None).cast("bigint").alias("n"))


def refit_boilerplate(df: DataFrame, existing: DataFrame, **kw) -> DataFrame:
    """U4: fit only domains absent from ``existing`` and union the result."""
    fresh = fit_boilerplate(df, locked=existing, **kw)
    return existing.unionByName(fresh)
