"""Keywords (W4-W6) and class-based TF-IDF topic words.

Scores are not a sentence-transformer's: the default scorer is TF-IDF
(normalised by the document's best score, so thresholds like 0.2 keep their
meaning); the ``embedding`` scorer is cosine similarity in the hashing
encoder's space (M1).

Rows whose id occurs once are scored where they lie; only rows that share an id meet
by shuffles.  For the best tf-idf terms a row asks for the frequencies of its most
promising terms alone (``best_terms``).
"""

from __future__ import annotations

from collections import Counter
from hashlib import md5
from heapq import nlargest, nsmallest
from itertools import chain
from math import log

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from linkloom.functions.text import is_stopword
from linkloom.operators import vectors as V
from linkloom.session import written_table

TOKEN = r"[\p{L}\p{N}_]{2,}"   # words of two or more word characters
#: terms whose frequencies every task knows, and terms that a row asks for at first
KNOWN, ASK = 50_000, 32
#: up to so many ids are broadcast
FEW_IDS = 100_000
#: hashes of features that a Python worker remembers, letters of a feature that it does for
KNOWN_HASHES, KNOWN_LETTERS = 200_000, 60


def candidate_tokens(text):
    """Lower-cased words (>= 2 chars) with English stopwords removed."""
    return F.filter(F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(TOKEN), 0),
                    lambda t: ~is_stopword(t))


def candidate_grams(text, ngram=(1, 2)):
    """1..n-grams over the stopword-free token sequence (one linear pass per n)."""
    return grams_of(candidate_tokens(text), ngram)


def grams_of(toks, ngram=(1, 2)):
    """1..n-grams of a token sequence."""
    out, grams = [], toks
    if ngram[0] <= 1:
        out.append(toks)
    for n in range(2, ngram[1] + 1):
        nxt = F.slice(toks, n, F.greatest(F.size(toks), F.lit(1)))
        grams = F.zip_with(grams, nxt, lambda g, w: F.when(g.isNotNull() & w.isNotNull(), F.concat(g, F.lit(" "), w)))
        if n >= ngram[0]:
            out.append(F.filter(grams, lambda g: g.isNotNull()))
    return F.flatten(F.array(*out))


def term_counts(df: DataFrame, id_col: str, text_col: str, ngram=(1, 2), seeds: DataFrame | None = None) -> DataFrame:
    """(id, gram, tf): one shuffle on (id, gram), combined map-side.

    Null keys are filtered explicitly: every consumer of this table (tf,
    df, class sizes) then has an identical plan below its join, so AQE
    reuses one exchange instead of tokenising the corpus once per branch.
    """
    g = df.filter(F.col(id_col).isNotNull()) \
        .select(F.col(id_col).alias("id"), F.explode(candidate_grams(F.col(text_col), ngram)).alias("gram")) \
        .filter(F.col("gram").isNotNull())
    if seeds is not None:
        s = seeds.select(F.lower(F.col(seeds.columns[0])).alias("gram")).distinct()
        g = g.join(s, "gram", "left_semi")
    return g.groupBy("id", "gram").agg(F.count(F.lit(1)).alias("tf"))


def join_ids(df: DataFrame, ids: DataFrame, n: int, how: str) -> DataFrame:
    """Semi or anti join with ``n`` ids, which are broadcast when they are few."""
    return df.join(F.broadcast(ids) if n <= FEW_IDS else ids, ids.columns[0], how)


def split_repeats(df: DataFrame, id_col: str) -> tuple[DataFrame, DataFrame | None, int]:
    """(rows whose id is theirs alone, the rows that share an id or None, number of ids); rows with a
    null id are in neither, null counts as one id."""
    ids = df.groupBy(id_col).agg(F.count(F.lit(1)).alias("n"))
    shared = (F.col("n") > 1) & F.col(id_col).isNotNull()
    n = ids.agg(F.count(F.lit(1)).alias("ids"), F.count_if(shared).alias("shared")).first()
    named = df.where(F.col(id_col).isNotNull())
    if not n["shared"]:
        return named, None, n["ids"]
    twice = written_table(ids.where(shared).select(id_col), "terms-shared")
    return join_ids(named, twice, n["shared"], "left_anti"), join_ids(named, twice, n["shared"], "left_semi"), n["ids"]


def _idf(n_docs: int, df):
    return F.log((F.lit(1.0 + n_docs)) / (F.lit(1.0) + df)) + F.lit(1.0)


def known_terms(doc_freq: DataFrame) -> dict:
    """gram -> df of the ``KNOWN`` most frequent terms."""
    rows = doc_freq.orderBy(F.desc("df"), "gram").limit(KNOWN).toArrow()  # at most KNOWN rows
    return dict(zip(rows.column("gram").to_pylist(), rows.column("df").to_pylist()))


def _promising(once: DataFrame, known: dict, n_docs: int, least: int, top_k: int, ngram) -> DataFrame:
    """(id, gram, tf, df, rest): of each row the best terms of known frequency, the terms it asks for
    (df null) and, where some are left, the first of the others (rest)."""
    weight = {g: log((1.0 + n_docs) / (1.0 + d)) + 1.0 for g, d in known.items()}
    most = log((1.0 + n_docs) / (1.0 + least)) + 1.0
    ask_at_first = ASK

    def pick(batches):
        import pyarrow as pa
        for b in batches:
            at, grams, tfs, dfs, rests = [], [], [], [], []

            def put(i, g, tf, d, rest=False):
                for column, x in zip((at, grams, tfs, dfs, rests), (i, g, tf, d, rest)):
                    column.append(x)
            for i, toks in enumerate(b.column(1).to_pylist()):
                tf = Counter()
                for n in range(max(1, ngram[0]), ngram[1] + 1):
                    tf.update(toks if n == 1 else map(" ".join, zip(*(toks[j:] for j in range(n)))))
                sure = [(x * weight[g], g) for g, x in tf.items() if g in weight]
                best = nlargest(top_k, (x for x, _ in sure))
                low = best[-1] * (1 - 1e-9) if len(best) == top_k else 0.0
                # unknown terms by the most they can reach: the larger tf, then the smaller gram
                ask = nsmallest(ask_at_first + 1, ((-x, g) for g, x in tf.items() if g not in weight and x * most >= low))
                for x, g in sure:
                    if x >= low:
                        put(i, g, tf[g], known[g])
                for k, (x, g) in enumerate(ask):
                    put(i, g, -x, None, k == ask_at_first)
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at, pa.int64())), pa.array(grams, pa.string()), pa.array(tfs, pa.int64()),
                                              pa.array(dfs, pa.int64()), pa.array(rests, pa.bool_())], names=["id", "gram", "tf", "df", "rest"])

    return once.mapInArrow(pick, f"id {once.schema['id'].dataType.simpleString()}, gram string, tf long, df long, rest boolean")


def _frequencies(once: DataFrame | None, counts: DataFrame | None, ngram) -> DataFrame:
    """(gram, df) of terms that more than one id holds, written: of rows whose id is theirs alone
    (id, toks) and of the counts of the others."""
    held = [] if once is None else [once.select(F.explode(F.array_distinct(grams_of(F.col("toks"), ngram))).alias("gram"))]
    held += [] if counts is None else [counts.select("gram")]
    held = held[0] if len(held) == 1 else held[0].unionByName(held[1])
    return written_table(held.groupBy("gram").agg(F.count(F.lit(1)).alias("df")).where("df > 1"), "terms-df")


def document_frequencies(df: DataFrame, id_col: str, text_col: str, ngram=(1, 2)) -> tuple[DataFrame, int]:
    """((gram, df) of the terms that more than one id holds, number of ids): a row whose id is its
    alone is counted where it lies."""
    once, whole, n = split_repeats(df, id_col)
    once = once.select(candidate_tokens(F.col(text_col)).alias("toks"))
    return _frequencies(once, None if whole is None else term_counts(whole, id_col, text_col, ngram), ngram), n


def best_terms(df: DataFrame, id_col: str, text_col: str, top_k: int = 10, ngram=(1, 2), seeds: DataFrame | None = None,
               doc_freq: DataFrame | None = None, n_docs: int | None = None, known: dict | None = None, least: int = 0) -> DataFrame:
    """(id, gram, score, rank): the ``top_k`` terms of each id by tf-idf, not normalised; exact.

    A row knows the frequencies of the most frequent terms and asks for those of its most
    promising other ones; the best term it did not ask for takes part in the ranking as if no
    other row had it.  Where that one comes among the best, the row's terms are all looked up,
    as are those of rows that share an id.  ``doc_freq`` (gram, df) and ``n_docs`` are counted
    unless given; terms missing there count as in ``least`` rows (of counted ones, terms of a
    single row are not kept: most terms are)."""
    once, whole, n = split_repeats(df, id_col) if seeds is None else (None, df, df.select(id_col).distinct().count())
    n_docs = n if n_docs is None else n_docs
    least = 1 if doc_freq is None else least
    counts = None if whole is None else term_counts(whole, id_col, text_col, ngram, seeds)
    if once is not None:
        once = once.select(F.col(id_col).alias("id"), candidate_tokens(F.col(text_col)).alias("toks"))
    if doc_freq is None:
        doc_freq = _frequencies(once, counts, ngram)
    score = (F.col("tf") * _idf(n_docs, F.coalesce("df", F.lit(least)))).alias("score")
    ranked = None
    if once is not None:
        known = known_terms(doc_freq) if known is None else known
        picked = written_table(_promising(once, known, n_docs, least, top_k, ngram), "terms-picked")
        asked = picked.where("df is null and not rest").drop("df").join(doc_freq, "gram", "left")
        rows = picked.where("df is not null or rest").unionByName(asked).select("id", "gram", "rest", score)
        ranked = written_table(top_keywords(rows, top_k), "terms-ranked")
        unsettled = ranked.where("rest").select("id")
        n = unsettled.count()
        if n:
            again = term_counts(join_ids(df.withColumn("id", F.col(id_col)), unsettled, n, "left_semi"), "id", text_col, ngram)
            counts = again if counts is None else counts.unionByName(again)
            ranked = join_ids(ranked, unsettled, n, "left_anti")
        ranked = ranked.select("id", "gram", "score", "rank")
    if counts is None:
        return ranked
    looked_up = counts.join(doc_freq, "gram", "left").select("id", "gram", score)
    looked_up = top_keywords(looked_up, top_k).select("id", "gram", "score", "rank")
    return looked_up if ranked is None else ranked.unionByName(looked_up)


def tfidf_scores(df: DataFrame, id_col: str, text_col: str, ngram=(1, 2), seeds=None,
                 normalize: bool = True) -> DataFrame:
    """(id, gram, score): tf * (ln((1+N)/(1+df)) + 1), divided by the
    document's best score when ``normalize``.  The df join is skewed for
    common grams; AQE splits the hot partitions."""
    tc = term_counts(df, id_col, text_col, ngram, seeds)
    dfreq = tc.groupBy("gram").agg(F.count(F.lit(1)).alias("df"))
    n_docs = df.select(id_col).distinct().count()
    s = tc.join(dfreq, "gram").withColumn(
        "score", F.col("tf") * (F.log((F.lit(1.0 + n_docs)) / (F.lit(1.0) + F.col("df"))) + F.lit(1.0)))
    s = s.select("id", "gram", "score")
    if normalize:
        s = s.withColumn("score", F.col("score") / F.max("score").over(Window.partitionBy("id")))
    return s


_hashes: dict[str, int] = {}


def _codes(features) -> list[int]:
    """Hash of each feature (V.bucket_of, V.sign_of): 32 bits that give its place, one for its sign."""
    if len(_hashes) > KNOWN_HASHES:
        _hashes.clear()
    features = list(features)
    out = list(map(_hashes.get, features))
    if None in out:
        for k, f in enumerate(features):
            if out[k] is None:
                h = _hashes.get(f)  # it may stand twice in the list
                if h is None:
                    d = md5(f.encode("utf-8")).digest()
                    h = int.from_bytes(d[:4], "big") * 2 + d[4] % 2
                    if len(f) <= KNOWN_LETTERS and len(_hashes) <= KNOWN_HASHES:
                        _hashes[f] = h
                out[k] = h
    return out


def _places(features, dim: int):
    """(places, signs) of hashed features."""
    import numpy as np
    h = np.array(_codes(features), dtype=np.int64)
    return (h >> 1) % dim, 1.0 - 2.0 * (h & 1)


def _gram_vectors(grams: list[str], dim: int):
    """(rows, places, values) of the hashed vectors of candidates: their words and word pairs."""
    import numpy as np
    features, sizes = [], []
    for g in grams:
        words = g.split(" ")
        if len(words) == 1:
            features.append(g)
        elif len(words) == 2:
            features += words
            features.append(g)
        else:
            features += words
            features.extend(map(" ".join, zip(words, words[1:])))
        sizes.append(2 * len(words) - 1)
    at, sign = _places(features, dim)
    cell, inverse = np.unique(np.repeat(np.arange(len(grams)), sizes) * dim + at, return_inverse=True)
    return cell // dim, cell % dim, np.bincount(inverse, weights=sign, minlength=len(cell))


def _embedding_rows(once: DataFrame, id_col: str, text_col: str, ngram, dim: int) -> DataFrame:
    """(id, scores array<struct<gram, score>>) of rows whose id is theirs alone: all in the row."""
    words = F.regexp_extract_all(F.lower(F.coalesce(F.col(text_col), F.lit(""))), F.lit(V.WORD), 0)
    rows = once.select(F.col(id_col).alias("id"), words.alias("words"), candidate_tokens(F.col(text_col)).alias("toks"))

    def score(batches):
        import numpy as np
        import pyarrow as pa
        for b in batches:
            ids, lists, sizes, scores = [], [], [], []
            for i, (w, toks) in enumerate(zip(b.column(1).to_pylist(), b.column(2).to_pylist())):
                grams = {}
                for n in range(max(1, ngram[0]), ngram[1] + 1):
                    grams.update(dict.fromkeys(toks if n == 1 else map(" ".join, zip(*(toks[j:] for j in range(n))))))
                if not grams:
                    continue
                at, sign = _places(chain(w, map(" ".join, zip(w, w[1:]))), dim)
                doc = np.bincount(at, weights=sign, minlength=dim)
                norm = np.sqrt((doc * doc).sum())
                grams = list(grams)
                row, at, v = _gram_vectors(grams, dim)
                length = np.sqrt(np.bincount(row, weights=v * v, minlength=len(grams)))
                dot = np.bincount(row, weights=v * (doc[at] / (norm if norm > 0 else 1.0)), minlength=len(grams))
                keep = np.flatnonzero(length > 0)
                ids.append(i)
                sizes.append(len(keep))
                lists.extend(grams[j] for j in keep)
                scores.append(dot[keep] / length[keep])
            ends = pa.array(np.r_[0, np.cumsum(sizes)].astype(np.int32))
            flat = pa.array(np.concatenate(scores) if scores else np.zeros(0))
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(ids, pa.int64())), pa.ListArray.from_arrays(ends, pa.array(lists, pa.string())),
                                              pa.ListArray.from_arrays(ends, flat)], names=["id", "grams", "raw"])

    got = rows.mapInArrow(score, f"id {rows.schema['id'].dataType.simpleString()}, grams array<string>, raw array<double>")
    return got.select("id", F.zip_with("grams", "raw", lambda g, x: F.struct(g.alias("gram"), F.round(x, 9).alias("score"))).alias("scores"))


def embedding_scores(df: DataFrame, id_col: str, text_col: str, ngram=(1, 2), dim: int = 384,
                     seeds=None, packed: bool = False) -> DataFrame:
    """(id, gram, score): cosine between the hashed vector of each candidate and of its
    document; ``packed``: (id, scores), one row per id that has candidates.

    Rows whose id is theirs alone are scored in the row, the others by sparse joins on
    (id, bucket).  Scores are rounded to 9 dp so ranking does not depend on the
    summation order."""
    once, whole, _ = split_repeats(df, id_col) if seeds is None else (None, df, 0)
    out = None if once is None else _embedding_rows(once, id_col, text_col, ngram, dim)
    if out is not None and not packed:
        out = out.select("id", F.explode("scores").alias("s")).select("id", "s.gram", "s.score")
    if whole is None:
        return out
    long = _embedding_joined(whole, id_col, text_col, ngram, dim, seeds)
    if packed:
        long = long.groupBy("id").agg(F.collect_list(F.struct("gram", "score")).alias("scores"))
    return long if out is None else out.unionByName(long)


def _embedding_joined(df: DataFrame, id_col: str, text_col: str, ngram, dim: int, seeds) -> DataFrame:
    """``embedding_scores`` of any rows."""
    docv = V.encode_sparse(df.select(F.col(id_col).alias("id"), F.col(text_col).alias("t")), "id", "t", dim)
    cands = term_counts(df, id_col, text_col, ngram, seeds).select("id", "gram")
    feats = cands.select("id", "gram", F.explode(V.hash_features(F.col("gram"))).alias("f"))
    cv = feats.groupBy("id", "gram", V.bucket_of(F.col("f"), dim).alias("bucket")) \
        .agg(F.sum(V.sign_of(F.col("f"))).alias("cv")).filter(F.col("cv") != 0)
    cnorm = cv.groupBy("id", "gram").agg(F.sqrt(F.sum(F.col("cv") * F.col("cv"))).alias("cn"))
    dot = cv.join(docv.withColumnRenamed("value", "dv"), ["id", "bucket"]) \
        .groupBy("id", "gram").agg(F.sum(F.col("cv") * F.col("dv")).alias("dot"))
    return cands.join(cnorm, ["id", "gram"]).join(dot, ["id", "gram"], "left") \
        .select("id", "gram", F.round(F.coalesce("dot", F.lit(0.0)) / F.col("cn"), 9).alias("score"))


def top_keywords(scores: DataFrame, top_k: int = 10) -> DataFrame:
    """Best ``top_k`` grams per id (score desc, gram asc), with ``rank``; packed scores are
    cut in the row, of others WindowGroupLimit trims each map task's output before the shuffle."""
    if "scores" in scores.columns:
        best = F.slice(F.array_sort(F.transform("scores", lambda x: F.struct((-x["score"]).alias("s"), x["gram"].alias("gram")))), 1, top_k)
        return scores.select("id", F.posexplode(best).alias("p", "x")).select(
            "id", "x.gram", (-F.col("x.s")).alias("score"), (F.col("p") + 1).alias("rank"))
    w = Window.partitionBy("id").orderBy(F.desc("score"), F.asc("gram"))
    return scores.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= top_k)


def keywords(df: DataFrame, id_col: str = "pos", text_col: str = "text", top_k: int = 10, ngram=(1, 2),
             scorer: str = "tfidf", seeds: DataFrame | None = None, dim: int = 384, diversity: float | None = None) -> DataFrame:
    """Long form (id, keyword, score, rank).

    scorer: "tfidf", "embedding" or a callable; ``diversity`` (0 to 1) picks the keywords
    by maximal marginal relevance (W5) instead of by score alone."""
    if callable(scorer):
        scores = scorer(df, id_col, text_col, ngram)
    elif scorer == "tfidf" and diversity is not None:
        scores = tfidf_scores(df, id_col, text_col, ngram, seeds)
    elif scorer == "tfidf":
        # rank on the raw score (same order as the normalised one), then divide
        # the k survivors by their best
        top = best_terms(df, id_col, text_col, top_k, ngram, seeds)
        top = top.withColumn("score", F.col("score") / F.max("score").over(Window.partitionBy("id")))
        return top.select(F.col("id").alias(id_col), F.col("gram").alias("keyword"), "score", "rank")
    elif scorer == "embedding":
        scores = embedding_scores(df, id_col, text_col, ngram, dim, seeds, packed=True)
    else:
        raise ValueError(f"unknown scorer {scorer!r}")
    top = top_keywords(scores, top_k) if diversity is None else mmr(scores, top_k, diversity, dim)
    return top.select(F.col("id").alias(id_col), F.col("gram").alias("keyword"), "score", "rank")


def keyword_arrays(long_kw: DataFrame, df: DataFrame, id_col: str = "pos", out_col: str = "keywords") -> DataFrame:
    """Attach ``keywords ARRAY<STRUCT<keyword, score>>`` (score desc); rows
    without keywords get an empty array.  Arrays are bounded by top_k."""
    arr = (long_kw.groupBy(id_col)
           .agg(F.array_sort(F.collect_list(F.struct("rank", "keyword", "score"))).alias("_k"))
           .select(id_col, F.transform("_k", lambda x: F.struct(x["keyword"].alias("keyword"),
                                                                x["score"].alias("score"))).alias(out_col)))
    empty = F.array().cast("array<struct<keyword:string,score:double>>")
    return df.join(arr, id_col, "left").withColumn(out_col, F.coalesce(F.col(out_col), empty))


def refine_keywords(kws, min_score: float = 0.2):
    """W6 on an ARRAY<STRUCT<keyword, score>>: score desc; drop < min_score;
    lower-case and collapse repeated adjacent words; skip phrases whose
    tokens are all already covered; scores rounded to 4 dp."""
    ordered = F.array_sort(F.filter(kws, lambda k: k["score"] >= min_score),
                           lambda a, b: F.when(a["score"] > b["score"], -1).when(a["score"] < b["score"], 1)
                           .otherwise(0))
    init = F.struct(F.array().cast("array<string>").alias("seen"),
                    F.array().cast("array<struct<keyword:string,score:double>>").alias("out"))

    def step(acc, k):
        norm = F.regexp_replace(F.lower(k["keyword"]), r"(?U)\b(\w+)( \1\b)+", "$1")
        toks = F.array_distinct(F.filter(F.split(norm, r"(?U)\s+"), lambda t: t != ""))
        covered = F.size(F.array_except(toks, acc["seen"])) == 0
        item = F.struct(norm.alias("keyword"), F.round(k["score"], 4).alias("score"))
        return F.when(covered, acc).otherwise(F.struct(
            F.array_union(acc["seen"], toks).alias("seen"),
            F.array_append(F.filter(acc["out"], lambda o: o["keyword"] != norm), item).alias("out")))
    return F.aggregate(ordered, init, step)["out"]


def mmr(scores: DataFrame, top_k: int = 10, diversity: float = 0.5, dim: int = 384) -> DataFrame:
    """Maximal marginal relevance over each document's candidates.

    One group per document (bounded by its text): a row of packed scores, else
    ``applyInPandas`` gathers the document's rows.  A group keeps the k chosen vectors
    and updates every candidate's best similarity to them: O(candidates x k), all
    candidates considered.
    """
    import numpy as np

    def choose(grams, rel):
        """(gram, score) of the chosen ones, in order."""
        order = sorted(zip((-np.asarray(rel, dtype=float)).tolist(), grams))
        grams, rel = [g for _, g in order], -np.array([x for x, _ in order])
        n = len(grams)
        row, at, v = _gram_vectors(grams, dim)
        norm = np.sqrt(np.bincount(row, weights=v * v, minlength=n))
        v = v / np.where(norm > 0, norm, 1.0)[row]
        first = np.searchsorted(row, np.arange(n + 1))

        def near(j):
            """Similarity of every candidate to candidate j; a vector has a few entries."""
            one = np.zeros(dim)
            one[at[first[j]:first[j + 1]]] = v[first[j]:first[j + 1]]
            return np.bincount(row, weights=v * one[at], minlength=n)

        chosen, best_sim = [0], near(0)
        alive = np.ones(n, dtype=bool)
        alive[0] = False
        while len(chosen) < min(top_k, n):
            val = (1 - diversity) * rel - diversity * best_sim
            val[~alive] = -np.inf
            j = int(np.argmax(val))
            chosen.append(j)
            alive[j] = False
            best_sim = np.maximum(best_sim, near(j))
        return [(grams[j], float(rel[j])) for j in chosen]

    if "scores" in scores.columns:
        def pick_rows(batches):
            import pyarrow as pa
            for b in batches:
                at, grams, rel, rank = [], [], [], []
                s = b.column(1)
                flat, ends = s.flatten(), s.offsets.to_numpy()
                names, values = flat.field("gram"), flat.field("score").to_numpy(zero_copy_only=False)
                for i, (lo, hi) in enumerate(zip(ends - ends[0], ends[1:] - ends[0])):
                    if hi > lo:
                        for k, (g, x) in enumerate(choose(names.slice(lo, hi - lo).to_pylist(), values[lo:hi])):
                            at.append(i), grams.append(g), rel.append(x), rank.append(k + 1)
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at, pa.int64())), pa.array(grams, pa.string()), pa.array(rel, pa.float64()),
                                                  pa.array(rank, pa.int32())], names=["id", "gram", "score", "rank"])
        return scores.select(F.col("id").cast("long").alias("id"), "scores").mapInArrow(
            pick_rows, "id long, gram string, score double, rank int")

    def pick(pdf):
        import pandas as pd
        got = choose(pdf["gram"].tolist(), pdf["score"].tolist())
        return pd.DataFrame({"id": [pdf["id"].iloc[0]] * len(got), "gram": [g for g, _ in got],
                             "score": [x for _, x in got], "rank": list(range(1, len(got) + 1))})
    return scores.select("id", "gram", "score").groupBy("id").applyInPandas(pick, "id long, gram string, score double, rank int")


def ctfidf_scores(df: DataFrame, class_col: str, text_col: str, ngram=(1, 2)) -> DataFrame:
    """(cls, gram, score) of every term: tf(t,c)/|c| * ln(1 + A / f(t)), A = mean number
    of candidate terms per class, f(t) = frequency of t over all classes."""
    tc = term_counts(df, class_col, text_col, ngram).withColumnRenamed("id", "cls")
    # one row per class: the mean class size is a window over this tiny table
    size = tc.groupBy("cls").agg(F.sum("tf").alias("n_c")) \
        .withColumn("a", F.avg("n_c").over(Window.partitionBy()))
    freq = tc.groupBy("gram").agg(F.sum("tf").alias("f_t"))
    return tc.join(size, "cls").join(freq, "gram").select("cls", "gram", (
        F.col("tf") / F.col("n_c") * F.log(F.lit(1.0) + F.col("a") / F.col("f_t"))).alias("score"))


def ctfidf(df: DataFrame, class_col: str, text_col: str, top_n: int = 10, ngram=(1, 2)) -> DataFrame:
    """Class-based TF-IDF.  Returns (class, word, score, rank) for the top ``top_n``."""
    s = ctfidf_scores(df, class_col, text_col, ngram)
    w = Window.partitionBy("cls").orderBy(F.desc("score"), F.asc("gram"))
    top = s.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= top_n)
    return top.select(F.col("cls").alias(class_col), F.col("gram").alias("word"), "score", "rank")
