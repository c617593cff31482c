"""Text-level scalar expressions: entry content, similarity, normalisation,
tokens.  Everything is a native Spark expression except NFKD folding, which
has no JVM built-in and runs as an Arrow-batched pandas UDF."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from linkloom.functions.patterns import let
from linkloom.functions.stopwords import ENGLISH_STOPWORDS


def strip(c: Column) -> Column:
    """Python ``str.strip()``."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def entry_content(df) -> Column:
    """First non-null of clean_text, cleaned, text, content, scraped; else ''."""
    names = [n for n in ("clean_text", "cleaned", "text", "content", "scraped") if n in df.columns]
    return F.coalesce(*[F.col(n) for n in names], F.lit(""))


def content_head(c: Column, n: int | None = 100) -> Column:
    """P10 (second half): first ``n`` whitespace tokens (None: all of them)."""
    toks = F.filter(F.split(strip(c), r"\s+"), lambda t: t != "")
    return F.array_join(toks if n is None else F.slice(toks, 1, n), " ")


def meta_text(title: Column, domain: Column, keywords_text: Column) -> Column:
    """P10: ``title [SEP] domain [SEP] keywords``; nulls read as ''."""
    e = F.lit("")
    return F.concat(F.coalesce(title, e), F.lit(" [SEP] "), F.coalesce(domain, e), F.lit(" [SEP] "),
                    F.coalesce(keywords_text, e))


def keywords_text(kws: Column) -> Column:
    """Keywords sorted alphabetically, space-joined."""
    return F.array_join(F.array_sort(F.transform(kws, lambda k: k["keyword"])), " ")


def raw_keywords(kws: Column) -> Column:
    """JSON object keyword -> score."""
    return F.to_json(F.map_from_entries(F.transform(kws, lambda k: F.struct(k["keyword"], k["score"]))))


def is_html(text: Column) -> Column:
    """Stripped text starts with <html, <!DOCTYPE or <doc (case-sensitive)."""
    s = strip(text)
    return s.startswith("<html") | s.startswith("<!DOCTYPE") | s.startswith("<doc")


def title_plus_text(base_title: Column, text: Column) -> Column:
    """strip(base_title + ' ' + text)."""
    return strip(F.concat(F.coalesce(base_title, F.lit("")), F.lit(" "), F.coalesce(text, F.lit(""))))


# Phrases of browser challenge / anti-bot interstitial pages.
BROWSER_CHALLENGE_PHRASES = [
    "just a moment",
    "checking your browser",
    "verify you are a human",
    "please wait while we verify",
    "access to this page has been denied",
    "challenge verification",
    "ddos protection",
]


def is_challenge_page(html: Column) -> Column:
    """A challenge phrase within the first 1000 characters (lower-cased)."""
    head = F.lower(F.substring(html, 1, 1000))
    return F.coalesce(F.exists(F.array(*[F.lit(p) for p in BROWSER_CHALLENGE_PHRASES]),
                               lambda p: F.instr(head, p) > 0), F.lit(False))


def java_trim(c: Column) -> Column:
    """``String.trim()``: drop leading/trailing chars <= U+0020."""
    return F.regexp_replace(c, r"^[\x00-\x20]+|[\x00-\x20]+$", "")


def text_similarity(a: Column, b: Column) -> Column:
    """0-100 similarity of the first min(50, len a, len b) characters.

    ``100 - int(levenshtein / max(len) * 100)``; 0 when either side is
    null/empty (then never similar).
    """
    n = F.least(F.lit(50), F.length(a), F.length(b))
    sa = java_trim(F.substring(a, 1, n))
    sb = java_trim(F.substring(b, 1, n))
    mx = F.greatest(F.length(sa), F.length(sb))
    sim = F.lit(100) - F.floor(F.levenshtein(sa, sb) / mx * 100).cast("int")
    empty = a.isNull() | b.isNull() | (F.length(a) == 0) | (F.length(b) == 0)
    return F.when(empty, F.lit(0)).when(mx == 0, F.lit(100)).otherwise(sim)


def is_similar(a: Column, b: Column, threshold: int = 70) -> Column:
    empty = a.isNull() | b.isNull() | (F.length(a) == 0) | (F.length(b) == 0)
    return ~empty & (text_similarity(a, b) >= threshold)


def space_code(c: Column) -> Column:
    """H3: four ordered regexes that keep code statements apart."""
    c = F.regexp_replace(c, r"(?U)(import\s+\w+)", "$1 ")
    c = F.regexp_replace(c, r"([;{}()])", "$1 ")
    c = F.regexp_replace(c, r"(?iU)(\w)(if|for|while|def|class|return|import|from)", "$1 $2")
    return F.regexp_replace(c, r"(?U)\s{2,}", " ")


@F.pandas_udf(StringType())
def _nfkd_ascii(s: pd.Series) -> pd.Series:
    def fold(x):
        if x is None or x.isascii():
            return x
        return unicodedata.normalize("NFKD", x).encode("ascii", "ignore").decode("ascii")
    return s.map(fold)


def to_ascii(c: Column) -> Column:
    """H6: NFKD then drop non-ASCII (Arrow pandas UDF; ASCII rows pass untouched)."""
    return _nfkd_ascii(c)


def normalize_text(c: Column, fold_ascii: bool = True) -> Column:
    """ASCII folding, paragraph breaks, punctuation padding, camelCase split,
    horizontal whitespace collapse, strip."""
    if fold_ascii:
        c = to_ascii(c)
    c = F.regexp_replace(c, r"(?U)(\n\s*\n)", "\n\n")
    c = F.regexp_replace(c, r"([;:,.!?()])", " $1 ")
    c = F.regexp_replace(c, r"([a-z])([A-Z])", "$1 $2")
    c = F.regexp_replace(c, r"[ \t]+", " ")
    c = F.regexp_replace(c, r" {2,}", " ")
    return strip(c)


def tokenize(c: Column) -> Column:
    """Whitespace tokens (punctuation is already padded by T10)."""
    return F.filter(F.split(c, r"(?U)\s+"), lambda t: t != "")


def stopword_array() -> Column:
    return F.array(*[F.lit(w) for w in ENGLISH_STOPWORDS])


def is_stopword(t: Column) -> Column:
    """Hashed set membership (``IN`` with many literals is planned as InSet)."""
    return t.isin(*ENGLISH_STOPWORDS)


def valid_tokens(arr: Column) -> Column:
    """Length > 1, not all digits, not a stopword (case-insensitive)."""
    return F.filter(arr, lambda t: (F.length(t) > 1) & ~t.rlike(r"^(?U)\d+$") & ~is_stopword(F.lower(t)))


def non_stopwords(arr: Column) -> Column:
    return F.filter(arr, lambda t: ~is_stopword(F.lower(t)))


def limit_tokens(arr: Column, max_tokens: int | None, min_words: int = 3) -> Column:
    """First ``max_tokens`` tokens (None: all), '' when fewer than ``min_words`` remain."""
    def joined(toks: Column) -> Column:
        kept = toks if max_tokens is None else F.slice(toks, 1, max_tokens)
        return F.when(F.size(toks) < min_words, F.lit("")).otherwise(F.array_join(kept, " "))
    return let(arr, joined)  # the tokens are the whole cleaning: computed once


def overcleaned(before: Column, after: Column, threshold: float = 0.05) -> Column:
    """Cleaning kept less than 5 % of the characters; an empty text has none to lose."""
    return F.when(F.length(before) == 0, F.lit(False)).otherwise(F.length(after) / F.length(before) < threshold)


def mostly_stopwords(c: Column) -> Column:
    """Fewer than 10 % of the words are not stopwords (empty -> False)."""
    words = F.filter(F.split(F.regexp_replace(F.lower(c), r"(?U)[^\p{L}\p{N}_\s]", ""), r"(?U)\s+"),
                     lambda t: t != "")
    return F.size(non_stopwords(words)) < F.lit(0.1) * F.size(words)
