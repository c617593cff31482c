"""Text cleaning (T9-T18): pattern groups, normalisation, tokens, budgets.

All steps are native column expressions evaluated in one projection; the
only Python is NFKD folding (Arrow pandas UDF, skipped for ASCII rows).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linkloom.functions import patterns as PT
from linkloom.functions import text as T


CONTENT_TAGS = ("NN", "JJ", "VB", "RB")


def content_words(tokens: Column, tagger=None) -> Column:
    """Keep valid tokens tagged noun/adjective/verb/adverb.

    ``tagger`` is a user-supplied vectorised function ``array<string> ->
    array<string>`` of tags (e.g. an Arrow pandas UDF around any tagger);
    without one, the valid-token filter (T12) is used, as the original does
    when no tagger can be loaded.
    """
    if tagger is None:
        return T.valid_tokens(tokens)
    tags = tagger(tokens)
    pairs = F.arrays_zip(tokens.alias("t"), tags.alias("g"))
    kept = F.filter(pairs, lambda p: F.substring(p["g"], 1, 2).isin(*CONTENT_TAGS))
    return T.valid_tokens(F.transform(kept, lambda p: p["t"]))


def clean_column(c: Column, max_tokens: int | None = None, sequence=None, extra_patterns=None,
                 tagger=None, min_words: int = 3, fold_ascii: bool = True, folded: Column | None = None) -> Column:
    """Cleaning filter for one text column: T9 -> T10 -> T11 -> T12/T13 -> T14.

    folded: a column that holds ``patterns.caseless(c)``, see ``patterns.apply_patterns``."""
    groups = PT.resolve_sequence(sequence, extra_patterns)
    text = PT.apply_patterns(c, groups, folded)
    # the sequence patterns leave ASCII only, so there is nothing to fold after them
    text = T.normalize_text(text, fold_ascii=fold_ascii and not PT.leaves_ascii(sequence))
    toks = content_words(T.tokenize(text), tagger)
    out = T.limit_tokens(toks, max_tokens, min_words)
    return F.when(c.isNull() | (c == ""), F.lit("")).otherwise(out)


def basic_clean(c: Column, max_tokens: int | None = 200, sequence=None, min_words: int = 3) -> Column:
    """Patterns -> whitespace tokens -> stopword drop -> budget (no normalisation)."""
    text = PT.apply_patterns(c, PT.resolve_sequence(sequence))
    toks = T.non_stopwords(T.tokenize(text))
    out = T.limit_tokens(toks, max_tokens, min_words)
    return F.when(c.isNull() | (c == ""), F.lit("")).otherwise(out)


def main_content_of(html: Column) -> Column:
    """Main content (H2) of HTML texts, as a column (Arrow batches)."""
    from linkloom.operators.html import main_content_udf
    return main_content_udf(html)


def clean_entries(df: DataFrame, boilerplate: DataFrame | None = None, max_tokens: int | None = None,
                  sequence=None, tagger=None, html_extractor=main_content_of, restore_if_emptied: bool = False,
                  text_col: str = "scraped") -> DataFrame:
    """Per entry ``scraped`` -> ``clean_text`` (+ ``overcleaned`` flag).

    null/empty -> ''; HTML (P12) -> main content first (``html_extractor``:
    column -> column, H2 by default, None to clean markup as text); cleaning filter; stop when empty or over-cleaned (T16);
    else domain boilerplate removal (J4).  ``restore_if_emptied`` (T18) keeps
    the pre-filter text when boilerplate removal empties it.
    """
    from linkloom.operators.boilerplate import remove_boilerplate
    raw = F.col(text_col)
    df = df.withColumn("_raw", F.coalesce(raw, F.lit("")))
    if html_extractor is not None:
        # only HTML rows carry a text into the extractor
        markup = html_extractor(F.when(T.is_html(F.col("_raw")), F.col("_raw")))
        df = df.withColumn("_raw", F.when(T.is_html(F.col("_raw")), F.coalesce(markup, F.lit(""))).otherwise(F.col("_raw")))
    df = df.withColumn("_folded", PT.caseless(F.col("_raw")))
    cleaned = clean_column(F.col("_raw"), max_tokens=max_tokens, sequence=sequence, tagger=tagger, folded=F.col("_folded"))
    df = df.withColumn("clean_text", cleaned).drop("_folded")
    df = df.withColumn("overcleaned", (F.length("_raw") > 0) & (F.col("clean_text") != "")
                       & T.overcleaned(F.col("_raw"), F.col("clean_text")))
    if boilerplate is not None:
        eligible = (F.col("clean_text") != "") & ~F.col("overcleaned")
        df = df.withColumn("_before", F.col("clean_text"))
        df = remove_boilerplate(df, boilerplate, text_col="clean_text", when=eligible)
        if restore_if_emptied:
            df = df.withColumn("clean_text", F.when(F.col("clean_text") == "", F.col("_before"))
                               .otherwise(F.col("clean_text")))
        df = df.drop("_before")
    return df.drop("_raw", text_col)
