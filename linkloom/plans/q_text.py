"""Queries for the cleaning steps T1-T19 over ``documents``."""

from __future__ import annotations

from pyspark.sql import functions as F

from linkloom.functions import patterns as PT
from linkloom.functions import text as T
from linkloom.functions.stopwords import sql_list
from linkloom.operators import clean as C
from linkloom.plans.registry import register
from linkloom.sources.tables import load

STOP = sql_list()
_GROUPS = [
    ("t1_default_ignore", "DEFAULT_IGNORE_PATTERNS"), ("t2_code", "CODE_PATTERNS"),
    ("t3_latex", "LATEX_PATTERNS"), ("t4_citation", "CITATION_PATTERNS"), ("t5_metadata", "METADATA_PATTERNS"),
    ("t6_navigation", "NAVIGATION_PATTERNS"), ("t7_sequence", "SEQUENCE_PATTERNS"),
    ("t8_formatting", "FORMATTING_PATTERNS"),
]


def _group_query(group):
    def q(spark, sf):
        d = load(spark, sf, "documents")
        return d.select("doc_id", PT.apply_patterns(F.col("text"), PT.REGISTRY[group]).alias("cleaned"))
    return q


for _name, _group in _GROUPS:
    register(_name, f"SELECT doc_id, {PT.sql_apply_patterns('text', PT.REGISTRY[_group])} AS cleaned FROM documents")(
        _group_query(_group))


_ALL = PT.resolve_sequence(None)


@register("t9_apply_filters", f"SELECT doc_id, {PT.sql_apply_patterns('text', _ALL)} AS cleaned FROM documents")
def t9_apply_filters(spark, sf):
    d = load(spark, sf, "documents")
    return PT.apply_filters(d, "text", None, out_col="cleaned").select("doc_id", "cleaned")


# --- SQL pieces mirroring linkloom.functions.text -----------------------------
def sql_strip(e):
    return f"regexp_replace({e}, '^\\s+|\\s+$', '', 'g')"


def sql_normalize(e):
    e = f"regexp_replace({e}, '(\\n\\s*\\n)', chr(10) || chr(10), 'g')"
    e = f"regexp_replace({e}, '([;:,.!?()])', ' \\1 ', 'g')"
    e = f"regexp_replace({e}, '([a-z])([A-Z])', '\\1 \\2', 'g')"
    e = f"regexp_replace({e}, '[ \\t]+', ' ', 'g')"
    e = f"regexp_replace({e}, ' {{2,}}', ' ', 'g')"
    return sql_strip(e)


def sql_tokens(e):
    return f"list_filter(string_split_regex({e}, '\\s+'), lambda t: t <> '')"


def sql_valid(e):
    return (f"list_filter({e}, lambda t: length(t) > 1 AND NOT regexp_full_match(t, '[0-9]+') "
            f"AND NOT list_contains({STOP}, lower(t)))")


def sql_limit(e, n, min_words=3):
    kept = e if n is None else f"{e}[1:{n}]"
    return f"CASE WHEN len({e}) < {min_words} THEN '' ELSE array_to_string({kept}, ' ') END"


def sql_clean(e, n=None):
    return sql_limit(sql_valid(sql_tokens(sql_normalize(PT.sql_apply_patterns(e, _ALL)))), n)


_SEQ = PT.SEQUENCE_PATTERNS


@register("t10_normalize_text",
          f"SELECT doc_id, {sql_normalize(PT.sql_apply_patterns('text', _SEQ))} AS normalized FROM documents")
def t10_normalize_text(spark, sf):
    # the default order removes non-ASCII runs (SEQUENCE group) before normalising
    d = load(spark, sf, "documents")
    return d.select("doc_id", T.normalize_text(PT.apply_patterns(F.col("text"), _SEQ)).alias("normalized"))


@register("t11_t12_valid_tokens", f"""SELECT doc_id, len(tok) AS n_tokens, len(val) AS n_valid,
  array_to_string(val, ' ') AS valid FROM (SELECT doc_id, {sql_tokens(sql_normalize(PT.sql_apply_patterns('text', _SEQ)))} AS tok,
  {sql_valid(sql_tokens(sql_normalize(PT.sql_apply_patterns('text', _SEQ))))} AS val FROM documents)""")
def t11_t12_valid_tokens(spark, sf):
    d = load(spark, sf, "documents")
    tok = T.tokenize(T.normalize_text(PT.apply_patterns(F.col("text"), _SEQ)))
    t = d.select("doc_id", tok.alias("tok"))
    return t.select("doc_id", F.size("tok").alias("n_tokens"), F.size(T.valid_tokens(F.col("tok"))).alias("n_valid"),
                    F.array_join(T.valid_tokens(F.col("tok")), " ").alias("valid"))


@register("t14_limit_tokens", f"""SELECT doc_id, {sql_limit(sql_tokens('text'), 50, 3)} AS limited FROM documents""")
def t14_limit_tokens(spark, sf):
    d = load(spark, sf, "documents")
    return d.select("doc_id", T.limit_tokens(T.tokenize(F.col("text")), 50, 3).alias("limited"))


def _sql_basic(e, n=200):
    toks = f"list_filter({sql_tokens(PT.sql_apply_patterns(e, _ALL))}, lambda t: NOT list_contains({STOP}, lower(t)))"
    return f"CASE WHEN {e} IS NULL OR {e} = '' THEN '' ELSE {sql_limit(toks, n)} END"


@register("t15_basic_clean", f"SELECT doc_id, {_sql_basic('text')} AS cleaned FROM documents")
def t15_basic_clean(spark, sf):
    d = load(spark, sf, "documents")
    return d.select("doc_id", C.basic_clean(F.col("text"), 200).alias("cleaned"))


def _t16(budget: str, tokens: int | None):
    sql = f"""SELECT doc_id, CAST(length(c) AS DOUBLE) / length(text) < 0.05 AS overcleaned, length(c) AS n_clean
FROM (SELECT doc_id, text, {sql_clean('text', tokens) if tokens else sql_clean('text')} AS c FROM documents)"""

    @register(f"t16_overcleaned{budget}", sql)
    def t16(spark, sf):
        d = load(spark, sf, "documents").select("doc_id", "text", PT.caseless(F.col("text")).alias("folded"))
        c = d.select("doc_id", "text", C.clean_column(F.col("text"), tokens, folded=F.col("folded")).alias("c"))
        return c.select("doc_id", T.overcleaned(F.col("text"), F.col("c")).alias("overcleaned"),
                        F.length("c").alias("n_clean"))


_t16("", None)             # the whole cleaned text, as flagship and organise clean it
_t16("_whole", None)
_t16("_limited", 400)      # a token budget (T14): long documents fall under the ratio for their length alone


def sql_mostly_stopwords(e):
    words = (f"list_filter(string_split_regex(regexp_replace(lower({e}), '[^\\p{{L}}\\p{{N}}_\\s]', '', 'g'), '\\s+'), "
             "lambda t: t <> '')")
    return f"(len(list_filter({words}, lambda w: NOT list_contains({STOP}, w))) < 0.1 * len({words}))"


_T19_SQL = f"""SELECT doc_id, line_no, {sql_mostly_stopwords('line')} AS mostly_stopwords FROM (
  SELECT doc_id, generate_subscripts(string_split(text, chr(10)), 1) AS line_no, unnest(string_split(text, chr(10))) AS line
  FROM documents)"""


@register("t19_mostly_stopwords", _T19_SQL)
def t19_mostly_stopwords(spark, sf):
    d = load(spark, sf, "documents")
    lines = d.select("doc_id", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    return lines.select("doc_id", (F.col("line_no") + 1).alias("line_no"),
                        T.mostly_stopwords(F.col("line")).alias("mostly_stopwords"))


@register("t13_content_words", f"""SELECT doc_id, array_to_string({sql_valid(sql_tokens(sql_normalize(PT.sql_apply_patterns('text', _SEQ))))}, ' ')
  AS content_words FROM documents""")
def t13_content_words(spark, sf):
    # no tagger supplied -> the original's own fallback: valid tokens
    from linkloom.operators.clean import content_words
    d = load(spark, sf, "documents")
    toks = T.tokenize(T.normalize_text(PT.apply_patterns(F.col("text"), _SEQ)))
    return d.select("doc_id", F.array_join(content_words(toks, None), " ").alias("content_words"))
