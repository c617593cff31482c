"""License scan (DataFrame functions only): ordered signature rules.

A text becomes words (A-Z lower-cased, split at ASCII non-alphanumerics).  One
regex over the raw text finds texts with any rule keyword; only those are
normalised.  Of the rules, those of which the text holds a keyword run their regex
over the whole normalised text; matches become word intervals.  An interval
contained in one of higher priority, or in a longer or earlier one of the same
priority, is suppressed.  All of it is one projection of the scan: no shuffle,
no hot key, memory bounded by one text and its matches.

Defined results: null text counts as empty; a text without words has n_words 0,
no detections and score 0; repeated rows give repeated results; extra columns
are ignored; null doc_id is kept.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkloom.llm.common import ascii_lower
from linkloom.llm.license_rules import keywords as keywords_of
from linkloom.llm.license_rules import rules as signature_rules

#: characters between words, once A-Z are lower case / in raw text
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]"
RAW_WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: confidence of a kept detection by priority
CONFIDENCE = {1: 0.3, 2: 0.6, 3: 0.8, 4: 0.95, 5: 1.0}


def pattern(rx: str) -> str:
    """Rule regex on normalised text, where every word has a space of its own on both sides."""
    return " " + rx.replace(" ?", "\0").replace(" ", "  ").replace("\0", "(?:  )?") + " "


def gate(keywords) -> str:
    """One regex for 'some word starts with a keyword', branching on the first letter once."""
    by_first: dict[str, list[str]] = {}
    for k in sorted(set(keywords)):
        by_first.setdefault(k[0], []).append(k[1:])
    return (r"(?i)(?<![^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F])(?:"
            + "|".join(f"{a}(?:{'|'.join(rest)})" for a, rest in by_first.items()) + ")")


def _rule_array(rules):
    return F.array(*[F.struct(F.lit(r[0]).alias("label"), F.array(*map(F.lit, keywords_of(r))).alias("kws"),
                              F.lit(pattern(r[2])).alias("rx"), F.lit(r[3]).alias("p"), F.lit(i).alias("o"))
                     for i, r in enumerate(rules)])


_WORDS = "cast((length({0}) - length(replace({0}, ' ', ''))) div 2 as int)"


def spans(text: str, rules: str) -> str:
    """SQL: matches of an array of rules in a normalised text, as word intervals [s, e)."""
    step = f"a.n + {_WORDS.format('x.gap')}"
    item = (f"named_struct('s', {step}, 'e', {step} + {_WORDS.format('x.hit')}, 'p', r.p, 'o', r.o, 'label', r.label)")
    return f"""flatten(transform({rules}, r -> aggregate(
        zip_with(split({text}, r.rx), regexp_extract_all({text}, r.rx, 0), (gap, hit) -> named_struct('gap', gap, 'hit', hit)),
        named_struct('n', 0, 'out', cast(array() as array<struct<s:int,e:int,p:int,o:int,label:string>>)),
        (a, x) -> if(x.hit is null, a, named_struct('n', {step} + {_WORDS.format('x.hit')}, 'out', concat(a.out, array({item})))),
        a -> a.out)))"""


#: sweep by (start, -end, -priority, order): kept unless an earlier interval of the
#: same or a higher priority reaches at least as far
_KEEP = """aggregate(array_sort({d}, (a, b) -> case when a.s <> b.s then a.s - b.s when a.e <> b.e then b.e - a.e
                       when a.p <> b.p then b.p - a.p else a.o - b.o end),
    named_struct('m1', 0, 'm2', 0, 'm3', 0, 'm4', 0, 'm5', 0, 'out', cast(array() as array<struct<s:int,e:int,p:int,o:int,label:string>>)),
    (a, x) -> named_struct('m1', greatest(a.m1, x.e), 'm2', if(x.p >= 2, greatest(a.m2, x.e), a.m2),
        'm3', if(x.p >= 3, greatest(a.m3, x.e), a.m3), 'm4', if(x.p >= 4, greatest(a.m4, x.e), a.m4),
        'm5', if(x.p >= 5, greatest(a.m5, x.e), a.m5),
        'out', if(x.e > case x.p when 1 then a.m1 when 2 then a.m2 when 3 then a.m3 when 4 then a.m4 else a.m5 end,
                  concat(a.out, array(x)), a.out)),
    a -> a.out)"""


def scan_licenses(docs: DataFrame, base_phrases: dict[str, str], rules=None, id_col: str = "doc_id",
                  text_col: str = "text") -> DataFrame:
    """id, n_words, base (array of word intervals of the base phrases), detections
    (kept rule intervals: s, e, p, o, label) of every row.

    base_phrases: {phrase: label}; a base phrase is never suppressed."""
    rules = signature_rules() if rules is None else rules
    base = [(label, phrase.split(" ")[0], phrase, 2) for phrase, label in base_phrases.items()]
    keywords = sorted({k for r in [*rules, *base] for k in keywords_of(r)})
    x = docs.select(F.col(id_col).alias("id"), F.coalesce(text_col, F.lit("")).alias("t"))
    x = x.select("id", F.regexp_count("t", F.lit(RAW_WORD)).cast("long").alias("n_words"),
                 F.when(F.col("t").rlike(gate(keywords)),
                        F.concat(F.lit(" "), F.regexp_replace(F.regexp_replace(
                            ascii_lower(F.col("t")), f"^{SEPARATORS}+|{SEPARATORS}+$", ""), f"{SEPARATORS}+", "  "),
                            F.lit(" "))).alias("norm"))
    x = x.withColumns({"rules": F.when(F.col("norm").isNotNull(), _rule_array(rules)),
                       "base_rules": F.when(F.col("norm").isNotNull(), _rule_array(base)),
                       "kws": F.when(F.col("norm").isNotNull(), F.expr(
                           "filter(array(%s), k -> contains(norm, concat(' ', k)))" % ", ".join(f"'{k}'" for k in keywords)))})
    x = x.withColumn("found", F.expr(spans("norm", "filter(rules, r -> arrays_overlap(kws, r.kws))")))
    x = x.select("id", "n_words", F.expr(spans("norm", "filter(base_rules, r -> arrays_overlap(kws, r.kws))")).alias("base"),
                 F.expr(_KEEP.format(d="found")).alias("detections"))
    none = F.array().cast("array<struct<s:int,e:int,p:int,o:int,label:string>>")
    return x.select("id", "n_words", F.coalesce("base", none).alias("base"),
                    F.coalesce("detections", none).alias("detections"))
