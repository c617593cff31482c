"""URL, date and entry-level scalar expressions (all JVM-side built-ins)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# netloc as Python's urlsplit reports it: text after "scheme://" (or a bare
# "//") up to the first "/", "?" or "#"; user-info and port kept, case kept.
_AUTHORITY_RE = r"^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?//([^/?#]*)"


def url_domain(url: Column) -> Column:
    """Authority part of a URL, '' when there is none."""
    return F.coalesce(F.regexp_extract(url, _AUTHORITY_RE, 1), F.lit(""))


# fixed value: date line of the export format
_ONETAB_DATE_RE = r"^Created \d{1,2}/\d{1,2}/\d{4}, \d{1,2}:\d{2}:\d{2} [AP]M$"


def onetab_date(text: Column) -> Column:
    """P2: 'Created 3/9/2024, 1:02:03 PM' -> TIMESTAMP_NTZ, null when malformed."""
    parsed = F.try_to_timestamp(F.substring(text, 9, 64), F.lit("M/d/yyyy, h:mm:ss a"))
    return F.when(text.rlike(_ONETAB_DATE_RE), parsed.cast("timestamp_ntz"))


def epoch_seconds(ts: Column) -> Column:
    """All-digit POSIX seconds -> UTC wall clock as TIMESTAMP_NTZ, else null.

    NTZ arithmetic keeps the result independent of the session time zone.
    """
    # digits of any length: leading zeros count for nothing; stamps after the year 9999 are no dates
    secs = F.when(ts.rlike(r"^[0-9]+$"), ts.try_cast("bigint"))
    secs = F.when(secs <= 253402300799, secs)
    return F.timestamp_add("SECOND", secs, F.expr("TIMESTAMP_NTZ'1970-01-01 00:00:00'"))


def epoch_date(add_date: Column, last_modified: Column) -> Column:
    """ADD_DATE when it parses, else LAST_MODIFIED, else null."""
    return F.coalesce(epoch_seconds(add_date), epoch_seconds(last_modified))


def is_local_url(url: Column) -> Column:
    """P4 predicate."""
    return url.startswith("chrome-extension://") | url.contains("file:///")


def drop_local_urls(df, url_col: str = "url"):
    """Keep only web URLs."""
    return df.filter(~is_local_url(F.col(url_col)))


def path_depth(url: Column) -> Column:
    """P5: number of '/' in the whole URL (scheme slashes included)."""
    return F.regexp_count(url, F.lit("/")).cast("int")


def is_subdomain(domain: Column) -> Column:
    """1 when the domain has more than one dot."""
    return (F.regexp_count(domain, F.lit(r"[.]")) > 1).cast("int")


def days_since_epoch(date: Column) -> Column:
    """P7."""
    return F.unix_date(F.to_date(date))


def base_title(title: Column, domain: Column) -> Column:
    """Remove the longest dot-part of the domain (last among equals) from the title.

    ``array_max`` over (length, index, part) picks the longest part and, among
    parts of equal length, the last one - what a stable ascending sort by
    length followed by ``[-1]`` returns.
    """
    parts = F.split(F.lower(domain), r"\.")
    best = F.array_max(F.transform(parts, lambda p, i: F.struct(F.length(p).alias("n"), i.alias("i"), p.alias("p"))))
    pattern = F.concat(F.lit(r"(?iU)\b\Q"), best["p"], F.lit(r"\E\b"))
    stripped = F.regexp_replace(title, pattern, F.lit(""))
    cleaned = F.regexp_replace(stripped, r"(?U)^\s+|\s+$", "")
    plain = F.regexp_replace(F.coalesce(title, F.lit("")), r"(?U)^\s+|\s+$", "")
    return F.when(F.coalesce(domain, F.lit("")) == "", plain).otherwise(cleaned)


# Folder names that carry no meaning as labels (plural forms and
# pairs of them are ignored too).
IGNORED_FOLDER_WORDS = ["bookmark", "folder", "stuff", "link", "site", "website", "bar",
                        "toolbar", "page", "menu", "list", "untitled", "other"]


def _ignored_words_regex(flags: str = "(?iU)") -> str:
    words = "|".join(IGNORED_FOLDER_WORDS)
    w = f"(?:{words})s?"
    return flags + rf"\b(?:{w}(?: {w})?)\b"


def folder_label(path: Column, max_depth: int = 4) -> Column:
    """Last of the first ``max_depth`` path parts, lower-cased, ignored words removed."""
    last = F.element_at(F.slice(F.split(path, "/"), 1, max_depth), -1)
    low = F.lower(F.regexp_replace(last, r"(?U)^\s+|\s+$", ""))
    removed = F.regexp_replace(low, _ignored_words_regex(), "")
    return F.regexp_replace(removed, r"(?U)^\s+|\s+$", "")


def fingerprint(c: Column) -> Column:
    """md5 hex of the UTF-8 bytes."""
    return F.md5(c)
