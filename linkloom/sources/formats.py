"""Export format detection on the head of each file."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def detect_format(content: Column) -> Column:
    """'netscape' | 'onetab' | 'unsupported' from the lower-cased first 2048 chars."""
    head = F.lower(F.substring(content, 1, 2048))
    return (F.when(head.contains("<!doctype netscape-bookmark-file-1"), F.lit("netscape"))
            .when(head.contains("<!doctype html") & head.contains("<title>onetab"), F.lit("onetab"))
            .otherwise(F.lit("unsupported")))


def file_kind(path: Column) -> Column:
    """'.html' / '.json' by extension, else 'unsupported'."""
    low = F.lower(path)
    return (F.when(low.endswith(".html") | low.endswith(".htm"), F.lit("html"))
            .when(low.endswith(".json"), F.lit("json")).otherwise(F.lit("unsupported")))
