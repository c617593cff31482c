"""Scalar functions against brute-force Python versions of the same rules."""

import functools
import re
import unicodedata

from pyspark.sql import functions as F

from linkloom.functions import text as T
from linkloom.functions import urls as U


def lev(x, y):
    """Edit distance by its recursive definition."""
    @functools.cache
    def d(i, k):
        if not i or not k:
            return i + k
        return min(d(i - 1, k) + 1, d(i, k - 1) + 1, d(i - 1, k - 1) + (x[i - 1] != y[k - 1]))
    return d(len(x), len(y))


def similarity(a, b):
    if not a or not b:
        return 0
    n = min(50, len(a), len(b))
    a, b = a[:n].strip(" \t\n\r\x0b\x0c"), b[:n].strip(" \t\n\r\x0b\x0c")
    m = max(len(a), len(b))
    if m == 0:
        return 100
    return 100 - int(lev(a, b) / m * 100)


def test_p17_similarity_matches_brute_force(spark, sf):
    from linkloom.plans.q_entries import p17_text_similarity
    got = {(r.conv_id, r.turn): r.similarity for r in p17_text_similarity(spark, sf).collect()}
    conv = spark.read.parquet(f"{sf}/conversations.parquet").collect()
    by = {(r.conv_id, r.turn): r.text for r in conv}
    exp = {(c, t): similarity(by[(c, t)], by[(c, t + 1)]) for (c, t) in by if (c, t + 1) in by}
    assert got == exp


def test_url_domain_like_urlsplit(spark):
    from urllib.parse import urlsplit
    urls = ["https://docs.a.org/x/y", "file:///tmp/z", "http://u:p@h.com:8080/p?q#f", "//cdn.x.net/a",
            "mailto:a@b.c", "https://A.B.C", "ftp://x.org", "noscheme.com/path"]
    df = spark.createDataFrame([(u,) for u in urls], "url string")
    got = [r[0] for r in df.select(U.url_domain(F.col("url"))).collect()]
    assert got == [urlsplit(u).netloc for u in urls]


def test_onetab_and_epoch_dates(spark):
    df = spark.createDataFrame([("Created 3/9/2024, 1:02:03 PM",), ("Created 12/31/2023, 12:00:00 AM",),
                                ("Created 13/45/2024, 1:02:03 PM",), ("created 3/9/2024, 1:02:03 PM",)], "t string")
    got = [r[0] for r in df.select(F.date_format(U.onetab_date(F.col("t")), "yyyy-MM-dd HH:mm:ss")).collect()]
    assert got == ["2024-03-09 13:02:03", "2023-12-31 00:00:00", None, None]
    df = spark.createDataFrame([("1700000000", None), ("abc", "1700000001"), (None, None)], "a string, m string")
    got = [r[0] for r in df.select(F.date_format(U.epoch_date(F.col("a"), F.col("m")), "yyyy-MM-dd HH:mm:ss")).collect()]
    assert got == ["2023-11-14 22:13:20", "2023-11-14 22:13:21", None]


def test_folder_label_rules(spark):
    words = ["bookmark", "folder", "stuff", "link", "site", "website", "bar", "toolbar", "page", "menu", "list",
             "untitled", "other"]
    alt = "|".join(w + s for w in words for s in ("", "s"))
    pat = re.compile(rf"\b(?:(?:{alt})(?: (?:{alt}))?)\b", re.IGNORECASE)

    def ref(p):
        last = p.split("/")[:4][-1].strip().lower()
        return pat.sub("", last).strip()
    paths = ["Coding", "Coding/Links", "Bookmarks Bar", "a/b/c/d/e", "Other Bookmarks/Python tools",
             "x/Menu Links/z", "Sites", "Web Pages and notes"]
    df = spark.createDataFrame([(p,) for p in paths], "p string")
    got = [r[0] for r in df.select(U.folder_label(F.col("p"))).collect()]
    assert got == [ref(p) for p in paths]


def test_base_title_longest_last_part(spark):
    df = spark.createDataFrame([("Docs about python - Python.org", "www.python.org"),
                                ("abc xyz", "abc.xyz"), ("Plain", "")], "t string, d string")
    got = [r[0] for r in df.select(U.base_title(F.col("t"), F.col("d"))).collect()]
    # parts of equal length: the last one ('xyz') is removed
    assert got == ["Docs about  - .org", "abc", "Plain"]


def test_to_ascii_matches_unicodedata(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    got = {r[0]: r[1] for r in docs.select("doc_id", T.to_ascii(F.col("text"))).collect()}
    for r in docs.collect():
        exp = unicodedata.normalize("NFKD", r.text).encode("ascii", "ignore").decode("ascii")
        assert got[r.doc_id] == exp


def test_near_duplicate_lines(spark):
    from linkloom.operators.html import drop_near_duplicate_lines
    text = "hello world line\nhello world line!\nsomething else entirely\nhello world lime\nok"
    df = spark.createDataFrame([(text,)], "t string")
    got = df.select(drop_near_duplicate_lines(F.col("t"), 85)).collect()[0][0]

    def ratio(a, b):
        m = max(len(a), len(b))
        return 100 if m == 0 else round((1 - lev(a, b) / m) * 100)
    kept = []
    for line in text.split("\n"):
        if all(ratio(line, k) < 85 for k in kept):
            kept.append(line)
    assert got == "\n".join(kept)
