"""Bookmark export goldens (FIXTURES.md §1) and JSON round trip."""

from linkloom.sources import bookmarks as BK

ONETAB = """<!DOCTYPE html><html><head><title>OneTab</title></head><body><div id="tabGroupsDiv">
 <div class="tabGroup"><div>2 tabs</div><div>Created 3/9/2024, 1:02:03 PM</div>
  <div class="tabList"><div class="tab"><a class="tabLink" href="https://docs.a.org/x/y">Docs</a></div>
  <div class="tab"><a class="tabLink" href="file:///tmp/z">local, dropped</a></div></div></div>
</div></body></html>"""

NETSCAPE = """<!DOCTYPE NETSCAPE-Bookmark-file-1>
<DL><p>
 <DT><H3>Coding</H3>
 <DL><p><DT><A HREF="https://b.org/1" ADD_DATE="1700000000">One</A>
  <DT><H3>Links</H3><DL><p><DT><A HREF="https://b.org/2" LAST_MODIFIED="1700000001">Two</A></DL></DL>
</DL>"""


def _files(spark, content):
    return spark.createDataFrame([("f1.html", content)], "file string, content string")


def test_onetab_golden(spark):
    rows = BK.parse_onetab(_files(spark, ONETAB)).collect()
    assert len(rows) == 1
    r = rows[0]
    assert (r.url, r.title, r.domain, str(r.date), r.group_ids) == \
        ("https://docs.a.org/x/y", "Docs", "docs.a.org", "2024-03-09 13:02:03", [0])


def test_netscape_golden(spark):
    rows = BK.parse_netscape(_files(spark, NETSCAPE)).orderBy("pos").collect()
    assert [(r.url, r.folder, str(r.date)) for r in rows] == [
        ("https://b.org/1", "Coding", "2023-11-14 22:13:20"), ("https://b.org/2", "Coding/Links", "2023-11-14 22:13:21")]
    assert rows[0].group_ids != rows[1].group_ids
    paths = sorted(r.path for r in BK.parse_folder_paths(_files(spark, NETSCAPE)).collect())
    assert paths == ["Coding", "Coding/Links"]


def test_folder_labels_from_export(spark):
    from pyspark.sql import functions as F
    from linkloom.functions.urls import folder_label
    paths = BK.parse_folder_paths(_files(spark, NETSCAPE))
    labels = sorted(r[0] for r in paths.select(folder_label(F.col("path"))).collect() if r[0])
    assert labels == ["coding"]


def test_netscape_requires_root_dl(spark):
    import pytest
    with pytest.raises(Exception):
        BK.parse_netscape(_files(spark, "<html><body>no list</body></html>")).collect()


def test_json_round_trip(spark, sf, tmp_path):
    from linkloom.sources.tables import entries
    e = entries(spark, sf)
    BK.write_entries_json(e, str(tmp_path / "j"))
    back = BK.read_entries_json(spark, str(tmp_path / "j"))
    a = sorted((r.pos, r.url, str(r.date), tuple(r.group_ids)) for r in e.collect())
    b = sorted((r.pos, r.url, str(r.date), tuple(r.group_ids)) for r in back.collect())
    assert a == b


def test_ordered_fingerprint(spark):
    import hashlib
    from linkloom.sources.sinks import ordered_fingerprint_df
    md5 = lambda t: hashlib.md5(t.encode()).hexdigest()
    rows = [(i, None if i % 7 == 0 else f"u{i}é") for i in range(150)]

    def got(rows, fan=5, settings=None, parts=3):
        df = spark.createDataFrame(rows, "pos long, url string").repartition(parts)
        return tuple(ordered_fingerprint_df(df, "pos", "url", settings=settings, fan=fan).first())

    level = [md5("-" if u is None else f"{len(u)}:{u}") for _, u in rows]
    while len(level) > 1:
        level = [md5("".join(level[i:i + 5])) for i in range(0, len(level), 5)]
    want = (150, md5(f"150:{level[0]}:"))
    assert got(rows) == want == got(rows, parts=1)
    swapped = [(0, rows[1][1]), (1, rows[0][1]), *rows[2:]]
    assert got(swapped) != want and got(rows[:-1]) != want and got(rows, settings={"a": 1}) != want
    assert got([]) == (0, md5(f"0:{md5('')}:")) and got(rows[1:2]) == (1, md5(f"1:{md5('3:u1é')}:"))
