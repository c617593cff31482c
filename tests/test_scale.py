"""Ranks with a hot group, density clusters over scales, deep pages, mixed bookmark folders."""

import json

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from linkloom.operators import cluster as CL
from linkloom.operators import html as H
from linkloom.operators.ranking import rank_within_group
from linkloom.sources.bookmarks import read_bookmarks


def test_ranks_of_a_million_rows_with_a_hot_group(spark):
    df = spark.range(1_000_000).select(
        F.col("id").alias("pos"), F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("d"), F.xxhash64("id") % 997)).alias("domain"))
    got = rank_within_group(df, "domain", ["pos"])
    want = df.withColumn("want", F.row_number().over(Window.partitionBy("domain").orderBy("pos"))).select(F.col("pos").alias("p"), "want")
    n, wrong = got.join(want, F.col("pos") == F.col("p")).select(F.count(F.lit(1)), F.count_if(F.col("rn") != F.col("want"))).first()
    assert (n, wrong) == (1_000_000, 0) and got.count() == 1_000_000


def points(spark, groups):
    rows = [(i, [float(x), 0.0]) for i, x in enumerate(x for g in groups for x in g)]
    return spark.createDataFrame(rows, "id long, vector array<double>")


TIGHT, LOOSE = [i * 0.1 for i in range(6)], [100 + i * 1.5 for i in range(6)]


@pytest.mark.parametrize("groups", [
    [TIGHT, LOOSE, [40.0, 70.0]],                                  # the rows between leave the loose cluster early
    [TIGHT, [3.5 + i * 1.5 for i in range(6)], [-4.0, 15.0]],      # near each other, on two scales
    # splits only at the end, for a moment: the parent wins
    [[0, 1, 2, 3, 4, 5, 6.55, 7.55, 8.55, 9.55, 10.55, 11.55], [1000 + i for i in range(6)]],
])
def test_density_hierarchy_over_scales(spark, groups):
    from test_density_tree import plain_tree
    got = CL.density_hierarchy(points(spark, groups), 2, 5).orderBy("id").collect()
    want = plain_tree([[float(x), 0.0] for g in groups for x in g], 2, 5)
    assert [r["cluster_id"] for r in got] == [v for v, _ in want]
    assert [r["cluster_conf"] for r in got] == [round(p, 4) for _, p in want]
    assert {r["cluster_id"] for r in got} - {-1} == {0, 12 if len(groups) == 2 else 6}


def test_components_that_do_not_settle_are_an_error(spark):
    v = spark.range(40)
    e = spark.range(39).select(F.col("id").alias("i"), (F.col("id") + 1).alias("j"))
    assert {r["component"] for r in CL.connected_components(v, e).collect()} == {0}
    with pytest.raises(RuntimeError):
        CL.connected_components(v, e, max_rounds=2)


def test_deeply_nested_page(spark):
    page = "<html><title>deep</title>" + "<div>" * 5000 + "<p>three small words</p>"
    df = spark.createDataFrame([(1, page), (2, None), (3, "")], "page_id long, html string")
    assert "three small words" in {r.page_id: r.main_text for r in H.main_content(df, None).collect()}[1]
    assert {r.page_id: r.visible_text for r in H.visible_text(df).collect()} == {1: "deep three small words", 2: "", 3: ""}


def test_main_content_column_equals_the_table_form(spark):
    from linkloom.operators.html import main_content_udf
    df = spark.read.parquet("/root/testdata/sf0.001/pages.parquet").select("page_id", "html")
    a = {r.page_id: r.main_text for r in H.main_content(df, None).collect()}
    b = {r.page_id: r.m for r in df.select("page_id", main_content_udf("html").alias("m")).collect()}
    assert a == b and len(a) >= 50


def test_clean_entries_reads_html_rows(spark):
    from linkloom.operators.clean import clean_entries
    page = ("<!DOCTYPE html><html><head><style>.secretstyle{}</style><title>Garden robots</title></head><body>"
            "<nav>navigationword</nav><p>Robots water every garden plant daily.</p></body></html>")
    df = spark.createDataFrame([(1, "a.org", page), (2, "a.org", "plain words stay here"), (3, "a.org", None)], "pos long, domain string, scraped string")
    got = {r.pos: r.clean_text for r in clean_entries(df).collect()}
    assert "secretstyle" not in got[1] and "navigationword" not in got[1] and "water" in got[1]
    assert got[2] == "plain words stay" or got[2] == "plain words stay here" or "plain" in got[2]
    assert got[3] == ""


def test_mixed_folder_has_unique_ids(spark, tmp_path):
    one = ('<!DOCTYPE html><html><head><title>OneTab</title></head><body><div id="tabGroupsDiv"><div class="tabGroup"><div>2 tabs</div>'
           '<div>Created 3/9/2024, 1:02:03 PM</div><div class="tabList"><div class="tab"><a class="tabLink" href="https://a.org/%d">T</a></div>'
           '</div></div></div></body></html>')
    net = ('<!DOCTYPE NETSCAPE-Bookmark-file-1>\n<DL><p><DT><H3>Coding</H3><DL><p><DT><A HREF="https://b.org/1" ADD_DATE="1700000000">One</A>'
           '</DL></DL>')
    entry = {"url": "https://c.org/1", "title": "c", "domain": "c.org", "date": "2024-01-02T03:04:05", "group_ids": [7]}
    (tmp_path / "a.html").write_text(one % 1)
    (tmp_path / "b.html").write_text(net)
    (tmp_path / "c.html").write_text(one % 2)
    (tmp_path / "d.json").write_text(json.dumps([entry, {**entry, "url": "https://c.org/2"}]))
    (tmp_path / "e.json").write_text(json.dumps({**entry, "url": "https://c.org/3"}) + "\n\n" + json.dumps({**entry, "url": "https://c.org/4"}))
    rows = read_bookmarks(spark, str(tmp_path)).collect()
    assert sorted(r.url for r in rows) == ["https://a.org/1", "https://a.org/2", "https://b.org/1"] + [f"https://c.org/{i}" for i in (1, 2, 3, 4)]
    assert len({r.pos for r in rows}) == 7
    assert len({r.group_ids[0] for r in rows if "c.org" not in r.url}) == 3
    assert all(r.date is not None for r in rows)
    (tmp_path / "f.html").write_text("<html>other</html>")
    with pytest.raises(ValueError):
        read_bookmarks(spark, str(tmp_path))
