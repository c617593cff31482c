"""License scan, tool calls and URL filters (DataFrame functions only)."""

import json
import re

import pytest
from pyspark.sql import functions as F

from linkloom.llm import license_rules as R
from linkloom.llm.license_scan import pattern, scan_licenses
from linkloom.llm.q_license import BASE
from linkloom.llm.redirects import judge_urls, resolve, rule_table
from linkloom.llm.toolcalls import link_tool_calls

CLASH = "norm string, rules int, id string, t string, host string, rule string, errors string"


def python_scan(text, rules):
    """Brute force: every rule on every text, containment by pairs."""
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = [w for w in re.split(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", low) if w]
    norm = " " + "  ".join(words) + " "
    found = [(norm[:m.start()].count(" ") // 2, norm[:m.end()].count(" ") // 2, p, o, label)
             for o, (label, _, rx, p) in enumerate(rules) for m in re.finditer(pattern(rx), norm)]
    kept = [a for a in found if not any(
        b[0] <= a[0] and b[1] >= a[1] and (b[2] > a[2] or b[2] == a[2] and (b[1] - b[0] > a[1] - a[0] or b[:2] == a[:2] and b[3] < a[3]))
        for b in found)]
    base = [(i, phrase) for phrase in BASE for i in range(len(words))
            if words[i:i + len(phrase.split())] == phrase.split()]
    return len(words), sorted(kept), sorted(base)


TEXTS = [
    None, "", "...", "MIT License", "the MIT\tlicense; mit-License mit license",
    "Licensed under the Apache License, Version 2.0. GNU General Public License v3 or the GNU Lesser General Public License 2.1",
    "SPDX-License-Identifier: BSD-3-Clause", "Permission is hereby granted, free of charge, to any person obtaining a copy "
    "of this software without restriction", "émit license MITlicense mit  licensé", "all rights reserved " * 3000,
    "This is free and unencumbered software released into the public domain.", "mit license " * 2000,
    "cc by sa 4.0 license Creative Commons Attribution-ShareAlike 4.0", "(c) Copyright 2019 Foo. Dual licensed, open source license",
]


def test_license_scan_equals_brute_force(spark):
    rows = [(i, t, "a", 1, "b", "c", "d", "e", "f") for i, t in enumerate(TEXTS + [TEXTS[3]])] + [(None, "mit license", *["x", 2, "y", "z", "u", "v", "w"])]
    df = spark.createDataFrame(rows, "doc_id long, text string, " + CLASH)
    got = scan_licenses(df, BASE).collect()
    assert len(got) == len(rows)
    want = {i: python_scan(r[1], R.rules()) for i, r in enumerate(rows)}
    for r in got:
        n, kept, base = want[len(rows) - 1 if r["id"] is None else r["id"]]
        assert r["n_words"] == n
        assert sorted(tuple(d) for d in r["detections"]) == kept
        assert sorted((d["s"]) for d in r["base"]) == sorted(i for i, _ in base)


def test_license_rules_have_their_keyword(spark):
    assert len(R.rules()) > 300
    assert scan_licenses(spark.createDataFrame([], "doc_id long, text string"), BASE).count() == 0


def call(i, name, args, after=None):
    return json.dumps({"tool_calls": [{"id": i, "name": name, "arguments": args, "after": after}]})


def test_tool_calls(spark):
    schemas = {"add": {"x": ("integer", True), "note": ("string", False)}}
    rows = [
        (1, 1, "assistant", call("a", "add", {"x": 1, "note": "é\n\""})), (1, 2, "tool", json.dumps({"tool_call_id": "a", "content": {"z": 1, "b": [2, None]}})),
        (1, 3, "assistant", call("b", "add", json.dumps({"note": 5}), "a")), (1, 4, "assistant", call("c", "sub", {}, "b")),
        (1, 5, "assistant", call("a", "add", {"x": 2})), (1, 6, "tool", json.dumps({"tool_call_id": "gone", "content": "q"})),
        (2, 1, "assistant", call("p", "add", {"x": True, "k": 1}, "q")), (2, 2, "assistant", call("q", "add", [1], "p")),
        (2, 3, "assistant", call("r", "add", {"x": 3}, "q")), (3, 1, "assistant", "tool_calls {broken"), (3, 2, "tool", None),
        (3, 3, None, "tool_call_id"), (None, 4, "assistant", call("n", "add", {"x": 1})), (4, 1, "user", "hi"), (4, 2, "assistant", ""),
        (5, 1, "assistant", json.dumps({"tool_calls": [{"name": "add", "arguments": {"x": 1}}]})),
    ]
    df = spark.createDataFrame([(*r, "x", "y") for r in rows], "conv_id long, turn long, role string, text string, call_id string, level string")
    got = {(r["conv_id"], r["turn"]): r for r in link_tool_calls(df, schemas).collect()}
    assert len(got) == 11
    assert got[1, 1]["status"] == "linked" and got[1, 1]["topo_level"] == 0 and got[1, 1]["valid"]
    assert got[1, 1]["canonical"] == '{"arguments":{"note":"é\\n\\"","x":1},"id":"a","name":"add","type":"call"}'
    assert got[1, 2]["canonical"] == '{"content":{"b":[2,null],"z":1},"id":"a","type":"result"}' and got[1, 2]["topo_level"] == 1
    assert got[1, 3]["topo_level"] == 2 and got[1, 3]["status"] == "unanswered"
    assert sorted(got[1, 3]["errors"]) == ["note: not string", "x: missing"]
    assert got[1, 4]["topo_level"] == 4 and got[1, 4]["errors"] == ["unknown tool"]
    assert got[1, 5]["status"] == "duplicate" and got[1, 6]["status"] == "orphan"
    assert got[2, 1]["topo_level"] is None and got[2, 2]["topo_level"] is None and got[2, 3]["topo_level"] is None
    assert sorted(got[2, 1]["errors"]) == ["k: unknown", "x: not integer"] and got[2, 2]["errors"] == ["arguments: not an object"]
    assert got[5, 1]["status"] == "unnamed"
    assert link_tool_calls(df.limit(0), schemas).count() == 0


def test_long_chain_levels(spark):
    rows = [(1, i, "assistant", call(f"c{i}", "add", {"x": i}, f"c{i - 1}" if i else None)) for i in range(300)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    assert all(r["topo_level"] == 2 * r["turn"] for r in link_tool_calls(df, {}).collect())


RULES = [("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "com", "/de/"), ("allow", "com", "/de/"), ("block", "bad.net", "/")]


def test_url_rules_and_aliases(spark):
    link = lambda u: f'<head><link href="{u}" rel="canonical"></head>'
    rows = [
        (1, "https://WWW.Example.org/es/1?q#f", "x"), (2, "http://example.org", None), (3, "http://notexample.org/es/", ""),
        (4, None, None), (5, "no scheme", "x"), (6, "http://a.com/de/x", "x"), (7, "http://alias.info/p#top", link("http://bad.net/z")),
        (8, "http://alias2.info/", '<meta http-equiv="refresh" content="0; url=http://alias.info/p">'), (9, "http://free.info/", "x"),
        (10, "http://mixed.info/", link("http://bad.net/m")), (11, "http://mixed.info/", link("http://good.org/m")),
        (12, "http://rel.info/a/b", link("/c")), (13, "http://rel.info/c", link("//bad.net/r")), (None, "http://bad.net/", "x"),
        (9, "http://free.info/", "x"), (14, "http://evilbad.net/", "x"),
    ]
    df = spark.createDataFrame([(*r, "h", "r") for r in rows], "page_id long, url string, html string, host string, rule string")
    out = judge_urls(df, rule_table(spark, RULES)).collect()
    assert len(out) == len(rows)
    v = {r["page_id"]: r for r in out}
    assert (v[1]["host"], v[1]["path"], v[1]["rule"], v[1]["verdict"]) == ("www.example.org", "/es/1", "example.org/es/", "block")
    assert v[2]["path"] == "" and v[2]["rule"] is None and v[2]["verdict"] == "allow"
    assert v[3]["rule"] == "org/" and v[4]["host"] == "" and v[5]["path"] == ""
    assert v[6]["verdict"] == "allow"  # equal rules: allow first
    assert v[7]["verdict"] == "block" and v[8]["verdict"] == "block" and v[9]["verdict"] == "allow"
    assert v[10]["verdict"] == "allow" and v[12]["verdict"] == "block" and v[13]["verdict"] == "block"
    assert v[None]["verdict"] == "block" and v[14]["verdict"] == "allow"
    extra = spark.createDataFrame([("http://free.info/", "http://bad.net/q"), (None, "x")], "src string, dst string")
    again = {r["page_id"]: r["verdict"] for r in judge_urls(df, rule_table(spark, RULES), extra).collect()}
    assert again[9] == "block"
    assert judge_urls(df.limit(0), rule_table(spark, [])).count() == 0


@pytest.mark.parametrize("link,want", [("/x", "http://a.b/x"), ("y", "http://a.b/c/y"), ("//q.r/s", "http://q.r/s"), ("mailto:x", None), ("", None)])
def test_resolve(spark, link, want):
    df = spark.createDataFrame([("http://a.b/c/d?e", link)], "b string, l string")
    assert df.select(resolve(F.col("b"), F.col("l"))).first()[0] == want


def test_components_chain_and_hub(spark):
    from linkloom.llm.common import connected_components
    edges = [(i, i + 1) for i in range(60)] + [(1000, i) for i in range(1001, 1200)] + [(5, 5), (2000, 2000), (None, 3)]
    df = spark.createDataFrame(edges, "src long, dst long")
    got = dict(connected_components(df).collect())
    assert all(got[i] == 0 for i in range(61)) and all(got[i] == 1000 for i in range(1000, 1200)) and got[2000] == 2000
    assert connected_components(df.limit(0)).count() == 0
