"""Every text that a license rule matches passes the rule's gate."""

import re._parser as parser

from linkloom.llm import license_rules as R
from linkloom.llm.license_scan import scan_licenses
from linkloom.llm.q_license import BASE


def examples(tree):
    """All texts of a pattern; of a range of signs its first."""
    outs = [""]
    for op, arg in tree:
        op = str(op)
        if op == "LITERAL":
            alts = [chr(arg)]
        elif op == "BRANCH":
            alts = [x for t in arg[1] for x in examples(t)]
        elif op == "SUBPATTERN":
            alts = examples(arg[3])
        elif op == "IN":
            alts = [chr(a if str(k) == "LITERAL" else a[0]) for k, a in arg]
        else:
            assert op == "MAX_REPEAT" and arg[:2] == (0, 1)
            alts = ["", *examples(arg[2])]
        outs = [a + b for a in outs for b in alts]
    return outs


def test_every_rule_passes_its_gate():
    for rule in R.rules():
        keys = tuple(R.keywords(rule))
        assert [t for t in examples(parser.parse(rule[2])) if not any(w.startswith(keys) for w in t.split())] == [], rule


def test_notices_without_the_keyword_of_the_family(spark):
    texts = {"Released under the FreeBSD License.": "bsd-2-clause", "do what the fuck you want to public license": "wtfpl",
             "PNG Reference Library License": "libpng-2.0", "open rail-m license": "openrail-m",
             "You may not use this file except in compliance with the License": "apache",
             "The software is provided as is, without warranty of any kind, express or implied": "mit"}
    got = scan_licenses(spark.createDataFrame([*enumerate(texts)], "doc_id long, text string"), BASE).collect()
    assert {r["id"]: [d["label"] for d in r["detections"]] for r in got} == {i: [x] for i, x in enumerate(texts.values())}
