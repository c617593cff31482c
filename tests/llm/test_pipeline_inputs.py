"""Stages of the pipeline on empty tables and on tables with columns of clashing names."""

import corpus_pipeline
from linkloom.llm.common import stage, table
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"
NAMES = ("_row", "_keep_id", "_keep_t", "d", "i", "h", "fp", "t", "doc", "cuts", "words", "component", "score", "tokens", "y", "bins")


def test_empty_table(spark):
    docs = table(spark, SF, "documents").limit(0)
    for name, step in corpus_pipeline.STAGES:
        out = stage(step(spark, docs, SF), f"empty-{name}")
        assert out.count() == 0, name
        if name != corpus_pipeline.STAGES[-1][0]:
            assert out.columns == docs.columns


def test_clashing_columns_change_nothing(spark):
    docs = table(spark, SF, "documents")
    odd = spark.createDataFrame([(None, "no id", "en", "s", 5), (9001, None, None, None, None), (9002, "", "en", "s", 0)], docs.schema)
    docs = stage(docs.unionByName(odd), "plain")
    wide = stage(docs.select("*", *[F.lit(i).alias(n) for i, n in enumerate(NAMES)]), "wide")
    for name, step in corpus_pipeline.STAGES[:-1]:
        a, b = step(spark, docs, SF), step(spark, wide, SF)
        assert b.columns == wide.columns, name
        docs, wide = stage(a, f"plain-{name}"), stage(b, f"wide-{name}")
        rows = lambda x: sorted((str(r["doc_id"]), str(r["text"])) for r in x.collect())
        assert rows(docs) == rows(wide), name
        assert wide.select(*NAMES).distinct().count() == 1
    name, step = corpus_pipeline.STAGES[-1]
    sizes = lambda x: sorted((str(r["doc_id"]), r["start"], r["length"]) for r in x.collect())
    assert sum(n for _, _, n in sizes(step(spark, docs, SF))) == sum(n for _, _, n in sizes(step(spark, wide, SF)))
