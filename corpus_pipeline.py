"""From raw documents to packed training sequences.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last
return the columns of ``documents``.  ``run`` writes each stage's result to the
shared folder of ``spark.checkpoint.dir`` and reads it back for the next.  The
stages handle nulls, repeated rows and empty tables as their operators say.
"""

from pyspark.sql import functions as F

from linkloom.llm.common import stage, table
from linkloom.llm.debruijn import keep_rest
from linkloom.llm.decontaminate import drop_contaminated
from linkloom.llm.packing import pack_documents
from linkloom.llm.simhash_gray import keep_one
from linkloom.llm.toxicity import drop_toxic, train


def toxicity(spark, docs, sf_dir):
    """Documents that the classifier rejects go."""
    return drop_toxic(docs, train(docs, table(spark, sf_dir, "labels")))


def near_duplicates(spark, docs, sf_dir):
    """One document of each SimHash group stays (3-word shingles, 3 bits)."""
    return keep_one(docs, 3, 3)


def substrings(spark, docs, sf_dir):
    """Windows of 13 words that also start in a document with a smaller id go."""
    rest = keep_rest(docs, 13)
    return rest.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(
        F.length("text").cast("long")))


def benchmark(spark, docs, sf_dir):
    """Documents that hold a benchmark item (word edits up to a fifth) go."""
    return drop_contaminated(docs, table(spark, sf_dir, "benchmark"), substrings=True)


def packing(spark, docs, sf_dir):
    """Pieces of sequences of 1024 ids."""
    return pack_documents(docs, "byte_bpe_50k.json")


STAGES = [("toxicity", toxicity), ("simhash", near_duplicates), ("substring_dedup", substrings),
          ("decontamination", benchmark), ("packing", packing)]

#: the first stage learns a classifier: no SQL; tests compare each stage with a brute-force version
ORACLE_SQL = None


def run(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    for name, step in STAGES[:-1]:
        docs = stage(step(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
