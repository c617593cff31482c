"""op6: SimHash groups of every row of `documents`."""

from pyspark.sql import functions as F

from linkloom.llm.common import table
from linkloom.llm.registry import register
from linkloom.llm.simhash_gray import near_duplicates


@register("op6_simhash")
def op6_simhash(spark, sf_dir):
    return near_duplicates(table(spark, sf_dir, "documents"), 3, 3).select(
        F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
