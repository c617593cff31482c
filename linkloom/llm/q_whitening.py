"""op13: whitened components of every vector of `embeddings`."""

from pyspark.sql import functions as F

from linkloom.llm.common import table
from linkloom.llm.registry import register
from linkloom.llm.whitening import whiten


@register("op13_whitening")
def op13_whitening(spark, sf_dir):
    return whiten(table(spark, sf_dir, "embeddings")).select(
        F.col("id").alias("vec_id"), "component", "n", "deviation", "whitened", "explained", "identity_error")
