"""op5: 20 nearest rows of `embeddings` for every row whose id is divisible by 20."""

from pyspark.sql import functions as F

from linkloom.llm.ann import nearest
from linkloom.llm.common import table
from linkloom.llm.registry import register


@register("op5_nearest")
def op5_nearest(spark, sf_dir):
    return nearest(table(spark, sf_dir, "embeddings"), F.col("id") % 20 == 0)
