"""op9: toxicity of every row of `documents`, learned from `labels`."""

from linkloom.llm.common import table
from linkloom.llm.registry import register
from linkloom.llm.toxicity import score_toxicity, train


@register("op9_toxicity")
def op9_toxicity(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return score_toxicity(docs, train(docs, table(spark, sf_dir, "labels")))
