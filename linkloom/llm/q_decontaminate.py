"""op3: items of `benchmark` found in every row of `documents`."""

from linkloom.llm.common import table
from linkloom.llm.decontaminate import contaminated
from linkloom.llm.registry import register


@register("op3_decontaminate")
def op3_decontaminate(spark, sf_dir):
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), substrings=True)
