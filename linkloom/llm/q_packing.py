"""op7: every document of `documents` packed into sequences of 1024 ids."""

from linkloom.llm.common import table
from linkloom.llm.packing import pack_documents
from linkloom.llm.registry import register

TOKENIZER = "byte_bpe_50k.json"


@register("op7_packing")
def op7_packing(spark, sf_dir):
    return pack_documents(table(spark, sf_dir, "documents"), TOKENIZER)
