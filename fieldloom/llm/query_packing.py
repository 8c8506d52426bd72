"""op5: all documents in sequences of at most 2048 tokens."""

import public_tokenizers
from pyspark.sql import functions as F

from fieldloom.llm.packing import pack
from fieldloom.llm.registry import query

TOKENIZER = public_tokenizers.path("word_bpe_49k.json")


@query("op5_packing")
def op5(t):
    packed = pack(t.documents, TOKENIZER)
    return packed.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
