"""op3: a sampled segmentation of every document, and what it decodes to."""

import public_tokenizers
from pyspark.sql import functions as F

from fieldloom.llm.registry import query
from fieldloom.llm.segmentation import decode, encode

MODEL = public_tokenizers.path("piece_bpe_32k.model")


@query("op3_sentencepiece")
def op3(t):
    back = decode(encode(t.documents, MODEL), MODEL)
    digest = F.crc32(F.array_join("ids", " ").cast("binary"))
    return back.select("doc_id", F.size("ids").cast("long").alias("n_pieces"), digest.alias("ids_crc32"), F.sha2(F.col("text"), 256).alias("text_sha256"))
