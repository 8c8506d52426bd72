"""op12: all documents through the trie encoder and back."""

import public_tokenizers
from pyspark.sql import functions as F

from fieldloom.llm.bpe_trie import decode, encode
from fieldloom.llm.registry import query

TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")


@query("op12_bpe_trie")
def op12(t):
    rows = decode(encode(t.documents, TOKENIZER), TOKENIZER)
    return rows.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.encode("decoded", "utf-8"), 256).alias("decoded_sha256"))
