"""op11: all documents by two tokenizers, aligned."""

import public_tokenizers

from fieldloom.llm.alignment import align
from fieldloom.llm.registry import query

BYTES, PIECES = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


@query("op11_alignment")
def op11(t):
    return align(t.documents, BYTES, PIECES)
