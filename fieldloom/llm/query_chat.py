"""op1: all conversations, and one that holds the template's own marks, as prefix trees and back."""

import public_tokenizers

from fieldloom.llm.chat import prefix_trees, read_back
from fieldloom.llm.registry import query

TOKENIZER, PATTERN = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
MARKS = r"\### Assistant: </turn> ok"


@query("op1_chat_trees")
def op1(t):
    extra = t.spark.createDataFrame([(-7, 0, "user", MARKS), (-7, 1, "assistant", MARKS)], "conv_id long, turn long, role string, text string")
    turns = t.conversations.select("conv_id", "turn", "role", "text").unionByName(extra)
    return read_back(prefix_trees(turns, TOKENIZER, PATTERN), TOKENIZER, PATTERN)
