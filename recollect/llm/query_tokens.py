"""op1_token_counts over all documents. No SQL: it depends on a tokenizer."""

import public_tokenizers

from recollect.llm.shared import table
from recollect.llm.token_files import token_counts

#: The rank file leaves this identifier free.
VOCABULARY, END = "byte_bpe_multi_50k.tiktoken", 50256


def op1_token_counts(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return token_counts(docs, public_tokenizers.path(VOCABULARY), public_tokenizers.PATTERN, END).select("doc_id", "n_tokens", "ordinal", "first")


QUERIES = {"op1_token_counts": op1_token_counts}
ORACLE_SQL: dict = {}
