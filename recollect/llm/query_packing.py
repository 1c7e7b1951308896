"""op9_packing over all documents. No SQL: it depends on a tokenizer."""

import public_tokenizers

from recollect.llm.packing import packed
from recollect.llm.shared import table

VOCABULARY = "word_bpe_49k.json"


def op9_packing(spark, sf_dir):
    return packed(table(spark, sf_dir, "documents").select("doc_id", "text"), public_tokenizers.path(VOCABULARY))


QUERIES = {"op9_packing": op9_packing}
ORACLE_SQL: dict = {}
