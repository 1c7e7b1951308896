"""op8_quality_rules over all documents. No SQL: it depends on a tokenizer."""

import public_tokenizers

from recollect.llm.quality import quality
from recollect.llm.shared import table

VOCABULARY = "piece_bpe_32k.model"


def op8_quality_rules(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    return quality(docs, public_tokenizers.path(VOCABULARY), ["doc_id"])


QUERIES = {"op8_quality_rules": op8_quality_rules}
ORACLE_SQL: dict = {}
