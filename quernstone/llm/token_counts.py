"""Token counts by heap-and-linked-list byte-pair merging."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .bpe import VOCABULARY, token_counter
from .common import doc_bytes, map_batches, read


def count_tokens(docs: DataFrame, limit: int = 512, vocabulary: str = VOCABULARY, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit (n_tokens > limit): one row for each row.

    Whole texts; a null text counts as empty (0 bytes, 0 tokens), a null doc_id
    stays null, repeated rows give repeated rows, other columns are ignored.
    One narrow stage: nothing is shuffled, and a lost task is simply run again.
    """

    def rows(ids, raws):
        count = token_counter(vocabulary)
        raws = [r or b"" for r in raws]
        tokens = [count(r.decode(errors="replace")) for r in raws]
        return {"doc_id": ids, "n_bytes": [len(r) for r in raws], "n_tokens": tokens, "over_limit": [n > limit for n in tokens]}

    kind = dict(docs.dtypes)[doc_id]
    return map_batches(doc_bytes(docs, text=text, doc_id=doc_id), rows, f"doc_id {kind}, n_bytes long, n_tokens long, over_limit boolean")


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(read(spark, sf_dir, "documents"))
