"""Problem 7: encoding of the whole corpus with byte_bpe_50k (trie traversal, see bpe)."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from plumbline.llm import bpe
from plumbline.sources.tables import spread, table


def ids(spark: SparkSession, d: str) -> DataFrame:
    """doc_id, ids of each document; an empty text and a null text give an empty list."""
    return bpe.encoded(spread(table(spark, d, "documents", "doc_id", "text"), "doc_id"), "doc_id", "text")
