"""Vocabulary counts over a stream of documents.

All inputs of the engine's operators are finite; counts are the one part that can be kept
up to date as documents arrive, as they add up.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import text


def vocabulary_stream(docs: DataFrame, lower: bool = True) -> DataFrame:
    """(word, cn) of a streaming (doc_id, text) table, for output mode "complete" or "update"."""
    return text.tokens(docs, lower).groupBy("word").agg(F.count("*").alias("cn"))
