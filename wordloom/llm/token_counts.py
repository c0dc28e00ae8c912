"""Exact length histogram of encoded documents.

Documents are counted by the number of their ids.  The histogram has a row for each
length that occurs; sums over the rows of greater length answer, for every context
limit, how many documents are longer, how many ids are kept when documents are cut at
the limit, and where the quantiles are.  Sums are made in two steps, within ranges of
lengths and over the ranges' totals, so that no task sees all rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import tokens
from .components import stored

#: Lengths of a range of the histogram.
RANGE = 128


def _counter(path: str | None):
    def count(batches):
        for batch in batches:
            sizes = [np.zeros(0, np.int64), *(np.diff(edges) for _, _, edges in tokens.encoded(batch.column(0), path))]
            lengths, docs = np.unique(np.concatenate(sizes), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(lengths, pa.int64()), pa.array(docs, pa.int64())], names=["length", "documents"])

    return count


def histogram(docs: DataFrame, path: str | None = None) -> DataFrame:
    """(length, documents): null and empty texts have length 0; each row counts, repeated ones too."""
    counted = docs.select("text").mapInArrow(_counter(path), "length long, documents long")
    return counted.groupBy("length").agg(F.sum("documents").alias("documents"))


def context_limits(lengths: DataFrame) -> DataFrame:
    """For each length that occurs, taken as a context limit: what it keeps and cuts.

    documents_over, tokens_over: of documents longer than the limit.  tokens_kept: ids
    left when every document is cut at the limit; for a limit between two lengths that
    occur, it is tokens_kept of the lower one plus documents_over times the difference.
    quantile: part of the documents that are no longer than the limit.  An empty table
    gives no rows.
    """
    part = lengths.withColumn("range", F.floor(F.col("length") / RANGE)).withColumn("tokens", F.col("length") * F.col("documents"))
    totals = part.groupBy("range").agg(F.sum("documents").alias("range_documents"), F.sum("tokens").alias("range_tokens"))
    # One row for each range of lengths: the longest text bounds their number.
    after = Window.orderBy(F.desc("range")).rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    totals = totals.select("range", *(F.coalesce(F.sum(f"range_{x}").over(after), F.lit(0)).alias(f"{x}_beyond") for x in ("documents", "tokens")), *(F.sum(f"range_{x}").over(everything).alias(f"total_{x}") for x in ("documents", "tokens")))
    within = Window.partitionBy("range").orderBy(F.desc("length")).rowsBetween(Window.unboundedPreceding, -1)
    sums = part.join(totals, "range").select("length", "documents", "total_documents", "total_tokens", *((F.col(f"{x}_beyond") + F.coalesce(F.sum(x).over(within), F.lit(0))).alias(f"{x}_over") for x in ("documents", "tokens")))
    return sums.select("length", "documents", "documents_over", "tokens_over", (F.col("total_tokens") - F.col("tokens_over") + F.col("documents_over") * F.col("length")).alias("tokens_kept"), "total_documents", "total_tokens", ((F.col("total_documents") - F.col("documents_over")) / F.col("total_documents")).alias("quantile"))


def quantiles(limits: DataFrame, parts: list[float]) -> DataFrame:
    """(part, length): the least length that this part of the documents does not exceed."""
    wanted = limits.sparkSession.createDataFrame([(float(p),) for p in parts], "part double")
    return wanted.join(limits, F.col("quantile") >= F.col("part")).groupBy("part").agg(F.min("length").alias("length"))


def truncated_total(limits: DataFrame, limit: int) -> DataFrame:
    """tokens_kept at any limit, from the greatest length that occurs and is no greater; one row."""
    below = limits.filter(F.col("length") <= limit).agg(F.max_by(F.struct("length", "tokens_kept", "documents_over"), "length").alias("x"))
    total = limits.agg(F.coalesce(F.max("total_documents"), F.lit(0)).alias("documents"))
    return total.crossJoin(below).select(F.lit(limit).cast("long").alias("limit"), F.coalesce(F.col("x.tokens_kept") + F.col("x.documents_over") * (F.lit(limit) - F.col("x.length")), F.col("documents") * limit).alias("tokens_kept"))


def op10_token_counts(spark, sf_dir: str) -> DataFrame:
    """context_limits of whole documents; lengths are without an end id.  Nulls, repeats and empties: as histogram has them."""
    return context_limits(stored(histogram(spark.read.parquet(f"{sf_dir}/documents.parquet")), "lengths"))
