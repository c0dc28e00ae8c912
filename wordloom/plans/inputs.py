"""Word-vector models, word sets and corpora made from the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Header words of the queries, present in all models.
HEADERS = ["4", "5"]


def table(spark, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark, sf_dir: str) -> DataFrame:
    """(doc_id, text); the rows of fewer files than cores are dealt out, as one file may be one task."""
    return _dealt(spark, table(spark, sf_dir, "documents").select("doc_id", "text"))


def _dealt(spark, df: DataFrame) -> DataFrame:
    cores = spark.sparkContext.defaultParallelism
    # As many tasks as the files have splits, if these are more: what a task has does not grow with the table.
    return df.repartition(max(cores, df.rdd.getNumPartitions())) if len(df.inputFiles()) < cores else df


def embeddings(spark, sf_dir: str) -> DataFrame:
    """(vec_id, word, vec, label), dealt out like documents."""
    return _dealt(spark, table(spark, sf_dir, "embeddings")).select("vec_id", F.col("vec_id").cast("string").alias("word"), F.col("embedding").alias("vec"), "label")


def whole_model(spark, sf_dir: str) -> DataFrame:
    """One model of all 64 numbers."""
    return embeddings(spark, sf_dir).select(F.lit("whole").alias("model"), "word", "vec")


def four_models(spark, sf_dir: str) -> DataFrame:
    """Four models over one vocabulary, a slice of 16 numbers each."""
    cut = embeddings(spark, sf_dir).select("word", "vec", F.explode(F.sequence(F.lit(0), F.lit(3))).alias("k"))
    return cut.select(F.concat(F.lit("m"), F.col("k").cast("string")).alias("model"), "word", F.slice("vec", F.col("k") * 16 + 1, F.lit(16)).alias("vec"))


def bootstrap_models(spark, sf_dir: str) -> DataFrame:
    """Four replicates of the whole model, each without one slice."""
    cut = embeddings(spark, sf_dir).select("word", "vec", F.explode(F.sequence(F.lit(0), F.lit(3))).alias("k"))
    return cut.select(F.concat(F.lit("boot"), F.col("k").cast("string")).alias("model"), "word", F.concat(F.slice("vec", F.lit(1), F.col("k") * 16), F.slice("vec", F.col("k") * 16 + 17, F.lit(64))).alias("vec"))


def word_sets(spark, sf_dir: str) -> DataFrame:
    """A set of words for each label."""
    return embeddings(spark, sf_dir).select(F.concat(F.lit("label"), F.col("label").cast("string")).alias("set_id"), "word")


def label_words(spark, sf_dir: str, label: int) -> DataFrame:
    return embeddings(spark, sf_dir).filter(F.col("label") == label).select("word")
