"""A training corpus from documents: rules, line and near deduplication, decontamination, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; what it returns is
written as Parquet, and read again as the next one's docs.  All but the last return the
columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from wordloom.llm import decontaminate, line_dedup, pack, quality_rules, simhash
from wordloom.llm.components import stored

STAGES = [
    ("quality_rules", quality_rules.stage),
    ("line_dedup", line_dedup.stage),
    ("simhash", simhash.stage),
    ("decontaminate", decontaminate.stage),
    ("pack", pack.stage),
]

#: SQL has no byte-level BPE, which the last stage needs; tests hold the stages against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
