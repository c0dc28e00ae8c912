"""Cutting the lineage of tables that several later steps read, and sending small ones to the tasks."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows of a narrow table that go to all tasks.
SENT_ROWS = 1_000_000


def checkpoint_folder(spark) -> str:
    """spark.checkpoint.dir; where it is unset, a temporary folder in local mode, and an error on a cluster."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    master = spark.sparkContext.master
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    return tempfile.mkdtemp(prefix="checkpoints-")


def shared_folder(spark, name: str) -> str:
    """A name for a new folder that the driver and all executors see."""
    return f"{checkpoint_folder(spark)}/{name}-{uuid.uuid4().hex}"


def settled(df: DataFrame) -> DataFrame:
    """df written once to the checkpoint folder."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(checkpoint_folder(df.sparkSession))
    return df.checkpoint(eager=True)


def sent(df: DataFrame, most: int = SENT_ROWS) -> DataFrame:
    """df, to be sent to all tasks if it has at most so many rows; it is counted first."""
    return F.broadcast(df) if df.count() <= most else df


def written(df: DataFrame, name: str, *by: str) -> DataFrame:
    """df as a table in the shared folder, in folders by some columns, and read again: its lineage is cut, and its files can be deleted."""
    spark, schema, path = df.sparkSession, df.schema, shared_folder(df.sparkSession, name)
    df.write.partitionBy(*by).parquet(path)
    out = spark.read.schema(schema).parquet(path)
    out.stored_at = path
    return out


def deleted(df: DataFrame) -> None:
    """Deletes the files of a written table that nothing reads any more."""
    spark = df.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(df.stored_at)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
