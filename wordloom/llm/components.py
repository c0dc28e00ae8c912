"""Connected components of an edge table, by rounds of Spark joins."""

from __future__ import annotations

import gc
import tempfile
import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def checkpointed(df: DataFrame) -> DataFrame:
    """df written to the checkpoint folder that the session names."""
    spark = df.sparkSession
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(checkpoint_folder(spark))
    return df.checkpoint(eager=True)


def checkpoint_folder(spark) -> str:
    """spark.checkpoint.dir; where it is unset, a temporary folder in local mode, and an error on a cluster."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    return tempfile.mkdtemp(prefix="checkpoints-")


def shared_folder(spark, name: str) -> str:
    """A new folder under spark.checkpoint.dir."""
    return f"{checkpoint_folder(spark)}/{name}-{uuid.uuid4().hex}"


def quoted(name: str) -> Column:
    """The column of this name, whatever signs the name has."""
    return F.col("`" + name.replace("`", "``") + "`")


def as_row(df: DataFrame, *without: str, name: str = "row") -> Column:
    """The other columns of df as one struct, so that none of their names can clash."""
    return F.struct(*(quoted(c).alias(c) for c in df.columns if c not in without)).alias(name)


def from_row(df: DataFrame, new: dict[str, Column], name: str = "row") -> list[Column]:
    """The columns of df again, out of the struct of as_row; new has those that were left out or are changed."""
    return [(new[c] if c in new else F.col(name).getField(c)).alias(c) for c in df.columns]


def stored(df: DataFrame, name: str, plain: bool = False) -> DataFrame:
    """df written as a table in the shared folder and read again, which cuts its lineage.

    plain: for numbers that are as good as random, which no dictionary or compression makes smaller.
    The shuffle files of earlier tables go before df is computed, as nothing reads them any more.
    """
    spark, schema = df.sparkSession, df.schema
    path = shared_folder(spark, name)
    release_shuffles(spark)
    df.write.option("compression", "uncompressed" if plain else "zstd").option("parquet.enable.dictionary", str(not plain).lower()).parquet(path)
    out = spark.read.schema(schema).parquet(path)
    out.stored_at = path
    return out


def forget(df: DataFrame) -> None:
    """Deletes the files of a stored table that nothing reads any more."""
    spark = df.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(df.stored_at)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def release_shuffles(spark) -> None:
    """Spark deletes the shuffle files of plans that nothing holds when the driver collects its garbage; this asks for it."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, component): the smallest node that each node of (a, b) edges can reach.

    Alternates two steps until no label changes: every node points at its smallest
    neighbour (large star), then neighbours of a node point at the smallest (small star).
    The number of edges never grows; each round is cut off by a checkpoint.  An empty
    table gives no rows.
    """
    now = checkpointed(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct())
    mark = _fingerprint(now)
    for _ in range(most_rounds):
        # Large star: neighbours greater than u point at the least of u and its neighbours.
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        # Small star: u and its smaller neighbours point at the least of them.
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u")
        after = small.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v"))).filter("u <> v").distinct()
        now = checkpointed(after)
        before, mark = mark, _fingerprint(now)
        if mark == before:
            break
    else:
        raise RuntimeError("components did not settle")
    roots = now.select(F.col("v").alias("node")).distinct().select("node", F.col("node").alias("component"))
    return now.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("component")).unionByName(roots)


def _fingerprint(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v")), F.sum(F.xxhash64("v", "u").cast("decimal(38,0)"))).head()
    return tuple(row)
