"""Corpora, vocabularies and vector files."""

from __future__ import annotations

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators.lineage import sent
from . import vector_files


def read_corpus(spark, path: str) -> DataFrame:
    """(doc_id, text, path) of a file, or of all files under a folder, each file a document; ids follow from the paths."""
    files = spark.read.option("recursiveFileLookup", "true").text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))
    return files.select(F.xxhash64("path").alias("doc_id"), "text", "path")


def read_prepared(spark, path: str) -> DataFrame:
    """(doc_id, line, path) of a prepared corpus: each line of a file, or of all files under a folder, a document.

    A file of any size is read in splits.  Ids count from 0 through the files in order of
    their paths, and through each in order of its lines: lines are counted in their split,
    a split is known by its first byte, and the sizes of those before it shift it.
    """
    read = spark.read.option("recursiveFileLookup", "true").text(path)
    rows = read.select("value", F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("read"))
    # A split's lines are read one after another by one task.
    sizes = rows.groupBy("path", "block").agg(F.min("read").alias("first"), F.count("*").alias("n"))
    earlier = Window.orderBy("path", "block").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("path", "block", (F.coalesce(F.sum("n").over(earlier), F.lit(0)) - F.col("first")).alias("shift"))
    return rows.join(sent(starts), ["path", "block"]).select((F.col("read") + F.col("shift")).alias("doc_id"), F.col("value").alias("line"), "path")


def write_corpus(lines: DataFrame, path: str, force: bool = False) -> None:
    """One line for each document of (doc_id, line); an existing target is an error unless forced."""
    lines.select(F.col("line").alias("value")).write.mode("overwrite" if force else "errorifexists").text(path)


def save_vocab(vocab: DataFrame, path: str, force: bool = False) -> None:
    """Lines "word count", most frequent first in each file."""
    ordered = vocab.sort(F.desc("cn"), "word")
    ordered.select(F.concat_ws(" ", "word", F.col("cn").cast("string")).alias("value")).write.mode("overwrite" if force else "errorifexists").text(path)


def read_vocab(spark, path: str) -> DataFrame:
    """(word, cn, word_id) of a saved vocabulary, ranked again."""
    from ..operators.text import ranked

    parts = spark.read.text(path).filter("value <> ''").select(F.split("value", " ").alias("p"))
    return ranked(parts.select(F.col("p")[0].alias("word"), F.col("p")[1].cast("long").alias("cn")))


def write_vectors(vectors: DataFrame, path: str, binary: bool = True, force: bool = False, file_rows: int = vector_files.FILE_ROWS) -> None:
    """(word, word_id, vec) as a folder of vector files in order of word_id; each has a line with rows and length, then its rows.

    Tasks write ranges of ids; nothing passes the driver.  No rows: one file without any.
    """
    fs, inner = vector_files.file_system(path)
    if not force and fs.get_file_info(inner).type != pa.fs.FileType.NotFound:
        raise FileExistsError(path)
    vectors.sparkSession.dataSource.register(vector_files.VectorFiles)
    rows = vectors.orderBy("word_id").select("word", F.col("vec").cast("array<float>").alias("vec"))
    rows.write.format("word_vectors").mode("overwrite" if force else "append").option("binary", str(binary).lower()).option("file_rows", file_rows).save(path)


def read_vectors(spark, path: str, binary: bool = True, piece: int = vector_files.PIECE) -> DataFrame:
    """(path, word, word_id, vec) of a vector file, or of all in a folder; word_id counts from 0 through the files in order of their names.

    Files are read in pieces of so many bytes.  The pieces are counted first, so that each
    knows its first id.
    """
    spark.dataSource.register(vector_files.VectorFiles)
    rows = spark.read.format("word_vectors").option("binary", str(binary).lower()).option("piece", piece).load(path)
    sizes = rows.groupBy("path", "piece").agg(F.count("*").alias("n"))
    earlier = Window.orderBy("path", "piece").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select(F.col("path").alias("_path"), F.col("piece").alias("_piece"), F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("_first"))
    joined = rows.join(sent(starts), (F.col("path") == F.col("_path")) & (F.col("piece") == F.col("_piece")))
    return joined.select("path", "word", (F.col("_first") + F.col("row")).alias("word_id"), "vec")
