"""Quality rules with cross-document line frequency.

A line, trimmed and with runs of white space made one space, is known by the 64-bit
hash of its text.  For each host (a column, here ``source``) the distinct documents
that hold a line are counted; lines above a limit are that host's boilerplate and are
taken out of its documents.  A document that loses too large a part of its words is
rejected as depleted.  Exact copies of one text count as one document, unless each_row is
asked for: they are the business of deduplication, and a page that many have copied is
not boilerplate.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from . import words
from .components import as_row, checkpointed, from_row, quoted

#: A line is boilerplate of its host if it is on more documents than both of these say, or on more than MANY of them.
MIN_DOCUMENTS = 20
HOST_SHARE = 0.05
MANY = 1000
#: A document is depleted if less than this share of its words is left.
LEAST_LEFT = 0.5
#: Frequent lines up to which all tasks get them, as they are looked through for each line of a text; more meet the texts' lines by a join.
SENT_LINES = 2_000

MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")

_SYMBOLS = b"#*$%&|<>"


def _lines(text):
    """The lines of a text, with white space made even."""
    return F.transform(F.split(F.coalesce(text, F.lit("")), "\n"), lambda x: F.btrim(F.regexp_replace(x, "[ \\t\\x0B\\f\\r]+", " ")))


def frequent_lines(docs: DataFrame, host: str = "source", min_documents: int = MIN_DOCUMENTS, host_share: float = HOST_SHARE, many: int = MANY, each_row: bool = False) -> DataFrame:
    """(host, line_hash, documents) of the lines over the limits.

    Counts are added up in each task before the shuffle, so that a host with a third of
    all rows, or a line on every page, is a few rows for each task.
    """
    text = F.col("text")
    held = docs.select(quoted(host).alias("host"), F.xxhash64(F.coalesce(text, F.lit(""))).alias("content"), F.array_distinct(F.transform(F.filter(_lines(text), lambda x: x != ""), lambda x: F.xxhash64(x))).alias("lines"))
    # Copies of a text are one document: one of its lines' counts stands for all.
    once = held.select("host", "lines") if each_row else held.groupBy("host", "content").agg(F.first("lines").alias("lines"))
    hosts = once.groupBy("host").agg(F.count("*").alias("host_documents"))
    counted = once.select("host", F.explode("lines").alias("line_hash")).groupBy("host", "line_hash").agg(F.count("*").alias("documents")).filter(F.col("documents") > min_documents)
    return counted.join(hosts, counted["host"].eqNullSafe(hosts["host"])).filter((F.col("documents") > host_share * F.col("host_documents")) | (F.col("documents") > many)).select(counted["host"], "line_hash", "documents")


def measure_batches(batches):
    """Base measures of each text; the other columns go along."""
    is_word = words.space_split_table()
    symbol = np.zeros(256, bool)
    symbol[list(_SYMBOLS)] = True
    continuation = np.zeros(256, bool)
    continuation[0x80:0xC0] = True
    for batch in batches:
        column = batch.column(batch.schema.get_field_index("text"))
        out = {k: [np.zeros(0, np.int64)] for k in MEASURES}
        for c in words.chunks(column, is_word):
            n, offsets = len(c.data), c.offsets
            out["n_words"].append(c.counts)
            out["n_symbols"].append(words.row_sums(symbol[c.data], offsets))
            out["word_chars"].append(words.row_sums(is_word[c.data] & ~continuation[c.data], offsets))
            out["n_dup_lines"].append(_dup_lines(c))
            out["n_repeat_words"].append(_repeat_words(c.codes(), c.row_of_word(), c))
        new = {k: np.concatenate(v) for k, v in out.items()}
        keep = [i for i, name in enumerate(batch.schema.names) if name != "text"]
        yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in keep), *(pa.array(v, pa.int64()) for v in new.values())], names=[*(batch.schema.names[i] for i in keep), *new])


def _groups(row: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An order by (row, key) with ties in input order, and where both are equal to those before.  key: codes from 0 on."""
    both = row.astype(np.int64) * (int(key.max()) + 1 if len(key) else 1) + key
    order = np.argsort(both, kind="stable")
    same = np.zeros(len(order), bool)
    if len(order):
        same[1:] = both[order][1:] == both[order][:-1]
    return order, same


def _dup_lines(c: words.Chunk) -> np.ndarray:
    """Lines with a word that equal an earlier line of the text, byte for byte."""
    n = len(c.data)
    breaks = np.flatnonzero(c.data == 10)
    starts = np.unique(np.concatenate([c.offsets[:-1][np.diff(c.offsets) > 0], breaks + 1]))
    starts = starts[starts < n]
    ends = np.empty_like(starts)
    ends[:-1], ends[-1:] = starts[1:], n
    ends -= (ends > starts) & (c.data[np.maximum(ends - 1, 0)] == 10)
    has_word = np.searchsorted(c.start, ends) > np.searchsorted(c.start, starts)
    starts, ends = starts[has_word], ends[has_word]
    row = np.searchsorted(c.offsets, starts, "right") - 1
    order, same = _groups(row, words.coded(c.data, starts, ends)[0])
    return np.bincount(row[order[same]], minlength=len(c)).astype(np.int64)


def _repeat_words(code: np.ndarray, row: np.ndarray, c: words.Chunk) -> np.ndarray:
    """Words in a 3-word window that is found twice or more in the text.  code: of each word, from 0 on."""
    if len(code) < 3:
        return np.zeros(len(c), np.int64)
    size = int(code.max()) + 1
    whole = np.flatnonzero(row[:-2] == row[2:])
    pair = code[whole] * size + code[whole + 1]
    pairs, pair = np.unique(pair, return_inverse=True)
    window = pair * size + code[whole + 2]
    if (int(row[-1]) + 1) * (len(pairs) + 1) * size >= 1 << 62:  # too many for one number with the row
        window = np.unique(window, return_inverse=True)[1]
    order, same = _groups(row[whole], window)
    twice = same.copy()
    twice[:-1] |= same[1:]
    mark = np.zeros(len(code), bool)
    mark[whole[order[twice]]] = True
    return words.row_sums(words.spread(mark, 3, c.first), c.first)


def verdicts(docs: DataFrame, host: str = "source", min_documents: int = MIN_DOCUMENTS, host_share: float = HOST_SHARE, least_left: float = LEAST_LEFT, many: int = MANY, each_row: bool = False, sent_lines: int = SENT_LINES) -> DataFrame:
    """row (the other columns of docs, as a struct), text_left, measures, base_failed, n_words_left and kept.

    text_left is the text without its host's frequent lines.  Null text: a text without
    words, which fails.  Null host: a host of its own.  Rows are judged one by one:
    repeated rows and ids give repeated results.  Columns of docs may have any names.

    Up to sent_lines frequent lines go to all tasks as one set for each host, so that no
    text moves.  More of them meet the lines of the texts by host and line, and each row
    gets the frequent ones of its own lines only.
    """
    frequent = checkpointed(frequent_lines(docs, host, min_documents, host_share, many, each_row).select("host", "line_hash"))
    rows = docs.select(as_row(docs, "text"), "text")
    if frequent.count() <= sent_lines:
        sets = F.broadcast(frequent.groupBy("host").agg(F.array_sort(F.collect_set("line_hash")).alias("frequent")))
        marked = rows.join(sets, rows["row"].getField(host).eqNullSafe(sets["host"]), "left")
    else:
        numbered = rows.withColumn("number", F.monotonically_increasing_id())
        own = numbered.select("number", F.col("row").getField(host).alias("of"), F.explode(F.array_distinct(F.transform(_lines(F.col("text")), lambda x: F.xxhash64(x)))).alias("line"))
        met = own.join(frequent, own["of"].eqNullSafe(frequent["host"]) & (own["line"] == frequent["line_hash"]))
        marked = numbered.join(met.groupBy("number").agg(F.collect_list("line").alias("frequent")), "number", "left")
    touched = F.col("frequent").isNotNull()
    marked = marked.select("row", "text", F.when(touched, _without(F.col("text"), F.col("frequent"))).otherwise(F.col("text")).alias("text_left"), touched.alias("touched"))
    words_left = F.when(F.col("touched"), F.size(F.regexp_extract_all(F.coalesce("text_left", F.lit("")), F.lit("[^\\x20\\x09-\\x0D]+"), F.lit(0))).cast("long"))
    narrow = marked.select("row", "text", "text_left", words_left.alias("words_left"))
    kind = StructType([f for f in narrow.schema.fields if f.name != "text"] + [StructField(name, LongType()) for name in MEASURES])
    measured = narrow.mapInArrow(measure_batches, kind)
    out = measured.withColumn("n_words_left", F.coalesce("words_left", "n_words")).withColumn("base_failed", (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")))
    return out.withColumn("kept", ~F.col("base_failed") & (F.col("n_words_left") >= F.lit(least_left) * F.col("n_words"))).drop("words_left")


def _without(text, frequent):
    """The lines of a text whose normal form is not among the frequent ones."""
    lines = F.split(F.coalesce(text, F.lit("")), "\n")
    normal = lambda x: F.btrim(F.regexp_replace(x, "[ \\t\\x0B\\f\\r]+", " "))
    return F.array_join(F.filter(lines, lambda x: (normal(x) == "") | ~F.array_contains(frequent, F.xxhash64(normal(x)))), "\n")


def op2_quality_rules(spark, sf_dir: str) -> DataFrame:
    """verdicts of documents; nulls and repeats: as verdicts has them.  An empty table gives no rows."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source")
    return verdicts(docs).select("row.doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_words_left")


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the rules keep, without their host's frequent lines; a null text fails them."""
    kept = verdicts(docs).filter("kept")
    new = {"text": F.col("text_left"), "n_chars": F.length("text_left").cast("long")}
    return kept.select(*from_row(docs, new))
