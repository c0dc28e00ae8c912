"""Documents as runs of numbered words, and the dictionary of all runs.

A run is some whole documents, about RUN_BYTES of text.  It keeps its words as numbers of
its own and names each different word once.  Its names are in pieces, by buckets of their
hash; a piece is one string of names.  What meets the other runs are pieces: the pieces
of a bucket make its part of the dictionary, and what is known of a name later goes back
to the pieces, and from these to the runs, as arrays in the order of the run's numbers.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import words
from .components import release_shuffles, shared_folder

#: Bytes of text of a run, unless one text is longer, and of all texts for each bucket of names.
RUN_BYTES, BUCKET_BYTES = 1 << 21, 1 << 24
#: Bytes of a row group of stored runs: a reader holds one at a time.
GROUP_BYTES = 8 << 20

RUN = "run long, side int, doc_ids array<long>, apart array<boolean>, n_words array<int>, n_features array<int>, codes binary, buckets array<int>, sizes array<int>, names array<string>, counts array<binary>"


def packed(codes: np.ndarray, terms: int) -> bytes:
    return codes.astype("<u2" if terms <= 1 << 16 else "<u4").tobytes()


def unpacked(data: bytes, terms: int) -> np.ndarray:
    return np.frombuffer(data, "<u2" if terms <= 1 << 16 else "<u4").astype(np.int64)


def bucket_count(*tables: DataFrame) -> int:
    """Buckets for all texts of the tables, so that a bucket's names fit a task."""
    total = sum(df.agg(F.sum(F.octet_length("text"))).head()[0] or 0 for df in tables)
    return total // BUCKET_BYTES + 1


def row(run: int, side: int, doc_ids: pa.Array, apart: pa.Array, n_words, n_features, code: np.ndarray, terms: list[bytes], counts: np.ndarray, buckets: int, inverted: bool = False) -> pa.RecordBatch:
    """A run as a batch of one row; code: the number of each feature's term.  Terms are put in order of their buckets.

    inverted: the codes are kept as postings.
    """
    bucket = np.fromiter(map(zlib.crc32, terms), np.int64, len(terms)) % buckets
    order = np.argsort(bucket, kind="stable")
    place = np.empty(len(terms), np.int64)
    place[order] = np.arange(len(terms))
    some, first = np.unique(bucket[order], return_index=True)
    bounds = [*first.tolist(), len(terms)]
    pieces = [(b" ".join(terms[k] for k in order[a:b]).decode(), counts[order[a:b]].astype("<i8").tobytes()) for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
    one = lambda x, kind: pa.array([x], kind)
    listed = lambda x: pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x)
    columns = {
        "run": one(run, pa.int64()), "side": one(side, pa.int32()), "doc_ids": listed(doc_ids), "apart": listed(apart), "n_words": listed(pa.array(n_words, pa.int32())), "n_features": listed(pa.array(n_features, pa.int32())),
        "codes": one(postings(place[code]).astype("<u4").tobytes() if inverted else packed(place[code], len(terms)), pa.binary()), "buckets": listed(pa.array(some, pa.int32())), "sizes": listed(pa.array(np.diff(bounds), pa.int32())),
        "names": listed(pa.array([x for x, _ in pieces], pa.string())), "counts": listed(pa.array([x for _, x in pieces], pa.binary())),
    }
    return pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))


def postings(code: np.ndarray) -> np.ndarray:
    """Where each term stands, term by term and in order, as steps from one place to the next."""
    places = np.argsort(code, kind="stable").astype(np.uint32)
    return np.diff(places, prepend=np.uint32(0))


def places(steps: bytes) -> np.ndarray:
    """The places of all terms again, term by term."""
    return np.cumsum(np.frombuffer(steps, "<u4"), dtype=np.uint32).astype(np.int64)


def _encode(table: np.ndarray, side: int, buckets: int, inverted: bool):
    def encode(batches):
        number = TaskContext.get().partitionId() << 33
        for batch in batches:
            for c in words.chunks(batch.column(1), table, lower=True, most=RUN_BYTES):
                code, terms = c.coded()
                used = np.flatnonzero(np.bincount(code, minlength=len(terms)))  # the others lie between words
                place = np.zeros(len(terms), np.int64)
                place[used] = np.arange(len(used))
                code, apart = place[code], batch.column(2).slice(c.at, len(c))
                counted = ~np.repeat(apart.to_numpy(zero_copy_only=False).astype(bool), c.counts)
                yield row(2 * number + side, side, batch.column(0).slice(c.at, len(c)), apart, c.counts, c.counts, code, terms.take(pa.array(used)).to_pylist(), np.bincount(code[counted], minlength=len(used)), buckets, inverted)
                number += 1

    return encode


def encoded(docs: DataFrame, is_word: np.ndarray, buckets: int, side: int = 0, inverted: bool = False) -> DataFrame:
    """The runs of docs (doc_id, text, apart): of texts with A-Z lower-cased.

    counts are those of a run's terms in the documents that are not apart.  side tells
    two tables apart.  inverted: the runs have postings for codes.  Null texts have no words.
    """
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "apart").mapInArrow(_encode(is_word, side, buckets, inverted), RUN)


def kept(df: DataFrame, name: str) -> DataFrame:
    """df as a table in the shared folder, with small row groups; shuffle files that nothing reads any more go first."""
    spark, schema, path = df.sparkSession, df.schema, shared_folder(df.sparkSession, name)
    release_shuffles(spark)
    df.write.option("compression", "zstd").option("parquet.block.size", GROUP_BYTES).parquet(path)
    out = spark.read.schema(schema).parquet(path)
    out.stored_at = path
    return out


def pieces_of(runs: DataFrame, *others: str) -> DataFrame:
    zipped = F.arrays_zip(*(c for c in ("buckets", "names", "counts") if c == "buckets" or c in ("names", *others)))
    each = runs.select("run", "side", F.explode(zipped).alias("x"))
    return each.select("run", "side", F.col("x.buckets").alias("bucket"), F.col("x.names").alias("names"), *(F.col(f"x.{c}") for c in others))


def term_names(pieces: list[str]) -> list[str]:
    """The terms of a run's pieces, in the order of its codes."""
    return " ".join(pieces).split(" ") if pieces else []


def _names(column) -> pa.Array:
    return pa.array(" ".join(column.to_pylist()).split(" "), pa.string())


def _counted(table: pa.Table) -> pa.Table:
    """The different terms of a bucket with their counts on both sides."""
    found = _names(table["names"]).dictionary_encode()
    code = found.indices.to_numpy(zero_copy_only=False)
    counts = [np.frombuffer(x, "<i8") for x in table["counts"].to_pylist()]
    side = np.repeat(table["side"].to_numpy(), [len(x) for x in counts])
    n = np.concatenate(counts)
    sums = [np.bincount(code, np.where(side == k, n, 0), len(found.dictionary)).astype(np.int64) for k in (0, 1)]
    return pa.table({"bucket": pa.array(np.full(len(found.dictionary), table["bucket"][0].as_py()), pa.int32()), "term": found.dictionary, "s": pa.array(sums[0]), "t": pa.array(sums[1])})


def dictionary(runs: DataFrame) -> DataFrame:
    """(bucket, term, term_id, s, t): the different terms of all runs and their counts, on side 0 and on side 1."""
    found = pieces_of(runs, "counts").groupBy("bucket").applyInArrow(_counted, "bucket int, term string, s long, t long")
    return kept(found.withColumn("term_id", F.monotonically_increasing_id()), "dictionary")


def _looked_up(names: tuple[str, ...]):
    def look_up(left: pa.Table, right: pa.Table) -> pa.Table:
        if not len(left):
            return pa.table({"of_run": pa.array([], pa.int64()), "bucket": pa.array([], pa.int32()), "values": pa.array([], pa.binary())})
        pieces = left["names"].to_pylist()
        at = pc.index_in(_names(left["names"]), value_set=right["term"].combine_chunks()).to_numpy(zero_copy_only=False).astype(np.int64)
        grid = np.stack([right[c].to_numpy() for c in names]).astype("<i8")[:, at]
        bounds = np.cumsum([0, *(x.count(" ") + 1 for x in pieces)])
        values = [grid[:, a:b].tobytes() for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]
        return pa.table({"of_run": left["run"], "bucket": left["bucket"], "values": pa.array(values, pa.binary())})

    return look_up


def with_facts(runs: DataFrame, facts: DataFrame, names: tuple[str, ...], use, schema: str, side: int | None = None, more: tuple[str, ...] = ()) -> DataFrame:
    """use(a run's row, {name: whole numbers of its terms, in the order of its codes}) for each run.

    facts: (bucket, term and the named columns) of all terms of the runs.  What use gives
    is an Arrow table of the schema.  side: runs of one side only.  more:
    further columns of the runs that use reads.
    """
    runs = runs if side is None else runs.filter(F.col("side") == side)
    back = pieces_of(runs).groupBy("bucket").cogroup(facts.select("bucket", "term", *names).groupBy("bucket")).applyInArrow(_looked_up(names), "of_run long, bucket int, values binary")
    narrow = runs.select("run", "side", "doc_ids", "apart", "n_words", "n_features", "codes", "sizes", *more)

    def together(left: pa.Table, right: pa.Table) -> pa.Table:
        right = right.sort_by("bucket")
        grids = [np.frombuffer(x, "<i8").reshape(len(names), -1) for x in right["values"].to_pylist()]
        grid = np.concatenate(grids, 1) if grids else np.zeros((len(names), 0), np.int64)
        return use({c: left[c][0] for c in left.column_names}, dict(zip(names, grid, strict=True)))

    return narrow.groupBy("run").cogroup(back.groupBy("of_run")).applyInArrow(together, schema)
