"""Packing of token streams into sequences by order-preserving dynamic programming.

Documents are taken in order of doc_id, each followed by an end id, as one stream.  A
sequence is a window of the stream of at most ``length`` ids.  Windows may be cut after
a document, after a sentence, or, where neither is near, anywhere; the cuts minimise

    padding + cut penalties + a cost for each sequence,

where a window is padded to ``length`` unless it has a power of two of ids.  With
f(j) the least cost of the stream up to cut j and p its position,

    f(j) = penalty(j) + cost + min over i with p(j) - p(i) <= length of f(i) + p(i)  + length - p(j),

which is a sliding minimum: a queue of increasing f + p gives it in constant time for
each cut.  Windows of a power of two of ids are further transitions.

The stream is dealt out by ranges of doc_id (and of texts within one id), and each range is packed in blocks of
about BLOCK_IDS ids that end with a document; a block is all that a task holds.
"""

from __future__ import annotations

import zlib
from collections import deque

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import tokens

LENGTH = 2048
END_ID = 1
BLOCK_IDS = 1 << 20
#: Cost, in padded ids, of a cut after a sentence, of any other cut in a document, and of a sequence.
SENTENCE_CUT, WORD_CUT, SEQUENCE = 8, 64, 4
#: Where no document or sentence ends for so many ids, cuts are allowed at every STEP ids.
GAP, STEP = 256, 32


def cut_places(is_end: np.ndarray, document_ends: np.ndarray, n: int, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions where the stream may be cut, 0 and n among them, and the penalty of each."""
    gap, step = min(GAP, max(1, length // 8)), min(STEP, max(1, length // 64))
    natural = np.union1d(np.flatnonzero(is_end) + 1, np.concatenate([[0], document_ends, [n]]))
    wide = np.flatnonzero(np.diff(natural) > gap)
    filled = [np.arange(natural[i] + step, natural[i + 1], step) for i in wide.tolist()]
    places = np.unique(np.concatenate([natural, *filled])).astype(np.int64)
    penalty = np.full(len(places), WORD_CUT, np.int64)
    penalty[np.searchsorted(places, natural)] = SENTENCE_CUT
    penalty[np.searchsorted(places, document_ends)] = 0
    penalty[0] = penalty[-1] = 0
    return places, penalty


def best_cuts(places: np.ndarray, penalty: np.ndarray, length: int = LENGTH) -> list[int]:
    """Indices into places of the cuts of least cost, first and last included."""
    powers = [1 << k for k in range(length.bit_length()) if 1 << k < length]
    last = len(places) - 1
    exact: dict[int, list[int]] = {}
    for size in powers:
        i = np.searchsorted(places, places - size)
        ok = places[i] == places - size
        if size < 64:
            ok[:-1] = False  # the shortest windows are only of use for what is left at the end
        for j in np.flatnonzero(ok).tolist():
            exact.setdefault(j, []).append(int(i[j]))
    at, fee = places.tolist(), penalty.tolist()
    cost, back = [0] * len(at), [0] * len(at)
    queue, low = deque([0]), [0] * len(at)  # low: cost + position
    full = length + SEQUENCE
    for j in range(1, len(at)):
        p = at[j]
        oldest = p - length
        while at[queue[0]] < oldest:
            queue.popleft()
        i = queue[0]
        best = low[i] - p + full
        if j in exact:
            for k in exact[j]:
                if cost[k] + SEQUENCE < best:
                    best, i = cost[k] + SEQUENCE, k
        cost[j] = best = best + fee[j]
        back[j] = i
        low[j] = best = best + p
        while queue and low[queue[-1]] >= best:
            queue.pop()
        queue.append(j)
    cuts = [last]
    while cuts[-1]:
        cuts.append(back[cuts[-1]])
    return cuts[::-1]


def _block(doc_ids: pa.Array, ids: np.ndarray, ends: np.ndarray, is_end: np.ndarray, length: int, number: int, with_ids: bool) -> tuple[pa.RecordBatch, int]:
    """The pieces of a block of documents; ends: where each document's ids, end id included, end."""
    n = len(ids)
    places, penalty = cut_places(is_end[ids], ends, n, length)
    cuts = places[best_cuts(places, penalty, length)]
    bounds = np.union1d(cuts, ends)
    a, b = np.concatenate([[0], bounds[bounds > 0][:-1]]), bounds[bounds > 0]
    sequence = np.searchsorted(cuts, a, "right") - 1
    document = np.searchsorted(ends, a, "right")
    begins = np.concatenate([[0], ends[:-1]])
    wide = ids.astype("<u4")
    crc = np.fromiter((zlib.crc32(wide[i:j]) for i, j in zip(a.tolist(), b.tolist(), strict=True)), np.int64, len(a))
    columns = {
        "doc_id": doc_ids.take(pa.array(document)), "start": pa.array(a - begins[document]), "length": pa.array(b - a), "ids_crc32": pa.array(crc),
        "doc_tokens": pa.array((ends - begins)[document]), "sequence_id": pa.array(sequence + number), "offset": pa.array(a - cuts[sequence]),
    }
    if with_ids:
        columns["ids"] = pa.ListArray.from_arrays(pa.array(np.append(a, n), pa.int32()), pa.array(wide.view(np.int32)))
    return pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns)), number + len(cuts) - 1


def _packer(length: int, path: str | None, with_ids: bool):
    def pack_batches(batches):
        made = tokens.encoder(path)
        is_end = made.sentence_ends().copy()
        is_end[END_ID] = False  # documents' ends are known
        number = TaskContext.get().partitionId() << 40
        held: list[tuple[pa.Array, np.ndarray, np.ndarray]] = []
        total = 0

        def flush():
            nonlocal number, total, held
            starts = np.cumsum([0, *(len(x[1]) for x in held)])
            ends = np.concatenate([x[2] + s for x, s in zip(held, starts, strict=False)])
            out, number = _block(pa.concat_arrays([x[0] for x in held]), np.concatenate([x[1] for x in held]), ends, is_end, length, number, with_ids)
            held, total = [], 0
            return out

        for batch in batches:
            doc_ids = batch.column(0)
            for at, ids, edges in tokens.encoded(batch.column(1), path):
                ids = np.insert(ids, edges[1:], END_ID)
                ends = edges[1:] + np.arange(1, len(edges))
                held.append((doc_ids.slice(at, len(ends)), ids, ends))
                total += len(ids)
                if total >= BLOCK_IDS:
                    yield flush()
        if held:
            yield flush()

    return pack_batches


def pack(docs: DataFrame, length: int = LENGTH, path: str | None = None, with_ids: bool = False) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset (and ids) of each piece.

    Null and empty texts have the end id only.  Null ids come first; rows that share an
    id are documents of their own, in order of a hash of their texts, then as they are
    read, and are dealt out by ranges of all three: no id has to fit one task.  A text longer than a
    sequence is cut; a text longer than a block is a block.  Other columns are left out.
    """
    order = ("doc_id", "hash", "read")
    placed = docs.select("doc_id", "text", F.xxhash64("text").alias("hash"), F.monotonically_increasing_id().alias("read"))
    ordered = placed.repartitionByRange(*order).sortWithinPartitions(*order).select("doc_id", "text")
    kind = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
    return ordered.mapInArrow(_packer(length, path, with_ids), kind + (", ids array<int>" if with_ids else ""))


def op1_pack(spark, sf_dir: str) -> DataFrame:
    """pack of documents; nulls, repeats and long texts: as pack has them.  An empty table gives no rows."""
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the sequences, with their ids; every row is packed, as pack says."""
    return pack(docs, with_ids=True)
