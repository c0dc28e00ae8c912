"""Exact removal of repeated word spans by a compacted de Bruijn graph.

Edges of the graph are the k-mers of ``k`` consecutive words.  Naming every edge in a
shuffle would move each word of the corpus many times, so edges are handled in paths:

1.  Nodes.  In every edge one m-mer of words, the least by hash, is its anchor.  The
    edges around one place of an anchor follow each other, and are one short path; its
    digest covers all words of the path.  Where all places of an anchor have one digest,
    the path does not branch: its edges have the same places, and all but the first
    place (by doc_id and word) are repeats of it.
2.  Where the digests of an anchor differ, the graph branches there.  Places with one
    digest are compacted to the first of them; that one's edges are joined with the
    texts by their source coordinates and compared edge by edge.
3.  Every repeat knows the place that it repeats.  Neighbours that repeat neighbours are
    compacted to one long span with one pair of coordinates.
4.  Spans are verified: the source text is read at its coordinates, and its words there
    are compared, by their SHA-256, with those of the repeat when that is cut out.

Before each shuffle a task joins what it knows to be alike, so that a passage that many
documents share arrives as one row for each task and not one for each place.  Digests
have 128 bits, from two independent hashes of the words' bytes.
"""

from __future__ import annotations

import hashlib
import itertools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import words
from .components import forget, stored

WINDOW = 20
#: Words of an anchor; a longer one is rarer by chance, a shorter one gives longer paths.
ANCHOR = 8
#: Places that a task compares at once before the shuffle.
BATCH = 1_000_000

_U = np.uint64
_NULL_ID = -(2**63)
#: Kinds of rows: a repeat; a path to compare edge by edge; the first place of its anchor
#: in a task, with and without others that differ from it there.
REPEAT, BRANCH, FORK, SINGLE = 0, 1, 2, 3
_BITS = 20  # of the length of a run in a packed position
_MOST = (1 << _BITS) - 1


def _prefix(h: np.ndarray, base: int) -> tuple[np.ndarray, np.ndarray]:
    """Running sums of h * base**i, and base**-i, for hashes of runs of words."""
    n = len(h)
    up, down = np.full(max(n, 1), base, _U), np.full(n + 1, pow(base, -1, 1 << 64), _U)
    up[0] = down[0] = 1
    up, down = np.cumprod(up, dtype=_U), np.cumprod(down, dtype=_U)
    total = np.zeros(n + 1, _U)
    np.cumsum(h * up[:n], dtype=_U, out=total[1:])
    return total, down


_BASES = (0xC2B2AE3D27D4EB4F, 0x9FB21C651E98DF25)


def _run_hash(prefix, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    total, down = prefix
    return words.mix((total[b] - total[a]) * down[a])


def anchors(c: words.Chunk, k: int, m: int):
    """(anchor, digest, row, first edge, edges) of the paths of a chunk; positions count from each row's first word."""
    h, first = (c.hashes(half) for half in (0, 1)), c.first
    n = len(c.start)
    if n < k:
        return (np.zeros(0, _U),) * 2 + (np.zeros(0, np.int64),) * 3
    one, two = map(_prefix, h, _BASES)
    at = np.arange(n - m + 1)
    value, place = _run_hash(one, at, at + m), at
    span, width = 1, k - m + 1
    while span < width:  # least of `width` m-mers, the leftmost of equal ones
        step = min(span, width - span)
        take = value[step:] < value[:-step]
        value, place = np.where(take, value[step:], value[:-step]), np.where(take, place[step:], place[:-step])
        span += step
    counts = np.maximum(c.counts - k + 1, 0)
    edge = np.repeat(first[:-1] - (np.cumsum(counts) - counts), counts) + np.arange(int(counts.sum()))
    if not len(edge):
        return (np.zeros(0, _U),) * 2 + (np.zeros(0, np.int64),) * 3
    row = np.repeat(np.arange(len(c)), counts)
    place, value = place[edge], value[edge]
    cut = np.flatnonzero(np.concatenate([[True], (place[1:] != place[:-1]) | (row[1:] != row[:-1])]))
    size = np.diff(np.append(cut, len(edge)))
    start = edge[cut]
    digest = words.mix(_run_hash(two, start, start + size + k - 1) + (place[cut] - start).astype(_U))
    return value[cut], digest, row[cut], start - first[row[cut]], size


def _batch(columns: dict[str, np.ndarray]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(v).view(np.int64)) for v in columns.values()], names=list(columns))


def _alike(key: np.ndarray, other: np.ndarray, doc: np.ndarray, at: np.ndarray):
    """An order by (key, other, doc, place), where a new key begins, and where a new (key, other)."""
    order = np.lexsort((at, doc, other, key))
    key, other = key[order], other[order]
    new_key = np.concatenate([[True], key[1:] != key[:-1]])
    return order, new_key, new_key | np.concatenate([[True], other[1:] != other[:-1]])


def _place(at: np.ndarray, size: np.ndarray, kind) -> np.ndarray:
    """Position, length and kind of a run in one number."""
    return ((at.astype(np.int64) << _BITS | np.minimum(size, _MOST)) << 2) | kind


def _runs(doc: np.ndarray, at: np.ndarray, size: np.ndarray, of: np.ndarray, source: np.ndarray) -> tuple[np.ndarray, ...]:
    """Runs that follow each other in a document, and whose sources (document ``of``, position ``source``) do, joined."""
    if not len(doc):
        return doc, at, size, of, source
    order = np.lexsort((at, doc))
    doc, at, size, of, source = (x[order] for x in (doc, at, size, of, source))
    cut = np.flatnonzero(np.concatenate([[True], (doc[1:] != doc[:-1]) | (at[1:] != (at + size)[:-1]) | (of[1:] != of[:-1]) | (source[1:] - at[1:] != source[:-1] - at[:-1])]))
    total = np.add.reduceat(size, cut)
    if (total > _MOST).any():  # a longer run is several
        return doc, at, size, of, source
    return doc[cut], at[cut], total, of[cut], source[cut]


def _repeats(doc, at, size, of, source) -> dict[str, np.ndarray]:
    """Rows of repeats: the source's document as the digest, its position as a key that differs from document to document."""
    doc, at, size, of, source = _runs(doc, at, size, of, source)
    return {"key": (source + (doc << 32)).view(_U), "digest": of.view(_U), "doc": doc, "place": _place(at, size, REPEAT)}


def _firsts(new: np.ndarray) -> np.ndarray:
    """For each row, the row where its group begins; new marks these."""
    return np.maximum.accumulate(np.where(new, np.arange(len(new)), 0))


def _node_rows(key, digest, doc, at, size) -> list[dict[str, np.ndarray]]:
    """What a task sends of its paths."""
    order, new_key, new_path = _alike(key, digest, doc, at)
    key, digest, doc, at, size = key[order], digest[order], doc[order], at[order], size[order]
    paths = np.add.reduceat(new_path.astype(np.int64), np.flatnonzero(new_key))  # different ones of each anchor
    forked = np.repeat(paths > 1, np.diff(np.append(np.flatnonzero(new_key), len(key))))
    one, branch, rest, first = new_key, new_path & ~new_key, ~new_path, _firsts(new_path)
    return [
        {"key": key[one], "digest": digest[one], "doc": doc[one], "place": _place(at[one], size[one], np.where(forked[one], FORK, SINGLE))},
        {"key": (at[branch] + (doc[branch] << 32)).view(_U), "digest": np.zeros(int(branch.sum()), _U), "doc": doc[branch], "place": _place(at[branch], size[branch], BRANCH)},
        _repeats(doc[rest], at[rest], size[rest], doc[first[rest]], at[first[rest]]),
    ]


def _nodes(k: int, m: int):
    def nodes(batches):
        held, total = [], 0
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            for c in words.chunks(batch.column(1), words.space_split_table()):
                key, digest, row, at, size = anchors(c, k, m)
                held.append((key, digest, ids[c.at + row], at, size))
                total += len(key)
                if total >= BATCH:
                    yield from map(_batch, _node_rows(*map(np.concatenate, zip(*held, strict=True))))
                    held, total = [], 0
        if total:
            yield from map(_batch, _node_rows(*map(np.concatenate, zip(*held, strict=True))))

    return nodes


def _whole_keys(batches):
    """Arrays of the four columns, cut where a key ends; rows come in order of key."""
    rest = None
    for batch in batches:
        if not batch.num_rows:
            continue
        now = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(4)]
        if rest is not None:
            now = [np.concatenate(x) for x in zip(rest, now, strict=True)]
        cut = int(np.searchsorted(now[0], now[0][-1]))
        rest = [x[cut:].copy() for x in now]
        if cut:
            yield [x[:cut] for x in now]
    if rest is not None:
        yield rest


def _compact(batches):
    """Repeats with their sources, and branching paths, from the places of each anchor."""
    for key, digest, doc, place in _whole_keys(batches):
        kind, run = place & 3, place >> 2
        known = kind <= BRANCH
        out = [(doc[known], run[known], kind[known], digest[known], key[known] - (doc[known] << 32))]
        live = ~known
        if live.any():
            key, digest, doc, run, kind = key[live], digest[live], doc[live], run[live], kind[live]
            order, new_key, new_path = _alike(key, digest, doc, run)
            doc, run, kind = doc[order], run[order], kind[order]
            begins = np.flatnonzero(new_key)
            size = np.diff(np.append(begins, len(doc)))
            forked = (np.add.reduceat(new_path.astype(np.int64), begins) > 1) | (np.add.reduceat((kind == FORK).astype(np.int64), begins) > 0)
            branch = new_path & np.repeat(forked, size)
            rest, first = ~new_path, _firsts(new_path)
            of, source = doc[first], run[first] >> _BITS
            out += [(doc[rest], run[rest], np.full(int(rest.sum()), REPEAT), of[rest], source[rest]), (doc[branch], run[branch], np.full(int(branch.sum()), BRANCH), of[branch], source[branch])]
        doc, run, kind, of, source = (np.concatenate(x) for x in zip(*out, strict=True))
        yield _batch({"doc": doc, "run": run, "kind": kind.astype(np.int64), "of": of, "source": source})


def _edges(k: int):
    """Edges of branching paths, read from the texts; alike ones of a task go as the first of them."""

    def edges(batches):
        held, total = [], 0

        def send():
            key, digest, doc, at = map(np.concatenate, zip(*held, strict=True))
            order, _, new = _alike(key, digest, doc, at)
            one, rest, first = order[new], order[~new], order[_firsts(new)][~new]
            return [{"key": key[one], "digest": digest[one], "doc": doc[one], "place": _place(at[one], np.ones(len(one), np.int64), SINGLE)}, _repeats(doc[rest], at[rest], np.ones(len(rest), np.int64), doc[first], at[first])]

        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            runs = batch.column(2)
            offsets = np.asarray(runs.offsets)
            values = runs.values.to_numpy(zero_copy_only=False)
            for c in words.chunks(batch.column(1), words.space_split_table()):
                one, two = map(_prefix, (c.hashes(half) for half in (0, 1)), _BASES)
                span = slice(offsets[c.at], offsets[c.at + len(c)])
                run = values[span]
                row = np.repeat(np.arange(len(c)), np.diff(offsets[c.at : c.at + len(c) + 1]))
                start, size = (run >> _BITS) + c.first[row], run & ((1 << _BITS) - 1)
                at = np.repeat(start - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))
                row = np.repeat(row, size)
                held.append((_run_hash(one, at, at + k), _run_hash(two, at, at + k), ids[c.at + row], at - c.first[row]))
                total += len(at)
                if total >= BATCH:
                    yield from map(_batch, send())
                    held, total = [], 0
        if held:
            yield from map(_batch, send())

    return edges


def _later_edges(batches):
    """Repeats with their sources: all places of an edge but the first."""
    for key, digest, doc, place in _whole_keys(batches):
        kind, run = place & 3, place >> 2
        known = kind == REPEAT
        out = [(doc[known], run[known], digest[known], key[known] - (doc[known] << 32))]
        if not known.all():
            live = ~known
            key, digest, doc, run = key[live], digest[live], doc[live], run[live]
            order, _, new = _alike(key, digest, doc, run)
            rest, first = order[~new], order[_firsts(new)][~new]
            out.append((doc[rest], run[rest], doc[first], run[first] >> _BITS))
        doc, run, of, source = (np.concatenate(x) for x in zip(*out, strict=True))
        yield _batch({"doc": doc, "run": run, "of": of, "source": source})


def _spans(batches):
    """Long spans of each document (doc, repeats as lists of run, of and source)."""
    for batch in batches:
        lists = batch.column(1)
        offsets = np.asarray(lists.offsets)
        run, of, source = (lists.values.field(k).to_numpy(zero_copy_only=False)[offsets[0] : offsets[-1]] for k in ("run", "of", "source"))
        doc = np.repeat(batch.column(0).to_numpy(zero_copy_only=False), np.diff(offsets))
        doc, at, size, of, source = _runs(doc, run >> _BITS, run & _MOST, of, source)
        yield _batch({"doc": doc, "run": at << _BITS | size, "of": of, "source": source << _BITS | size})


def _words_digest(ws: list[bytes], run: int, k: int) -> bytes:
    """SHA-256 of the words that the edges of a run cover."""
    at = run >> _BITS
    return hashlib.sha256(b" ".join(ws[at : at + (run & _MOST) + k - 1])).digest()


def _sources(k: int):
    """Digests of the words at the wanted runs of each text."""

    def read(batches):
        for batch in batches:
            for doc, text, runs in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist(), strict=True):
                ws = (text.as_py() or "").encode("utf-8", "surrogatepass").split()
                digest = [_words_digest(ws, run, k) for run in runs]
                yield pa.RecordBatch.from_arrays([pa.array([doc] * len(runs), pa.int64()), pa.array(runs, pa.int64()), pa.array(digest, pa.binary())], names=["of", "source", "digest"])

    return _joined(read)


def _joined(read):
    """read with its small batches put together."""

    def run(batches):
        held, rows = [], 0
        for batch in read(batches):
            held.append(batch)
            rows += batch.num_rows
            if rows >= 10_000:
                yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
                held, rows = [], 0
        if rows:
            yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]

    return run


def _cut(k: int, with_text: bool):
    def cut(batches):
        for batch in batches:
            counted, removed, digests, texts = [], [], [], []
            for text, spans in zip(batch.column(1), batch.column(2).to_pylist(), strict=True):
                ws = (text.as_py() or "").encode("utf-8", "surrogatepass").split()
                keep = bytearray(b"\1") * len(ws)
                for run, digest in ((x["run"], x["digest"]) for x in spans or ()):
                    if _words_digest(ws, run, k) == digest:  # the source's words
                        at, to = run >> _BITS, (run >> _BITS) + (run & _MOST) + k - 1
                        keep[at:to] = bytes(to - at)
                lost = len(ws) - sum(keep)
                left = b" ".join(itertools.compress(ws, keep) if lost else ws)
                counted.append(len(ws))
                removed.append(lost)
                digests.append(hashlib.sha256(left).hexdigest())
                if with_text:
                    texts.append(left.decode("utf-8", "replace"))
            out = {"doc_id": batch.column(0), "n_words": pa.array(counted, pa.int64()), "n_removed": pa.array(removed, pa.int64()), "kept_sha256": pa.array(digests, pa.string())}
            if with_text:
                out["kept_text"] = pa.array(texts, pa.string())
            yield pa.RecordBatch.from_arrays(list(out.values()), names=list(out))

    return cut


def numbered(docs: DataFrame, dense: bool = False) -> DataFrame:
    """docs (doc_id, text and others) with doc, a number of each row of its own in order of doc_id, null first.

    Distinct ids are their own numbers, unless dense asks for numbers from 0 on.  Rows that share an id are put in order by a
    digest of their texts, then as they are read: the whole table is dealt out by ranges
    of that order and stored, so that a row keeps its number, and no id or text has to
    fit one task.
    """
    if not dense and not docs.groupBy("doc_id").agg(F.count("*").alias("n")).filter("n > 1").limit(1).count():
        return docs.withColumn("doc", F.coalesce(F.col("doc_id").cast("long"), F.lit(_NULL_ID)))
    placed = docs.withColumn("_read", F.monotonically_increasing_id()).orderBy("doc_id", F.md5("text"), "_read").drop("_read")
    row = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    placed = stored(placed.withColumns({"_task": F.spark_partition_id(), "_row": row}), "numbered")
    before, shifts = 0, []
    for task, n in sorted(placed.groupBy("_task").agg(F.count("*")).collect()):
        shifts.append((task, before))
        before += n
    shift = docs.sparkSession.createDataFrame(shifts, "_task int, _before long")
    return placed.join(F.broadcast(shift), "_task").withColumn("doc", F.col("_row") + F.col("_before")).drop("_task", "_row", "_before")


def remove_repeats(docs: DataFrame, window: int = WINDOW, anchor: int = ANCHOR, with_text: bool = False) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 (and kept_text) of each row.

    Null and empty texts have no words.  Rows that share an id (null is one) are documents
    of their own, as any others.  A text shorter than the window loses nothing.  Other
    columns are left out.
    """
    texts = numbered(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"))
    rows = "key long, digest long, doc long, place long"
    by_key = lambda df: df.repartition("key").sortWithinPartitions("key")
    repeat = "doc long, run long, of long, source long"
    found = stored(by_key(texts.select("doc", "text").mapInArrow(_nodes(window, anchor), rows)).mapInArrow(_compact, "doc long, run long, kind long, of long, source long"), "paths")
    branching = found.filter(F.col("kind") == BRANCH).groupBy("doc").agg(F.collect_list("run").alias("runs"))
    edges = by_key(texts.join(branching, "doc").select("doc", "text", "runs").mapInArrow(_edges(window), rows)).mapInArrow(_later_edges, repeat)
    repeats = found.filter(F.col("kind") == REPEAT).select("doc", "run", "of", "source").unionByName(edges)
    each = repeats.groupBy("doc").agg(F.collect_list(F.struct("run", "of", "source")).alias("r"))
    spans = stored(each.mapInArrow(_spans, repeat), "spans")
    forget(found)
    # The words at the sources, once for each different one, go to the spans.  Both joins with the texts read one shuffle.
    wanted = spans.select("of", "source").distinct().groupBy(F.col("of").alias("doc")).agg(F.collect_list("source").alias("x"))
    at_source = texts.join(wanted, "doc").select("doc", "text", "x", "doc_id").mapInArrow(_sources(window), "of long, source long, digest binary")
    known = spans.join(at_source, ["of", "source"]).groupBy("doc").agg(F.collect_list(F.struct("run", "digest")).alias("x"))
    kind = "doc_id long, n_words long, n_removed long, kept_sha256 string" + (", kept_text string" if with_text else "")
    return texts.join(known, "doc", "left").select("doc_id", "text", "x", "doc").mapInArrow(_cut(window, with_text), kind)


def op3_substring(spark, sf_dir: str) -> DataFrame:
    """remove_repeats of documents, which says how nulls, repeated rows and empty tables are taken."""
    return remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"))
