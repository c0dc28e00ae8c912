"""SimHash fingerprints and their exact near pairs by vantage-point trees.

Two 64-bit fingerprints that differ in at most 2 bits differ in at most 1 bit in one of
their two 32-bit halves.  For each half there is a vantage-point tree under the Hamming
distance of that half: a node splits points by their distance to a vantage point, and a
point is looked up within radius 1, so that only a point on the boundary (distance
equal to the radius of the ball, or one more) is looked up on both sides.

The upper levels of each tree are made on the driver from a bounded number of vantage
points (constants; they depend on no data) and route fingerprints to shards; a boundary
point is a guest in each shard that its ball of radius 1 reaches.  In a shard the tree
goes on to leaves, where guests and residents are compared in all 64 bits.  Pairs are not
listed: a shard joins linked fingerprints at once and returns, for each fingerprint, the
least one that it reached there.  Distinct fingerprints only go in, so that a group of
copies is one point and a point has at most 2080 others within 2 bits.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import words
from .components import as_row, checkpointed, components, from_row

#: Differing bits of a link, and words of a shingle.
BITS = 2
SHINGLE = 3
#: Levels of a tree above its shards: these at least, and as many as give shards of SHARD points.
LEVELS = 6
SHARD = 50_000
LEAF = 64

_U = np.uint64
_POW = np.uint64(1) << np.arange(64, dtype=np.uint64)


def fingerprint(shingle_hashes: np.ndarray) -> int:
    """Bits set in over half of the hashes; zero for none."""
    n = len(shingle_hashes)
    if not n:
        return 0
    ones = np.zeros(64, np.int64)
    for a in range(0, n, 1 << 16):
        part = shingle_hashes[a : a + (1 << 16)]
        ones += np.unpackbits(part.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(_POW[2 * ones > n].sum(dtype=_U))


def _shingle_hashes(ws: list[bytes], width: int) -> np.ndarray:
    text = b" ".join(ws)
    n = max(1, len(ws) - width + 1)
    sizes = np.fromiter(map(len, ws), np.int64, len(ws))
    ends = np.cumsum(sizes + 1) - 1
    starts = ends - sizes
    last = ends[min(width, len(ws)) - 1 :]
    hashed = xxhash.xxh64_intdigest
    return np.fromiter((hashed(text[a:b], 42) for a, b in zip(starts[:n].tolist(), last.tolist(), strict=True)), _U, n)


def _fingerprints(width: int):
    def scan(batches):
        fold = bytes(words.lower_table())
        for batch in batches:
            at = batch.schema.get_field_index("text")
            data, offsets = words.string_buffers(batch.column(at))
            out = np.zeros(batch.num_rows, _U)
            for i, (a, b) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)):
                ws = data[a:b].tobytes().translate(fold).split()
                out[i] = fingerprint(_shingle_hashes(ws, width)) if ws else 0
            keep = [i for i in range(batch.num_columns) if i != at]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in keep), pa.array(out.view(np.int64))], names=[*(batch.schema.names[i] for i in keep), "fp"])

    return scan


def fingerprints(docs: DataFrame, width: int = SHINGLE, more: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, more, fp): the signed 64-bit fingerprint of each row's text."""
    kept = ["doc_id", *more]
    kind = "".join(f"{c} {docs.schema[c].dataType.simpleString()}, " for c in kept)
    return docs.select(*kept, "text").mapInArrow(_fingerprints(width), kind + "fp long")


def _half(fps: np.ndarray, which: int) -> np.ndarray:
    return (fps >> _U(32) if which else fps & _U(0xFFFFFFFF)).astype(np.uint32)


def _distance(a: np.ndarray, b) -> np.ndarray:
    return np.bitwise_count(a ^ b)


def _vantages(levels: int) -> np.ndarray:
    """Vantage points of the upper levels, one for each node of each half."""
    return np.random.default_rng(7).integers(0, 1 << 32, (2, 1 << levels), dtype=np.uint32)


#: Radius of the balls of the upper levels: the middle distance of two random halves.
RADIUS = 15


def _route(fps: np.ndarray, which: int, levels: int = LEVELS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(point, shard, is resident) for all shards that each point's ball of radius 1 reaches."""
    half, vantage = _half(fps, which), _vantages(levels)[which]
    point, node, home = np.arange(len(fps)), np.ones(len(fps), np.int64), np.ones(len(fps), bool)
    for _ in range(levels):
        d = _distance(half[point], vantage[node])
        inside, outside = d <= RADIUS + 1, d >= RADIUS  # reached by the ball of radius 1
        is_in = d <= RADIUS
        point, node, home = (np.concatenate(x) for x in zip((point[inside], 2 * node[inside], home[inside] & is_in[inside]), (point[outside], 2 * node[outside] + 1, home[outside] & ~is_in[outside]), strict=True))
    return point, node - (1 << levels), home


def _router(levels: int):
    def routed(batches):
        for batch in batches:
            fps = batch.column(0).to_numpy(zero_copy_only=False).view(_U)
            for a in range(0, len(fps), 4096):
                for which in (0, 1):
                    part = fps[a : a + 4096]
                    point, shard, home = _route(part, which, levels)
                    yield pa.RecordBatch.from_arrays([pa.array(part[point].view(np.int64)), pa.array(2 * shard + which), pa.array(home)], names=["fp", "shard", "home"])

    return routed


class Union:
    """Sets of points; the least point of a set is its root."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def root(self, i: int) -> int:
        up = self.up
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return i

    def join(self, i: int, j: int) -> None:
        i, j = self.root(i), self.root(j)
        if i != j:
            self.up[max(i, j)] = min(i, j)


def linked(fps: np.ndarray, which: int, home: np.ndarray, union: Union, bits: int = BITS) -> None:
    """Joins all points and residents of a shard that differ in at most ``bits`` bits.

    fps are distinct.  Every linked pair whose halves differ in at most 1 bit is met, as
    one of the pair is looked up in the leaf where the other is a resident.
    """
    half = _half(fps, which)
    stack = [(np.flatnonzero(home), np.arange(len(fps)), 0)]
    random = np.random.default_rng(11)
    while stack:
        residents, guests, stuck = stack.pop()
        if not len(residents) or not len(guests):
            continue
        if len(residents) > LEAF and stuck < 8:
            v = half[residents[random.integers(len(residents))]] ^ np.uint32(random.integers(0, 1 << 32) if stuck % 2 == 0 else 0)
            d, g = _distance(half[residents], v), _distance(half[guests], v)
            radius = int(np.sort(d)[(len(d) - 1) // 2])
            if (d <= radius).all():
                radius -= 1
            inside = d <= radius
            if inside.any() and not inside.all():
                stack.append((residents[inside], guests[g <= radius + 1], 0))
                stack.append((residents[~inside], guests[g >= radius], 0))
            else:
                stack.append((residents, guests, stuck + 1))
            continue
        if len(residents) > 4096:
            _probe(fps, residents, guests, union, bits)
            continue
        for a in range(0, len(guests), 4096):
            part = guests[a : a + 4096]
            x, y = np.nonzero(_distance(fps[part][:, None], fps[residents][None, :]) <= bits)
            for i, j in zip(part[x].tolist(), residents[y].tolist(), strict=True):
                if i != j:
                    union.join(i, j)


def _probe(fps: np.ndarray, residents: np.ndarray, guests: np.ndarray, union: Union, bits: int) -> None:
    """Links in a leaf that no vantage point splits: the points around each are looked up."""
    own = np.sort(fps[residents])
    order = residents[np.argsort(fps[residents])]
    flips = [_U(0), *_POW] if bits else [_U(0)]
    if bits >= 2:
        flips += [a | b for k, a in enumerate(_POW) for b in _POW[:k]]
    for flip in flips:
        wanted = fps[guests] ^ flip
        at = np.minimum(np.searchsorted(own, wanted), len(own) - 1)
        for i, j in zip(guests[own[at] == wanted].tolist(), order[at[own[at] == wanted]].tolist(), strict=True):
            union.join(i, j)


def _shard_links(batches):
    """Least fingerprint that each reaches in its shard, of shards in order; single ones are left out."""
    held: list[tuple[np.ndarray, np.ndarray]] = []
    current = None

    def close():
        fps, home = (np.concatenate([x[k] for x in held]) for k in (0, 1))
        union = Union(len(fps))
        linked(fps, current % 2, home, union)
        root = np.fromiter((union.root(i) for i in range(len(fps))), np.int64, len(fps))
        other = np.flatnonzero(root != np.arange(len(fps)))
        return pa.RecordBatch.from_arrays([pa.array(fps[other].view(np.int64)), pa.array(fps[root[other]].view(np.int64))], names=["a", "b"])

    for batch in batches:
        fp, shard, home = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(3))
        cuts = [0, *(np.flatnonzero(np.diff(shard)) + 1).tolist(), len(shard)]
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            if a == b:
                continue
            if current is not None and shard[a] != current:
                yield close()
                held = []
            current = int(shard[a])
            held.append((fp[a:b].view(_U).copy(), home[a:b].copy()))
    if held:
        yield close()


def links(distinct: DataFrame) -> DataFrame:
    """(a, b): linked distinct fingerprints, at most one edge of each for each shard."""
    levels = max(LEVELS, (distinct.count() // SHARD).bit_length())
    routed = distinct.select("fp").mapInArrow(_router(levels), "fp long, shard long, home boolean")
    return routed.repartition("shard").sortWithinPartitions("shard", "fp").mapInArrow(_shard_links, "a long, b long").distinct()


def _named(own: DataFrame, least) -> DataFrame:
    """(fp, least, component) of the distinct fingerprints of own; the component is named by a fingerprint."""
    distinct = checkpointed(own.groupBy("fp").agg(F.min(least).alias("least")))
    found = components(links(distinct))
    return distinct.join(found.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "least", F.coalesce("component", "fp").alias("component"))


def groups(docs: DataFrame, width: int = SHINGLE) -> DataFrame:
    """(doc_id, fp, component_id) of each row.

    Null texts and texts without words have fingerprint zero, which links like any other.
    Repeated rows have repeated results; a null doc_id is never a component's id unless
    the component has no other.  Other columns are left out.
    """
    own = checkpointed(fingerprints(docs, width))
    named = _named(own, F.col("doc_id"))
    # The smallest doc_id of a component is its id.
    smallest = named.groupBy("component").agg(F.min("least").alias("component_id"))
    of = named.join(smallest, "component").select("fp", "component_id")
    return own.join(of, "fp").select("doc_id", "fp", "component_id")


def op8_simhash(spark, sf_dir: str) -> DataFrame:
    """groups of documents; nulls, repeats and empty texts: as groups has them.  An empty table gives no rows."""
    found = groups(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group: one with the smallest doc_id (null only if there is no other), by a digest of the text among those that share it."""
    digest = [F.xxhash64("text").alias("k1"), F.xxhash64(F.lit(1), "text").alias("k2")]
    own = checkpointed(fingerprints(docs.select("doc_id", "text", *digest), more=("k1", "k2")))
    rank = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), "k1", "k2")
    best = _named(own, rank).groupBy("component").agg(F.min("least").alias("b")).select("b.id", "b.k1", "b.k2")
    every = docs.select(F.col("doc_id").alias("id"), *digest, F.struct("text", as_row(docs)).alias("x"))
    same = every["id"].eqNullSafe(best["id"]) & (every["k1"] == best["k1"]) & (every["k2"] == best["k2"])
    once = every.join(best, same, "left_semi").groupBy("id", "k1", "k2").agg(F.min("x").alias("x"))
    return once.select(*from_row(docs, {}, "x.row"))
