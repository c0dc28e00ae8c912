"""Preranked set test: enrichment scores, permutations, adjusted p-values.

scores: (contrast, key, score); pathways: (pathway, key).  Keys are ranked by falling
score, ties by key.  The running sum rises at a set's keys by |score|**p, scaled to 1 in
all, and falls evenly at the others; the enrichment score is its extreme.  It is only
worked out at the keys of the sets: in front of and behind each.  Ranks are made over
ranges of the order, so that a contrast is not one task.

Random sets of all sizes come from one random order of keys for each permutation: its
first m keys are a random set of size m, so one permutation gives the extremes of every
size (Sergushichev 2016).  Weights are kept in pieces by rank and come to the draws piece
by piece: no task and no row holds a contrast.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .lineage import sent, settled
from .ranks import number_within


@dataclass(frozen=True)
class SetTest:
    """Bounds of set sizes, permutations, weight of scores and seed."""

    min_size: int = 5
    max_size: int = 500
    nperm: int = 10_000
    param: float = 1.0
    seed: int = 1


def hits(scores: DataFrame, pathways: DataFrame, test: SetTest = SetTest()) -> DataFrame:
    """(contrast, pathway, key, size, before, after): the running sum before and after each key of a set."""
    known = scores.filter("score IS NOT NULL")
    ranked = number_within(known, "rank", "contrast", F.desc("score"), F.asc("key"))
    n = sent(known.groupBy("contrast").agg(F.count("*").alias("n")))
    found = ranked.join(pathways.distinct(), "key").withColumn("r", F.pow(F.abs("score"), F.lit(test.param)))
    # Sets are counted first: the windows below see sets of fitting size only.
    sizes = found.groupBy("contrast", "pathway").agg(F.count("*").alias("size")).join(n, "contrast")
    sizes = sizes.filter(F.col("size").between(test.min_size, test.max_size) & (F.col("size") < F.col("n")))
    whole = Window.partitionBy("contrast", "pathway")
    order = whole.orderBy("rank").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    fit = found.join(sizes, ["contrast", "pathway"]).withColumns({"all": F.sum("r").over(whole), "upto": F.sum("r").over(order), "k": F.count("*").over(order)})
    falls = (F.col("rank") - F.col("k")) / (F.col("n") - F.col("size"))
    share = lambda x: F.when(F.col("all") > 0, x / F.col("all")).otherwise(F.lit(0.0))
    return fit.select("contrast", "pathway", "key", "rank", "size", "n", (share(F.col("upto") - F.col("r")) - falls).alias("before"), (share(F.col("upto")) - falls).alias("after"))


def enrichment(hits: DataFrame) -> DataFrame:
    """(contrast, pathway, size, n, es)."""
    ends = hits.groupBy("contrast", "pathway", "size", "n").agg(F.max("after").alias("high"), F.min("before").alias("low"))
    return ends.select("contrast", "pathway", "size", "n", F.when(F.col("high") >= -F.col("low"), F.col("high")).otherwise(F.col("low")).alias("es"))


def leading_edge(hits: DataFrame) -> DataFrame:
    """(contrast, pathway, key): keys up to the extreme of a positive score, or from it on for a negative one."""
    whole = Window.partitionBy("contrast", "pathway")
    ends = hits.withColumns({"high": F.max("after").over(whole), "low": F.min("before").over(whole)})
    at = ends.withColumns({"top": F.min(F.when(F.col("after") == F.col("high"), F.col("rank"))).over(whole), "bottom": F.max(F.when(F.col("before") == F.col("low"), F.col("rank"))).over(whole)})
    up = F.col("high") >= -F.col("low")
    return at.filter((up & (F.col("rank") <= F.col("top"))) | (~up & (F.col("rank") >= F.col("bottom")))).select("contrast", "pathway", "key")


def random_orders(rng, n: int, size: int, count: int) -> np.ndarray:
    """count times the first size numbers of a random order of n.

    Short ones are drawn with repeats and drawn again if they have any, so that memory
    follows from what is drawn and not from n.
    """
    if size * size > n:
        return np.stack([rng.permutation(n)[:size] for _ in range(count)])
    picked = rng.integers(0, n, (count, size))
    while len(again := np.flatnonzero((np.diff(np.sort(picked, 1), axis=1) == 0).any(1))):
        picked[again] = rng.integers(0, n, (len(again), size))
    return picked


def prefix_scores(rank: np.ndarray, weight: np.ndarray, n: int, sizes: np.ndarray) -> np.ndarray:
    """(len(sizes), orders): the enrichment score of the first m keys of each order, for every m of sizes.

    rank: the keys' ranks from 0 in the order in which they are drawn; weight: theirs.
    The keys of all sizes are sorted once; those of a smaller size are marked among them.
    """
    order = np.argsort(rank, axis=1)
    ranks, weights = np.take_along_axis(rank, order, 1).astype(float), np.take_along_axis(weight, order, 1)
    out = np.empty((len(sizes), len(rank)))
    for i, m in enumerate(sizes.tolist()):
        mine = order < m
        r = weights * mine
        up = np.cumsum(r, 1)
        total = up[:, -1:]
        share = np.where(total > 0, 1 / np.where(total > 0, total, 1), 0)
        falls = (ranks - (np.cumsum(mine, 1) - mine)) / (n - m)
        after = up * share - falls
        before = np.where(mine, after - r * share, np.inf).min(1)
        after = np.where(mine, after, -np.inf).max(1)
        out[i] = np.where(after >= -before, after, before)
    return out


#: Keys of a stored piece of a contrast's weights, and permutations that are worked out together.
PIECE, PERMUTATIONS = 1 << 16, 250


def _weight_piece(table: pa.Table) -> pa.Table:
    table = table.sort_by("rank")
    return pa.table({"contrast": table["contrast"][:1], "piece": table["piece"][:1], "weights": pa.array([table["w"].to_numpy().astype("<f8").tobytes()], pa.binary())})


def weight_pieces(scores: DataFrame, test: SetTest = SetTest(), piece_size: int = PIECE) -> DataFrame:
    """(contrast, piece, weights): |score|**p by falling score, packed, so many keys of a contrast in a row."""
    known = scores.filter("score IS NOT NULL").select("contrast", "key", "score")
    ranked = number_within(known, "rank", "contrast", F.desc("score"), F.asc("key"))
    placed = ranked.select("contrast", (F.col("rank") - 1).alias("rank"), F.pow(F.abs("score"), F.lit(test.param)).alias("w")).withColumn("piece", F.floor(F.col("rank") / piece_size))
    return placed.groupBy("contrast", "piece").applyInArrow(_weight_piece, "contrast string, piece long, weights binary")


_DRAWN = "contrast string, piece long, perm_block long, n long, sizes array<int>, at binary, place binary"


def _draw(test: SetTest, block: int, piece_size: int):
    """The ranks of a block's orders, by piece; at: which order and place of it each is."""

    def draw(batches):
        for batch in batches:
            for contrast, number, n, sizes in zip(*(batch[c].to_pylist() for c in ("contrast", "perm_block", "n", "sizes")), strict=True):
                count, most = min(block, test.nperm - number * block), max(sizes)
                digest = int.from_bytes(hashlib.sha256(contrast.encode()).digest()[:8], "big")
                ranks = random_orders(np.random.default_rng((test.seed, digest, number)), n, most, count).ravel()
                order = np.argsort(ranks // piece_size, kind="stable")
                pieces, first = np.unique(ranks[order] // piece_size, return_index=True)
                for piece, at in zip(pieces.tolist(), np.split(order, first[1:]), strict=True):
                    values = (contrast, piece, number, n, sizes, at.astype("<i4").tobytes(), (ranks[at] % piece_size).astype("<i4").tobytes())
                    kinds = (pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int32()), pa.binary(), pa.binary())
                    yield pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(values, kinds, strict=True)], names=["contrast", "piece", "perm_block", "n", "sizes", "at", "place"])

    return draw


def _weigh(left: pa.Table, right: pa.Table) -> pa.Table:
    """Draws from a piece with the weights at their places."""
    weights = np.frombuffer(right["weights"][0].as_py(), "<f8") if len(right) else np.zeros(0)
    drawn = [weights[np.frombuffer(x, "<i4")].tobytes() for x in left["place"].to_pylist()]
    named = {"of_contrast": left["contrast"], "of_piece": left["piece"]} | {c: left[c] for c in ("perm_block", "n", "sizes", "at", "place")}
    return pa.table(named | {"weight": pa.array(drawn, pa.binary())})


def _null(block: int, piece_size: int):
    """The scores of a block's orders, for all sizes."""

    def null(table: pa.Table) -> pa.Table:
        at = np.concatenate([np.frombuffer(x, "<i4") for x in table["at"].to_pylist()])
        rank = np.concatenate([np.frombuffer(x, "<i4").astype(np.int64) + p * piece_size for x, p in zip(table["place"].to_pylist(), table["of_piece"].to_pylist(), strict=True)])
        weight = np.concatenate([np.frombuffer(x, "<f8") for x in table["weight"].to_pylist()])
        sizes = np.array(table["sizes"][0].as_py())
        ranks, weights = np.empty(len(at), np.int64), np.empty(len(at))
        ranks[at], weights[at] = rank, weight
        found = prefix_scores(ranks.reshape(-1, sizes.max()), weights.reshape(-1, sizes.max()), table["n"][0].as_py(), sizes)
        orders = found.shape[1]
        perm = np.tile(np.arange(orders), len(sizes)) + table["perm_block"][0].as_py() * block
        return pa.table({"contrast": pa.array([table["of_contrast"][0].as_py()] * found.size, pa.string()), "size": pa.array(np.repeat(sizes, orders), pa.int64()), "perm": pa.array(perm), "null": pa.array(found.ravel())})

    return null


def null_scores(scores: DataFrame, sizes: DataFrame, test: SetTest = SetTest(), block: int = PERMUTATIONS, piece_size: int = PIECE) -> DataFrame:
    """(contrast, size, perm, null): random scores for each contrast and each of its set sizes (contrast, size), test.nperm of each.

    What is shuffled are the draws, test.max_size or fewer for each permutation, and the
    weights once.  Sizes must be smaller than their contrasts.
    """
    known = scores.filter("score IS NOT NULL")
    weights = weight_pieces(scores, test, piece_size)
    wanted = sizes.groupBy("contrast").agg(F.sort_array(F.collect_set(F.col("size").cast("int"))).alias("sizes"))
    n = known.groupBy("contrast").agg(F.count("*").alias("n"))
    blocks = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(-(-test.nperm // block) - 1).cast("long"))).alias("perm_block")
    jobs = n.join(wanted, "contrast").select("contrast", "n", "sizes", blocks).repartition("contrast", "perm_block")
    drawn = jobs.mapInArrow(_draw(test, block, piece_size), _DRAWN)
    met = drawn.groupBy("contrast", "piece").cogroup(weights.groupBy("contrast", "piece")).applyInArrow(_weigh, "of_contrast string, of_piece long, perm_block long, n long, sizes array<int>, at binary, place binary, weight binary")
    return met.groupBy("of_contrast", "perm_block").applyInArrow(_null(block, piece_size), "contrast string, size long, perm long, null double")


def null_summary(null: DataFrame) -> DataFrame:
    """(contrast, size, sign, sets, mean, low, high) of random scores: their number, mean and bounds on either side of 0."""
    sign = F.when(F.col("null") >= 0, 1).otherwise(-1)
    return null.groupBy("contrast", "size", sign.alias("sign")).agg(F.count("*").alias("sets"), F.avg("null").alias("mean"), F.min("null").alias("low"), F.max("null").alias("high"))


def adjusted(p_values: DataFrame, *by: str) -> DataFrame:
    """padj added: Benjamini-Hochberg over the rows of each group; ties get one value."""
    whole = Window.partitionBy(*by)
    ranked = p_values.withColumns({"_n": F.count("pval").over(whole), "_rank": F.count("pval").over(whole.orderBy("pval").rangeBetween(Window.unboundedPreceding, Window.currentRow))})
    least = F.min(F.col("pval") * F.col("_n") / F.col("_rank")).over(whole.orderBy("pval").rangeBetween(Window.currentRow, Window.unboundedFollowing))
    return ranked.withColumn("padj", F.least(F.lit(1.0), least)).drop("_n", "_rank")


def set_test(scores: DataFrame, pathways: DataFrame, test: SetTest = SetTest()) -> DataFrame:
    """(contrast, pathway, size, es, nes, pval, padj, n_more_extreme, leading_edge) of the sets of fitting size."""
    scores = settled(scores)
    found = settled(hits(scores, pathways, test))
    es = settled(enrichment(found))
    null = null_scores(scores, es.select("contrast", "size"), test)
    same = (F.col("null") >= 0) == (F.col("es") >= 0)
    more = F.when(F.col("es") >= 0, F.col("null") >= F.col("es")).otherwise(F.col("null") <= F.col("es"))
    counted = es.join(null, ["contrast", "size"]).groupBy("contrast", "pathway", "size", "es").agg(F.count_if(same).alias("same"), F.count_if(same & more).alias("n_more_extreme"), F.avg(F.when(same, F.abs("null"))).alias("mean"))
    p = counted.select("contrast", "pathway", "size", "es", (F.col("es") / F.col("mean")).alias("nes"), ((F.col("n_more_extreme") + 1) / (F.col("same") + 1)).alias("pval"), "n_more_extreme")
    edge = leading_edge(found).groupBy("contrast", "pathway").agg(F.sort_array(F.collect_list("key")).alias("leading_edge"))
    return adjusted(p, "contrast").join(edge, ["contrast", "pathway"])
