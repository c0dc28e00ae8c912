"""Small p-values of the set test, by adaptive multilevel splitting.

Permutations cannot tell p-values below one over their number.  Here a number of random
sets climbs towards the observed score: the lower half is dropped, the others are copied,
and the copies are moved by Metropolis steps (one key of the set for one outside) that
must stay above the level reached.  Each level halves the probability, so that p of
10**-12 takes some forty of them.  After Korotkevich, Sukhov, Budin et al. (2021).

The standard error of log(p) is about the root of levels over sets; it is a part of the
result.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .gsea import PIECE, SetTest, prefix_scores, random_orders, weight_pieces

#: Random sets, steps of each at a level for each key of a set (at least LEAST_STEPS), and levels at most: p is not told below 2**-LEVELS.
SETS, STEPS, LEAST_STEPS, LEVELS = 300, 0.25, 30, 200


def tail_probability(weights: np.ndarray, size: int, es: float, rng, sets: int = SETS, levels: int = LEVELS) -> tuple[float, float]:
    """(probability that a random set's score is at least es, standard error of its logarithm); weights by rank.  For es below 0: at most."""
    if es < 0:
        return tail_probability(weights[::-1], size, -es, rng, sets, levels)
    n, one = len(weights), np.array([size])
    score = lambda at: prefix_scores(at, weights[at], n, one)[0]
    at = random_orders(rng, n, size, sets)
    now = score(at)
    log_p, variance = 0.0, 0.0
    goal = es - 1e-12
    for _ in range(levels):
        reached = (now >= goal).mean()
        level = np.sort(now)[sets // 2]
        if reached >= 0.5 or level >= goal:
            break
        above = now > level
        if not above.any():  # most sets have one score, and none is higher
            above = now >= level
            if above.all():
                break
        part = above.mean()
        log_p += math.log(part)
        variance += (1 - part) / (part * sets)
        lost = np.flatnonzero(~above)
        copied = rng.choice(np.flatnonzero(above), len(lost))
        at[lost], now[lost] = at[copied], now[copied]
        least = now.min()
        for _ in range(max(LEAST_STEPS, math.ceil(STEPS * size))):
            moved = at.copy()
            moved[np.arange(sets), rng.integers(0, size, sets)] = (new := rng.integers(0, n, sets))
            fresh = ~(at == new[:, None]).any(1)
            value = score(moved)
            ok = fresh & (value >= least)
            at[ok], now[ok] = moved[ok], value[ok]
    reached = (now >= goal).mean()
    if reached == 0:
        return math.exp(log_p) / sets, math.inf
    return math.exp(log_p + math.log(reached)), math.sqrt(variance + (1 - reached) / (reached * sets))


def _tails(test: SetTest, sets: int):
    def tails(left: pa.Table, right: pa.Table) -> pa.Table:
        pieces = right.sort_by("piece")["weights"].to_pylist()
        weights = np.concatenate([np.frombuffer(x, "<f8") for x in pieces])
        out = []
        for row in left.to_pylist():
            digest = int.from_bytes(hashlib.sha256(f"{row['contrast']}|{row['pathway']}".encode()).digest()[:8], "big")
            out.append(tail_probability(weights, row["size"], row["es"], np.random.default_rng((test.seed, digest)), sets))
        return pa.table({"contrast": left["contrast"], "pathway": left["pathway"], "tail": pa.array([p for p, _ in out], pa.float64()), "log_error": pa.array([e for _, e in out], pa.float64())})

    return tails


def small_p(tested: DataFrame, scores: DataFrame, test: SetTest = SetTest(), fewer_than: int = 10, sets: int = SETS) -> DataFrame:
    """(contrast, pathway, size, es, pval, tail, log_error): the sets of set_test's result that fewer permutations than fewer_than exceed.

    tail: the probability of such a score among all random sets of the size; pval: among
    those whose score has the same sign, of which the test's permutations tell the part.
    log_error: the standard error of log(tail).  The weights of a set's contrast, 8 bytes
    for each key, have to fit a task; each set is a task of its own.
    """
    rare = tested.filter(F.col("n_more_extreme") < fewer_than).select("contrast", "pathway", "size", "es", "n_more_extreme", F.col("pval").alias("_p"))
    key = F.concat_ws("\u0001", "contrast", "pathway")
    pieces = rare.select("contrast", key.alias("of")).join(weight_pieces(scores, test, PIECE), "contrast").select("of", "piece", "weights")
    found = rare.select(key.alias("set"), "contrast", "pathway", "size", "es").groupBy("set").cogroup(pieces.groupBy("of")).applyInArrow(_tails(test, sets), "contrast string, pathway string, tail double, log_error double")
    # (n_more_extreme + 1) / (same + 1) is the permutations' p-value, so that same is known.
    same = (F.col("n_more_extreme") + 1) / F.col("_p") - 1
    part = F.greatest(same, F.lit(1.0)) / F.lit(float(test.nperm))
    joined = rare.join(found, ["contrast", "pathway"])
    return joined.select("contrast", "pathway", "size", "es", F.least(F.lit(1.0), F.col("tail") / F.least(F.lit(1.0), part)).alias("pval"), "tail", "log_error")
