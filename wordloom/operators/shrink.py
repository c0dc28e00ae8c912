"""Bootstrap standard errors and shrinkage of similarity estimates."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.expressions import fisher
from .lineage import sent, settled
from .ranks import running_sums
from .vectors import cosines, nearest, words_table


def fisher_z(models: DataFrame, headers: DataFrame) -> DataFrame:
    """(model, header, word, cos, z) of all words but the header itself."""
    near = cosines(models, headers).filter("word <> header")
    return near.withColumn("z", fisher(F.col("cos")))


def boot_sd(boot: DataFrame, headers: DataFrame) -> DataFrame:
    """(header, word, sd_z, replicates): spread of z over the replicates that have both words."""
    return fisher_z(boot, headers).groupBy("header", "word").agg(F.stddev_samp("z").alias("sd_z"), F.count("z").alias("replicates"))


_erf = np.frompyfunc(math.erf, 1, 1)


def _cdf(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + _erf(x / math.sqrt(2)).astype(float))


def _pdf(x: np.ndarray) -> np.ndarray:
    return np.exp(-0.5 * x * x) / math.sqrt(2 * math.pi)


#: A row's z in its standard errors, and the logarithm of its standard error, are told apart in cells of these widths when the prior is fitted.
Z_CELL, ERROR_CELL = 1 / 64, 1 / 128
#: Weight of the null in the penalty, and rounds of the fit at most.
NULL_WEIGHT, ROUNDS = 10.0, 2000
#: Rows of likelihoods that a round of the fit takes at once.
BLOCK = 4096


def widths(low: float, high: float) -> np.ndarray:
    """Half widths of the uniform components, a factor of the root of 2 apart."""
    steps = max(1, math.ceil(math.log(max(high, low * 2) / low) / math.log(math.sqrt(2))))
    return low * math.sqrt(2) ** np.arange(steps + 1)


def likelihoods(b: np.ndarray, e: np.ndarray, a: np.ndarray, mass: np.ndarray | None = None) -> np.ndarray:
    """Of estimates b with errors e: under a point mass at 0, and under each uniform component around it; mass: the normal's within each component, if known."""
    b, e = b[:, None], e[:, None]
    if mass is None:
        mass = np.maximum(_cdf((a - b) / e) - _cdf((-a - b) / e), 1e-300)
    return np.hstack([_pdf(b / e) / e, mass / (2 * a)])


def prior(like: np.ndarray, n: np.ndarray, null_weight: float = NULL_WEIGHT, rounds: int = ROUNDS) -> np.ndarray:
    """Shares of the components by EM with a penalty that favours the null; n: how often each row of likelihoods occurs."""
    penalty = np.append(null_weight, np.ones(like.shape[1] - 1)) - 1
    pi = np.full(like.shape[1], 1 / like.shape[1])
    # A round is two products with a block of rows, which stays in the processor's cache; no table of weights is made.
    blocks = [(like[at : at + BLOCK], n[at : at + BLOCK]) for at in range(0, len(like), BLOCK)]
    for _ in range(rounds):
        new = pi * sum((m / np.maximum(part @ pi, 1e-300)) @ part for part, m in blocks)
        new = np.maximum(new + penalty, 0)
        new /= max(new.sum(), 1e-300)
        if np.abs(new - pi).max() < 1e-8:
            return new
        pi = new
    return pi


def posterior(b: np.ndarray, e: np.ndarray, a: np.ndarray, pi: np.ndarray) -> dict[str, np.ndarray]:
    """post_mean, post_sd, lfdr and lfsr of estimates under the fitted prior."""
    lo, hi = (-a - b[:, None]) / e[:, None], (a - b[:, None]) / e[:, None]
    under = _cdf(lo)
    mass = np.maximum(_cdf(hi) - under, 1e-300)
    w = likelihoods(b, e, a, mass) * pi
    w /= np.maximum(w.sum(1, keepdims=True), 1e-300)
    b, e = b[:, None], e[:, None]
    # Moments of a normal cut to (-a, a).
    shift = (_pdf(lo) - _pdf(hi)) / mass
    mean = np.clip(b + e * shift, -a, a)
    inside = mass > 1e-12  # elsewhere nearly all of the cut normal is at an end
    shift = np.where(inside, shift, 0)
    spread = np.where(inside, np.maximum(e * e * (1 + (lo * _pdf(lo) - hi * _pdf(hi)) / np.where(inside, mass, 1) - shift * shift), 0), 0)
    below = np.clip((_cdf(np.minimum(-b / e, hi)) - under) / mass, 0, 1)
    post = (w[:, 1:] * mean).sum(1)
    second = (w[:, 1:] * (spread + mean * mean)).sum(1)
    negative = (w[:, 1:] * below).sum(1)
    lfsr = np.clip(np.minimum(1 - negative, negative + w[:, 0]), 0, 1)
    return {"post_mean": post, "post_sd": np.sqrt(np.maximum(second - post * post, 0)), "lfdr": w[:, 0], "lfsr": lfsr}


_PRIOR = "of string, widths array<double>, shares array<double>"


def _fit(frame: pd.DataFrame) -> pd.DataFrame:
    frame = frame.sort_values(["t_cell", "e_cell"])
    a = widths(float(frame["low"].iloc[0]), float(frame["high"].iloc[0]))
    pi = prior(likelihoods(frame["z"].to_numpy(float), frame["sd"].to_numpy(float), a), frame["n"].to_numpy(float))
    return pd.DataFrame({"of": [frame["header"].iloc[0]], "widths": [a], "shares": [pi]})


def priors(known: DataFrame) -> DataFrame:
    """(of, widths, shares): the prior of each header of known (header, z, sd_z), both finite and sd_z above 0.

    Rows go into cells, with their means and their number; cells are narrow against the
    errors, and a header has only so many, whatever its rows.
    """
    beyond = F.max(F.col("z") * F.col("z") - F.col("sd_z") * F.col("sd_z"))
    bounds = known.groupBy("header").agg((F.min("sd_z") / 10).alias("low"), beyond.alias("beyond"))
    bounds = bounds.select("header", "low", F.when(F.col("beyond") > 0, 2 * F.sqrt("beyond")).otherwise(8 * F.col("low")).alias("high"))
    cell = known.withColumns({"t_cell": F.floor(F.col("z") / F.col("sd_z") / Z_CELL), "e_cell": F.floor(F.log("sd_z") / ERROR_CELL)})
    cells = cell.groupBy("header", "t_cell", "e_cell").agg(F.avg("z").alias("z"), F.avg("sd_z").alias("sd"), F.count("*").alias("n"))
    # As many parts as cores: the cells are few bytes, which Spark would put into one task.
    return cells.join(sent(bounds), "header").repartition(known.sparkSession.sparkContext.defaultParallelism, "header").groupBy("header").applyInPandas(_fit, _PRIOR)


def _parts(df: DataFrame) -> int:
    spark = df.sparkSession
    return max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))


_SHRUNK = "header string, similar_word string, cosine_est double, z double, sd_z double, post_mean_z double, post_sd_z double, lfdr double, lfsr double"


def _posteriors(batches):
    """The posterior of each row, with its header's prior in the row."""
    for frame in batches:
        out = frame[["header", "similar_word", "cosine_est", "z", "sd_z"]].copy()
        for c in ("post_mean_z", "post_sd_z", "lfdr", "lfsr"):
            out[c] = np.nan
        for _, at in frame.groupby("of").indices.items():
            first = frame.iloc[at[0]]
            found = posterior(frame["z"].to_numpy(float)[at], frame["sd_z"].to_numpy(float)[at], np.asarray(first["widths"]), np.asarray(first["shares"]))
            for name, c in (("post_mean", "post_mean_z"), ("post_sd", "post_sd_z"), ("lfdr", "lfdr"), ("lfsr", "lfsr")):
                out.iloc[at, out.columns.get_loc(c)] = found[name]
        yield out


def shrink(estimates: DataFrame) -> DataFrame:
    """Adaptive shrinkage (Stephens 2017) of (header, similar_word, cosine_est, z, sd_z): a point mass at 0 and uniform components around it, for each header.

    Adds post_mean_z, post_sd_z, lfdr, lfsr, svalue and ash_cosine_est.  Rows without a
    standard error, or with one of 0, are not shrunk and have null results.  A header's
    rows are dealt out over many tasks; the prior is fitted to its cells.  The estimates
    are made once and stored.
    """
    estimates = settled(estimates.repartition(_parts(estimates)))
    known = estimates.filter("isnotnull(z) AND NOT isnan(z) AND abs(z) < double('inf') AND sd_z > 0 AND NOT isnan(sd_z) AND sd_z < double('inf')")
    rest = estimates.filter("NOT coalesce(isnotnull(z) AND NOT isnan(z) AND abs(z) < double('inf') AND sd_z > 0 AND NOT isnan(sd_z) AND sd_z < double('inf'), false)")
    # What Python makes is stored, as a count and a sort read it again.
    fitted = settled(known.join(sent(settled(priors(known))), F.col("header") == F.col("of")).mapInPandas(_posteriors, _SHRUNK))
    # svalue: the mean lfsr of a row and of those with a smaller one; ties by the word.
    summed = running_sums(fitted, "_sum", "lfsr", "_k", "header", F.asc("lfsr"), F.asc("similar_word"))
    done = summed.withColumns({"svalue": F.col("_sum") / F.col("_k"), "ash_cosine_est": F.tanh("post_mean_z")}).drop("_sum", "_k")
    none = F.lit(None).cast("double")
    empty = rest.select("header", "similar_word", "cosine_est", "z", "sd_z", *(none.alias(c) for c in ("post_mean_z", "post_sd_z", "lfdr", "lfsr", "svalue", "ash_cosine_est")))
    return done.unionByName(empty)


def corshrink(model: DataFrame, boot: DataFrame, words: list[str], num_related_words: int = 500) -> DataFrame:
    """Shrunk similarities of each word with its neighbours in any replicate."""
    heads = words_table(model.sparkSession, words)
    related = nearest(boot, heads, num_related_words).filter("word <> query").select(F.col("query").alias("header"), "word").distinct()
    true = fisher_z(model, heads).select("header", "word", F.col("cos").alias("cosine_est"), "z")
    joined = related.join(true, ["header", "word"]).join(boot_sd(boot, heads), ["header", "word"], "left")
    return shrink(joined.select("header", F.col("word").alias("similar_word"), "cosine_est", "z", "sd_z"))
