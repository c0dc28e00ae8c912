"""Quality classifier by positive-unlabelled learning.

Trusted positives are labelled rows of good quality; everything else that is used to
fit is unlabelled text.  With pi the part of good texts among the unlabelled, l the
logistic loss, P and U the positives and the unlabelled, the fitted risk is

    pi E_P[l(f)] + max(0, E_U[l(-f)] - pi E_P[l(-f)]),

the non-negative unbiased risk: the second part estimates the risk on bad texts, which
cannot be negative.  pi is estimated first: for every region A of the inputs
U(A) >= pi P(A), so pi is at most the least U(A) / P(A) over the regions above the
thresholds of a classifier of positives against unlabelled.

f is a sum of one step function for each measure of the text.  The measures of all documents
are stored.  Counts of them give the quantiles where the steps are, the class prior (each half
of the documents by the model of the other half) and the margin that trusted positives reach.
The weights are fitted to all unlabelled texts, in passes: in each, every task goes through its
rows in small batches, each with a batch of the positives, and the tasks' weights are averaged
by their rows.  Only the labelled side is bounded, to at most SAMPLE rows.
"""

from __future__ import annotations

import copy

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, FloatType, IntegerType, StructField, StructType

from . import words
from .components import forget, stored
from .features import Adam, sigmoid
from .quality_rules import _dup_lines, _groups, _repeat_words
from .toxicity import fold

#: Labelled rows that weights are fitted to at most.
SAMPLE = 12_000
#: Rows of a batch; rows that a task goes through together, and batches it takes of fewer rows; passes over all rows, and the rate of their steps at first.
BATCH, BLOCK, LEAST_STEPS = 2048, 200_000, 40
PASSES, RATE = 6, 0.05
STEPS = 16
#: Score from which a text is taken as good, and the part of trusted positives that may be below it.
ACCEPT = 0.7
LOST = 0.005
MEASURES = ("words", "word_bytes", "symbols", "marks", "digits", "capitals", "high", "different", "repeated", "dup_lines", "lines", "line_words", "stops", "runs", "longest", "first_caps", "controls", "bare")


def measure(c: words.Chunk) -> np.ndarray:
    """A row of measures for each text of a chunk; none depends on more than the text."""
    data, first = c.data, c.first
    size = np.maximum(np.diff(c.offsets), 1)
    n = np.maximum(c.counts, 1)
    count = lambda table: words.row_sums(table[data], c.offsets)
    tables = {k: np.zeros(256, bool) for k in ("symbols", "marks", "digits", "capitals", "high", "lines", "controls")}
    for k, chars in (("symbols", b"#*$%&|<>@=~^_{}[]\\/+"), ("marks", b".,;:!?\"'()-"), ("lines", b"\n")):
        tables[k][list(chars)] = True
    tables["digits"][48:58] = tables["capitals"][65:91] = tables["high"][128:] = tables["controls"][:9] = True
    h, row = c.codes(), c.row_of_word()
    order, same = _groups(row, h)
    again = np.bincount(row[order[same]], minlength=len(c))
    length = c.end - c.start
    last = data[c.end - 1] if len(c.end) else np.zeros(0, np.uint8)
    run = np.zeros(len(h), bool)
    if len(h) > 1:
        run[1:] = (h[1:] == h[:-1]) & (row[1:] == row[:-1])
    caps = np.zeros(256, bool)
    caps[65:91] = True
    letter = np.zeros(256, bool)
    letter[65:91] = letter[97:123] = letter[128:] = True
    longest = np.zeros(len(c))
    full = np.flatnonzero(c.counts)
    if len(full):
        longest[full] = np.maximum.reduceat(length, first[full])
    head = data[c.start] if len(c.start) else np.zeros(0, np.uint8)
    sums = lambda v: words.row_sums(v, first)
    line_count = count(tables["lines"]) + 1
    columns = {
        "words": np.log1p(c.counts), "word_bytes": sums(length) / n, "symbols": count(tables["symbols"]) / size, "marks": count(tables["marks"]) / size,
        "digits": count(tables["digits"]) / size, "capitals": count(tables["capitals"]) / size, "high": count(tables["high"]) / size, "different": 1 - again / n,
        "repeated": _repeat_words(h, row, c) / n, "dup_lines": _dup_lines(c) / line_count, "lines": np.log1p(line_count), "line_words": np.log1p(n / line_count),
        "stops": sums(np.isin(last, list(b".!?"))) / n, "runs": sums(run) / n, "longest": np.log1p(longest), "first_caps": sums(caps[head]) / n,
        "controls": count(tables["controls"]) / size, "bare": sums(~letter[head]) / n,
    }
    return np.stack([np.asarray(columns[k], float) for k in MEASURES], 1)


def measures(column) -> np.ndarray:
    return np.concatenate([np.zeros((0, len(MEASURES))), *(measure(c) for c in words.chunks(column, words.space_split_table()))])


class Model:
    """Step functions of the measures: edges[k] are where the k-th one's steps are."""

    def __init__(self, edges: list[np.ndarray], weights: list[np.ndarray], bias: float):
        self.edges, self.weights, self.bias = edges, weights, bias

    def margin(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.bias)
        for k, (edge, w) in enumerate(zip(self.edges, self.weights, strict=True)):
            out += w[np.searchsorted(edge, x[:, k], "left")]
        return out


def _steps(x: np.ndarray, edges: list[np.ndarray]) -> np.ndarray:
    """The number of the step of each measure, counted on over all measures."""
    starts = np.cumsum([0, *(len(e) + 1 for e in edges)])[:-1]
    return np.stack([np.searchsorted(e, x[:, k], "left") + s for k, (e, s) in enumerate(zip(edges, starts, strict=True))], 1)


#: Low bits of a 32-bit float that a histogram leaves out: its bins are about 0.1 % wide.
BIN_BITS = 13


def _bins(values: np.ndarray) -> np.ndarray:
    """Bin numbers, in the order of the values; how many there are does not depend on the number of rows."""
    bits = np.ascontiguousarray(values, np.float32).view(np.int32)
    return np.where(bits < 0, bits ^ 0x7FFFFFFF, bits).astype(np.int64) >> BIN_BITS


def _least_of(bins: np.ndarray) -> np.ndarray:
    """The least value of each bin."""
    bits = (np.asarray(bins, np.int64) << BIN_BITS).astype(np.int32)
    return np.where(bits < 0, bits ^ 0x7FFFFFFF, bits).astype(np.int32).view(np.float32).astype(float)


def histograms(rows: DataFrame, pick) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Number k to (least values of bins, counts) of all the values that pick(batch) gives as (k, values) pairs."""

    def count(batches):
        keys, n = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for batch in batches:
            for k, values in pick(batch):
                found, times = np.unique((k << 32) + _bins(values), return_counts=True)
                keys, at = np.unique(np.concatenate([keys, found]), return_inverse=True)
                n = np.bincount(at, np.concatenate([n, times]), len(keys)).astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(n)], names=["key", "n"])

    counted = rows.mapInArrow(count, "key long, n long").groupBy("key").agg(F.sum("n").alias("n")).toPandas().sort_values("key")
    key, n = counted.key.to_numpy(np.int64), counted.n.to_numpy(np.int64)
    # A bin number is below 2**19 in size, so the nearest multiple of 2**32 is that of k.
    k = (key + (1 << 31)) >> 32
    return {int(i): (_least_of(key[k == i] - (i << 32)), n[k == i]) for i in np.unique(k)}


def _quantiles(values: np.ndarray, weights: np.ndarray, parts) -> np.ndarray:
    """The values at these parts of the whole weight."""
    order = np.argsort(values, kind="stable")
    reached = np.cumsum(weights[order])
    return values[order][np.minimum(np.searchsorted(reached, np.asarray(parts) * reached[-1], "left"), len(values) - 1)]


def class_prior(positive: np.ndarray, values: np.ndarray, counts: np.ndarray, least: float = 0.5) -> float:
    """Part of positives among the unlabelled: the least U(A) / P(A) over regions A above a threshold with P(A) >= least.

    positive: margins; values and counts: a histogram of the margins of the unlabelled.  They
    must be of rows that the classifier was not fitted to.  Each ratio is taken with one
    standard error on top, as the least of many noisy ones is too small.
    """
    positive = np.sort(_least_of(_bins(positive)))
    cuts = np.quantile(positive, np.linspace(0.005, 1 - least, 40), method="lower")
    p = 1 - np.searchsorted(positive, cuts, "left") / len(positive)
    size = counts.sum()
    u = 1 - np.concatenate([[0], np.cumsum(counts)])[np.searchsorted(values, cuts, "left")] / size
    ratio = u / np.maximum(p, 1e-9)
    error = ratio * np.sqrt((1 - u) / np.maximum(u * size, 1) + (1 - p) / np.maximum(p * len(positive), 1))
    return float(np.clip((ratio + error).min(), 0.05, 0.99))


class _Design:
    """Steps of positives and unlabelled texts, and gradients over them.

    whole: histograms of the measures of all unlabelled texts, by default those of the texts given.
    """

    def __init__(self, positive: np.ndarray, unlabelled: np.ndarray, whole=None):
        steps = int(np.clip(len(positive) // 60, 4, STEPS))
        tails = [0.01, 0.02, 0.98, 0.99] if len(positive) >= 1000 else []
        parts = [*np.linspace(0, 1, steps + 1)[1:-1], *tails]
        self.edges = []
        for k in range(positive.shape[1]):
            values, counts = whole[k] if whole else (unlabelled[:, k], np.ones(len(unlabelled)))
            both = np.concatenate([positive[:, k], values])
            # Either side has half of the weight, whatever their numbers.
            weights = np.concatenate([np.full(len(positive), 1 / len(positive)), counts / counts.sum()])
            self.edges.append(np.unique([*_quantiles(both, weights, parts), *np.quantile(positive[:, k], [0.002, 0.998])]))
        self.sizes = [len(e) + 1 for e in self.edges]
        self.size = sum(self.sizes)
        self.p, self.u = _steps(positive, self.edges), _steps(unlabelled, self.edges)

    def on(self, p: np.ndarray, u: np.ndarray) -> _Design:
        """The same with the steps of other texts."""
        other = copy.copy(self)
        other.p, other.u = p, u
        return other

    def add(self, gp: np.ndarray, gu: np.ndarray) -> tuple[np.ndarray, float]:
        out = sum(np.bincount(s.ravel(), np.repeat(g, s.shape[1]), self.size) for s, g in ((self.p, gp), (self.u, gu)))
        return out, gp.sum() + gu.sum()

    def against(self, w, b):
        """Of the risk of telling positives from unlabelled."""
        return self.add((sigmoid(w[self.p].sum(1) + b) - 1) / len(self.p) / 2, sigmoid(w[self.u].sum(1) + b) / len(self.u) / 2)

    def risk(self, pi: float):
        """Of the non-negative risk; where the estimate for bad texts is below zero, a step back up."""

        def gradient(w, b):
            fp, fu = w[self.p].sum(1) + b, w[self.u].sum(1) + b
            bad = np.logaddexp(0, fu).mean() - pi * np.logaddexp(0, fp).mean()
            of_bad, of_u = -pi * sigmoid(fp) / len(fp), sigmoid(fu) / len(fu)
            return self.add(-of_bad, -of_u) if bad < 0 else self.add(pi * (sigmoid(fp) - 1) / len(fp) + of_bad, of_u)

        return gradient

    def model(self, w: np.ndarray, b: float) -> Model:
        cuts = np.cumsum([0, *self.sizes])
        return Model(self.edges, [w[i:j] for i, j in zip(cuts[:-1], cuts[1:], strict=True)], b)


def _pass(sent):
    """Takes a task's unlabelled rows through steps of the weights; gives them with the number of rows."""

    def run(batches):
        design, pi, w, b, number, rate = sent.value
        rng = np.random.default_rng((number, TaskContext.get().partitionId()))
        w, rows = w.copy(), 0
        step, step_b = Adam(design.size, rate), Adam((), rate)

        def train(held):
            nonlocal b
            u = np.concatenate(held)
            steps = max(LEAST_STEPS, -(-len(u) // BATCH))
            order = np.concatenate([rng.permutation(len(u)) for _ in range(-(-steps * BATCH // len(u)))])
            for k in range(steps):
                part = design.on(design.p[rng.integers(0, len(design.p), min(BATCH, len(design.p)))], u[order[k * BATCH : (k + 1) * BATCH]])
                gw, gb = (part.against if pi is None else part.risk(pi))(w, b)
                w[:] += step.step(gw + 1e-3 * w)
                b += float(step_b.step(np.array(gb)))

        held: list[np.ndarray] = []
        for batch in batches:
            held.append(_steps(_matrix(batch.column(0)), design.edges).astype(np.int32))
            rows += batch.num_rows
            if sum(map(len, held)) >= BLOCK:
                train(held)
                held = []
        if held and sum(map(len, held)):
            train(held)
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array([np.append(w, b).tolist()], pa.list_(pa.float64())), pa.array([rows])], names=["w", "n"])

    return run


def fitted(known: DataFrame, design: _Design, pi: float | None = None, passes: int = PASSES) -> Model:
    """The model of least risk over the positives of a design and all rows of known (x); pi: the class prior, or none to tell both apart."""
    spark, w, b = known.sparkSession, np.zeros(design.size), 0.0
    for k in range(passes):
        sent = spark.sparkContext.broadcast((design, pi, w, b, k, RATE * (1 - k / (passes + 1))))
        each = known.select("x").mapInArrow(_pass(sent), "w array<double>, n long").select("n", F.posexplode("w").alias("i", "w"))
        mean = each.groupBy("i").agg((F.sum(F.col("w") * F.col("n")) / F.sum("n")).alias("w")).orderBy("i").toPandas()["w"].to_numpy()
        w, b = mean[:-1], float(mean[-1])
        sent.unpersist()
    return design.model(w, b)


def measured(docs: DataFrame) -> DataFrame:
    """(doc_id, half, x): the measures of each row's whole text; null texts are empty ones.  half: 0 or 1, by the id."""

    def measure_all(batches):
        for batch in batches:
            x = measures(batch.column(2)).astype(np.float32)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * len(MEASURES), pa.int32()), pa.array(x.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), lists], names=["doc_id", "half", "x"])

    half = F.pmod(F.xxhash64("doc_id"), F.lit(2)).cast("int").alias("half")
    schema = StructType([StructField("doc_id", docs.schema["doc_id"].dataType), StructField("half", IntegerType()), StructField("x", ArrayType(FloatType()))])
    return docs.select("doc_id", half, "text").mapInArrow(measure_all, schema)


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, len(MEASURES))


def outside(doc_id, parts: int, held: int):
    """Rows that may be learnt from; a null id is in no fold."""
    return doc_id.isNotNull() & (fold(doc_id, parts) != held)


def learn(known: DataFrame, labels: DataFrame, parts: int = 4, held: int = 2, sample: int = SAMPLE, passes: int = PASSES) -> Model:
    """A model from a table of measures.

    Positives: rows labelled 1 outside the held-out fold; weights are fitted to at most
    ``sample`` of their ids, in the order of a hash, with one row, the least, of each id.
    Unlabelled: all rows outside the fold, whatever their labels.  Weights, steps and prior
    come from all of them, and the place of ACCEPT from all positive ones.  With fewer than
    four rows of a half on either side every score is 0.5.
    """
    may = outside(F.col("doc_id"), parts, held)
    known = known.filter(may)
    labelled = labels.filter(may & (F.col("quality") == 1)).select("doc_id").distinct()
    chosen = labelled.orderBy(F.xxhash64(F.col("doc_id")), "doc_id").limit(sample)
    # At most so many ids: a bounded side to send to the tasks.
    rows = known.join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "half").agg(F.min("x").alias("x")).toPandas()
    x, half = np.array(rows.x.tolist(), float).reshape(len(rows), len(MEASURES)), rows.half.to_numpy()
    unlabelled = {r["half"]: r["count"] for r in known.groupBy("half").count().collect()}
    side = lambda which: x[which][np.lexsort(x[which].T)]
    if min(min((half == k).sum(), unlabelled.get(k, 0)) for k in (0, 1)) < 4:
        return Model([np.zeros(0)] * len(MEASURES), [np.zeros(1)] * len(MEASURES), 0.0)
    whole = histograms(known.select("x"), lambda batch: enumerate(_matrix(batch.column(0)).T))
    none = np.zeros((0, len(MEASURES)))
    halves = [fitted(known.filter(F.col("half") == k), _Design(side(half == k), none, whole), passes=max(1, passes // 2)) for k in (0, 1)]

    def by_the_other(batch):
        h, values = batch.column(0).to_numpy(zero_copy_only=False), _matrix(batch.column(1))
        return [(k, halves[k].margin(values[h == 1 - k])) for k in (0, 1)]

    margins = histograms(known.select("half", "x"), by_the_other)
    pi = float(np.mean([class_prior(halves[k].margin(side(half == 1 - k)), *margins[k]) for k in (0, 1)]))
    model = fitted(known, _Design(side(half >= 0), none, whole), pi, passes)
    model.prior = pi
    # The prior weighs the risk; ACCEPT is the score that nearly all trusted positives reach.
    reached = histograms(known.join(labelled, "doc_id", "left_semi").select("x"), lambda batch: [(0, model.margin(_matrix(batch.column(0))))])[0]
    model.bias += float(np.log(ACCEPT / (1 - ACCEPT)) - _quantiles(*reached, [LOST])[0])
    return model


def scored(known: DataFrame, model: Model) -> DataFrame:
    """(doc_id, score) of a table of measures.  Repeated rows have repeated results."""
    sent = known.sparkSession.sparkContext.broadcast(model)

    def score_all(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sigmoid(sent.value.margin(_matrix(batch.column(1)))), pa.float64())], names=["doc_id", "score"])

    return known.select("doc_id", "x").mapInArrow(score_all, StructType([known.schema["doc_id"], StructField("score", DoubleType())]))


def train(docs: DataFrame, labels: DataFrame, parts: int = 4, held: int = 2, sample: int = SAMPLE) -> Model:
    """Like learn, from texts."""
    known = stored(measured(docs), "quality-measures")
    model = learn(known, labels, parts, held, sample)
    forget(known)
    return model


def score(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, score): every row's whole text; null texts are empty ones.  Repeated rows have repeated results."""
    return scored(measured(docs), model)


def op6_quality_pu(spark, sf_dir: str) -> DataFrame:
    """A null doc_id is not held out; without positives or unlabelled texts every score is 0.5."""
    known = stored(measured(spark.read.parquet(f"{sf_dir}/documents.parquet")), "quality-measures")
    result = scored(known, learn(known, spark.read.parquet(f"{sf_dir}/labels.parquet")))
    return result.select("doc_id", F.coalesce(fold(F.col("doc_id"), 4) == 2, F.lit(False)).alias("held_out"), "score", (F.col("score") >= ACCEPT).cast("int").alias("predicted"))
