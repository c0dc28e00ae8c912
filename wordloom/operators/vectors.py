"""Word vectors: extraction, cosines and nearest words.

A model table is (model, word, vec) with one vector length for each model.
"""

from __future__ import annotations

import itertools
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.expressions import dot, unit
from .lineage import sent

#: Header words that meet the others in one block of a join, numbers of all headers' vectors that go to all tasks, and cosines of a block.
HEADERS, NUMBERS, CELLS = 5_000, 1 << 23, 1 << 15
#: Words and headers whose cosines are dealt out to bins at once.
BINNED = 256
#: Neighbours that a task keeps at most, of all queries.
KEPT = 1 << 21


def words_table(spark, words: list[str]) -> DataFrame:
    """A list of words given by the caller as a table; without repeats."""
    return spark.createDataFrame([(w,) for w in dict.fromkeys(words)], "word string")


def extract(models: DataFrame, words: DataFrame) -> DataFrame:
    """The rows of the words that a model has; others are absent."""
    return models.join(sent(words.select("word").distinct()), "word", "left_semi")


def average(models: DataFrame, words: DataFrame) -> DataFrame:
    """(model, vec): the mean of the words' vectors."""
    cells = extract(models, words).select("model", F.posexplode("vec").alias("i", "v"))
    means = cells.groupBy("model", "i").agg(F.avg(F.col("v").cast("double")).alias("v"))
    return means.groupBy("model").agg(F.sort_array(F.collect_list(F.struct("i", "v")))["v"].alias("vec"))


@dataclass
class _Heads:
    """The headers of one model: names, unit vectors (zeros for null) and which are null."""

    names: pa.Array
    matrix: np.ndarray
    null: np.ndarray


def _units(vectors, size: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(matrix, which rows are null) of an Arrow array of vectors; null rows, and numbers, are null."""
    null = vectors.is_null().to_numpy(zero_copy_only=False)
    flat = vectors.flatten()
    live = np.flatnonzero(~null)
    size = size or (len(flat) // len(live) if len(live) else 0)
    matrix = np.zeros((len(null), size))
    if len(live):
        known = flat.is_valid().to_numpy(zero_copy_only=False).reshape(len(live), size).all(1)
        matrix[live] = flat.fill_null(0.0).to_numpy(zero_copy_only=False).reshape(len(live), size)
        null[live[~known]] = True
    return matrix, null


def _products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of the rows of two matrices, added up number by number: equal vectors have equal products wherever they stand."""
    out = np.zeros((len(a), len(b)))
    for k in range(a.shape[1]):
        out += a[:, k, None] * b[:, k]
    return out


def _words_by_model(batch: pa.RecordBatch, heads: dict[str, _Heads]):
    """(model, its headers, its words of a batch (model, word, u), their matrix, which are null)."""
    models = np.array(batch.column(0).to_pylist(), object)
    for model in sorted({m for m in models.tolist() if m in heads}):
        own = pa.array(np.flatnonzero(models == model))
        words, head = batch.column(1).take(own), heads[model]
        matrix, null = _units(batch.column(2).take(own), head.matrix.shape[1] or None)
        if matrix.shape[1] != head.matrix.shape[1]:
            # Every header, or every word of the batch, is null.
            matrix, null = np.zeros((len(words), head.matrix.shape[1])), np.ones(len(words), bool)
        yield model, head, words, matrix, null


def _by_model(batch: pa.RecordBatch, heads: dict[str, _Heads]):
    """(model, headers, words, their cosines, null cells) of blocks of a batch (model, word, u), within a model."""
    for model, head, words, matrix, null in _words_by_model(batch, heads):
        step = max(1, CELLS // len(head.names))
        for at in range(0, len(words), step):
            part = slice(at, at + step)
            yield model, head, words[at : at + step], _products(matrix[part], head.matrix), null[part, None] | head.null


def _each(sent_heads):
    """All cosines, as rows."""

    def run(batches):
        heads = sent_heads.value
        for batch in batches:
            for model, head, words, found, null in _by_model(batch, heads):
                n, m = found.shape
                word, header = words.take(pa.array(np.repeat(np.arange(n), m))), head.names.take(pa.array(np.tile(np.arange(m), n)))
                names = pa.array([model], pa.string()).take(pa.array(np.zeros(n * m, np.int32)))
                yield pa.RecordBatch.from_arrays([names, word, header, pa.array(found.ravel(), mask=null.ravel())], names=["model", "word", "header", "cos"])

    return run


#: Cosines nearer to the end of a bin than this are made again, number by number.
_NEAR_END = 1e-9


def _binned(sent_heads, bins: int):
    """How many of a task's cosines are in each of equal bins of (-1, 1): null ones, and those from 1 on, are in the last."""

    def run(batches):
        heads, n = sent_heads.value, np.zeros(bins + 1, np.int64)
        for batch in batches:
            for _, head, _, matrix, null in _words_by_model(batch, heads):
                # The place among the bins is one product, as each vector gets a last number.
                scaled = np.column_stack([head.matrix, np.ones(len(head.names))]) * (bins / 2)
                matrix = np.column_stack([matrix, np.ones(len(matrix))])
                odd = null.any() or head.null.any() or np.isnan(matrix).any() or np.isnan(scaled).any()
                for at, to in itertools.product(range(0, len(matrix), BINNED), range(0, len(scaled), BINNED)):
                    part, other = matrix[at : at + BINNED], head.matrix[to : to + BINNED]
                    place = part @ scaled[to : to + BINNED].T
                    bin = (place if not odd else np.nan_to_num(place)).astype(np.int64)
                    place -= bin
                    place -= 0.5
                    # A product of matrices may differ from the sum number by number in its last digits.
                    near = np.abs(place, out=place) > 0.5 - _NEAR_END * bins
                    if near.any():
                        row, column = np.nonzero(near)
                        again = np.zeros(len(row))
                        for k in range(other.shape[1]):
                            again += part[row, k] * other[column, k]
                        # Rounding may put a cosine below -1, which is bin -1.
                        bin[row, column] = np.clip(np.floor((again + 1) * (bins / 2)), -1, bins - 1)
                    if odd:
                        bin[null[at : at + BINNED, None] | head.null[to : to + BINNED]] = bins - 1
                    n += np.bincount(bin.ravel() + 1, minlength=bins + 1)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(-1, bins)), pa.array(n)], names=["i", "n"])

    return run


class _Best:
    """The n best words of each header so far: null cosines last, ties by word."""

    def __init__(self, head: _Heads, n: int):
        self.head, self.n = head, n
        self.row, self.word = np.zeros(0, np.int64), np.zeros(0, object)
        self.cos, self.null = np.zeros(0), np.zeros(0, bool)
        self.last = np.full(len(head.names), -np.inf)

    @staticmethod
    def _key(cos: np.ndarray, null: np.ndarray) -> np.ndarray:
        return np.where(null, -np.inf, np.where(np.isnan(cos), np.inf, cos))

    def meet(self, words: pa.Array, found: np.ndarray, null: np.ndarray) -> None:
        key = self._key(found, null)
        least = self.last
        if len(words) > self.n:
            least = np.maximum(least, np.partition(key, len(words) - self.n, axis=0)[len(words) - self.n])
        at, row = np.nonzero(key >= least)
        if not len(row):
            return
        words = np.array(words.to_pylist(), object)
        self.row, self.word = np.concatenate([self.row, row]), np.concatenate([self.word, words[at]])
        self.cos, self.null = np.concatenate([self.cos, found[at, row]]), np.concatenate([self.null, null[at, row]])
        key = self._key(self.cos, self.null)
        place = {w: i for i, w in enumerate(sorted(set(self.word.tolist())))}
        order = np.lexsort((np.fromiter((place[w] for w in self.word.tolist()), np.int64, len(self.word)), -key, self.row))
        ordered = self.row[order]
        rank = np.arange(len(ordered)) - np.searchsorted(ordered, ordered)
        keep = order[rank < self.n]
        full = order[rank == self.n - 1]
        self.last[self.row[full]] = key[full]
        self.row, self.word, self.cos, self.null = self.row[keep], self.word[keep], self.cos[keep], self.null[keep]

    def batch(self, model: str) -> pa.RecordBatch:
        columns = [pa.array([model] * len(self.row), pa.string()), self.head.names.take(pa.array(self.row)), pa.array(self.word.tolist(), pa.string()), pa.array(self.cos, mask=self.null)]
        return pa.RecordBatch.from_arrays(columns, names=["model", "query", "word", "cos"])


def _best(sent_heads, n: int):
    """The n best of a task's words for each header."""

    def run(batches):
        heads, best, held = sent_heads.value, {}, {}

        def merge(model):
            # Several blocks are merged at once, as every merge sorts all that is kept.
            words, found, null = (np.concatenate(x) if i else pa.concat_arrays(x) for i, x in enumerate(zip(*held.pop(model), strict=True)))
            best.setdefault(model, _Best(heads[model], n)).meet(words, found, null)

        for batch in batches:
            for model, _, words, found, null in _by_model(batch, heads):
                held.setdefault(model, []).append((words, found, null))
                if sum(x[1].size for x in held[model]) >= max(16 * CELLS, 2 * n * found.shape[1]):
                    merge(model)
        for model in list(held):
            merge(model)
        for model, found in best.items():
            yield found.batch(model)

    return run


def _whole(models: DataFrame) -> DataFrame:
    return models.select("model", "word", unit(F.col("vec")).alias("u"))


def _sent_heads(models: DataFrame, names: DataFrame):
    """The headers' rows of a model table, sent to the tasks.  The driver sees NUMBERS of numbers at most."""
    rows = _whole(models.join(F.broadcast(names), "word", "left_semi")).toArrow()
    by_model = {}
    for model in rows["model"].unique().to_pylist():
        own = rows.filter(pc.equal(rows["model"], model)).combine_chunks()
        matrix, null = _units(own["u"].combine_chunks())
        by_model[model] = _Heads(own["word"].combine_chunks().cast(pa.string()), matrix, null)
    return models.sparkSession.sparkContext.broadcast(by_model)


def _size(models: DataFrame, names: DataFrame) -> tuple[int, int]:
    """(rows of a model table that are headers, numbers of their vectors)."""
    row = models.join(names, "word", "left_semi").agg(F.count("*").alias("rows"), F.sum(F.greatest(F.size("vec"), F.lit(1)).cast("long")).alias("numbers")).head()
    return row.rows, row.numbers or 0


def cosines(models: DataFrame, headers: DataFrame) -> DataFrame:
    """(model, word, header, cos) of every word and every header that a model has both of.

    Vectors are made unit vectors once.  The headers are counted: up to NUMBERS of numbers
    are sent to the tasks and meet the words there as matrices, more meet the words in
    blocks of HEADERS.
    """
    names = headers.select("word").distinct()
    whole = _whole(models)
    if _size(models, names)[1] <= NUMBERS:
        return whole.mapInArrow(_each(_sent_heads(models, names)), "model string, word string, header string, cos double")
    n = names.count()
    heads = whole.join(names, "word", "left_semi").select("model", F.col("word").alias("header"), F.col("u").alias("hu"))
    blocks = -(-n // HEADERS)
    every = whole.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    met = every.join(heads.withColumn("block", F.pmod(F.xxhash64("header"), F.lit(blocks)).cast("int")), ["model", "block"])
    return met.select("model", "word", "header", dot(F.col("u"), F.col("hu")).alias("cos"))


def cosine_bins(models: DataFrame, headers: DataFrame, bins: int) -> DataFrame:
    """(i, n): how many of ``cosines`` are in each of equal bins of (-1, 1), in those that have any.

    Null cosines, and those from 1 on, are in the last bin.  Where the headers go to the
    tasks, these count their own cosines, and only counts are shuffled.
    """
    names = headers.select("word").distinct()
    if _size(models, names)[1] <= NUMBERS:
        counted = _whole(models).mapInArrow(_binned(_sent_heads(models, names), bins), "i long, n long")
        return counted.groupBy("i").agg(F.sum("n").alias("n")).filter("n > 0")
    place = F.least(F.floor((F.col("cos") + 1) * (bins / 2)), F.lit(bins - 1))
    return cosines(models, headers).groupBy(place.alias("i")).agg(F.count("*").alias("n"))


def nearest(models: DataFrame, queries: DataFrame, n: int = 10) -> DataFrame:
    """(model, query, word, cos, rank): the n nearest words of each query word, itself among them; ties by word.

    The queries go to the tasks, of which each gives its own n best, up to NUMBERS of
    numbers and KEPT neighbours.  More meet the words in the blocks of nearest_all; where
    words have no direction, which rank last here and are no one's neighbours there, they
    meet in a join.
    """
    names = queries.select("word").distinct()
    rows, numbers = _size(models, names)
    if numbers <= NUMBERS and rows * n <= KEPT:
        ranked = _whole(models).mapInArrow(_best(_sent_heads(models, names), n), "model string, query string, word string, cos double")
    elif not _whole(models).filter("u IS NULL OR exists(u, x -> x IS NULL OR isnan(x))").limit(1).count() and not models.groupBy("model", "word").count().filter("count > 1").limit(1).count():
        from .neighbors import nearest_all

        return nearest_all(models, n, names)
    else:
        ranked = cosines(models, names).withColumnRenamed("header", "query")
    best = Window.partitionBy("model", "query").orderBy(F.desc_nulls_last("cos"), "word")
    return ranked.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= n)


def nearest_to_vector(models: DataFrame, vector: list[float], n: int = 10) -> DataFrame:
    """(model, word, cos, rank): the n words nearest to a vector in each model."""
    u = unit(F.array(*(F.lit(float(x)) for x in vector)))
    near = models.select("model", "word", dot(unit(F.col("vec")), u).alias("cos"))
    best = Window.partitionBy("model").orderBy(F.desc_nulls_last("cos"), "word")
    return near.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= n)


def control_sample(words: DataFrame, n: int, seed: int = 1) -> DataFrame:
    """n words in the order of a digest of seed and word: a sample without repeats that any engine can draw."""
    if n < 0:
        raise ValueError("n must not be negative")
    return words.select("word").orderBy(F.md5(F.concat_ws("|", F.lit(str(seed)), "word")), "word").limit(n)


def union_sets(*sets: DataFrame) -> DataFrame:
    out = sets[0].select("word")
    for s in sets[1:]:
        out = out.union(s.select("word"))
    return out.distinct()


def except_set(words: DataFrame, other: DataFrame) -> DataFrame:
    return words.select("word").distinct().join(other.select("word"), "word", "left_anti")
