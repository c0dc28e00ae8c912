"""Scores of texts under a hashed maximum-entropy model of their words.

The words before a token give its features: the last word, the last but one with the
last one skipped, and both together.  A token is predicted in two steps, its class and
then the token within its class, each a softmax of sums of the features' weights:

    log P(w | h) = log softmax(b + sum of A[f])[class] + log softmax(c + sum of B[class, f])[w].

The LISTED most frequent tokens are in classes of WIDTH by rank.  Other known words are
in classes by their ending, and have their smoothed counts within it.  A class of its own
is for unknown words; words that were met once in training are its examples.  Features are
hashed into tables of ROWS rows, which is all that the model's size depends on.

1.  Texts are runs of numbered words; their different words become the dictionary with
    the counts of all training texts, and go back to the runs by a join.
2.  The runs are written as streams of symbols, with what does not depend on the weights.
3.  Training reads all training texts once, in ROUNDS parts.  In each round every task
    trains a copy of the weights by steps over small batches of its runs; the changes of a
    row, as 16-bit numbers, are averaged over the tasks that changed it, and the next round starts from there.
4.  All texts are scored in batches: rows of weights are taken by feature and added.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import runs as run_tables
from . import words
from .components import forget, release_shuffles, stored

#: Tokens with weights of their own, and tokens of a class of them.
LISTED, WIDTH = 1024, 32
#: Classes of other known words, by their last two code points.
ENDINGS = 31
#: Rows of each table of weights; a row has a number for each class, or for each token of a class.
ROWS = 1 << 16
#: Parts of the training texts after each of which copies are averaged, tokens of a step, and its rate.
ROUNDS, BATCH, RATE = 4, 8192, 0.5
#: Added to each count.
SMOOTH = 0.1
#: Rows of weights that are averaged together.
BLOCK = 4096

LISTED_CLASSES = LISTED // WIDTH
UNKNOWN = LISTED_CLASSES + ENDINGS
CLASSES = UNKNOWN + 1
_END = "\n"
_U = np.uint64


@dataclass
class Symbols:
    """What a token's symbol says.  Symbols: the listed tokens (the end is 0), then words of two or more, words of one, and unknown words, by ending."""

    end: int = 0
    before: np.ndarray = field(init=False)
    trained: np.ndarray = field(init=False)
    scored: np.ndarray = field(init=False)

    def __post_init__(self):
        listed, endings = np.arange(LISTED), np.arange(ENDINGS)
        #: The symbol as a part of what stands before a token; words that are not listed go by their ending.
        self.before = np.concatenate([listed, *[LISTED + endings] * 3]).astype(np.int64)
        own = LISTED_CLASSES + endings
        unknown = np.full(ENDINGS, UNKNOWN)
        #: The class when the model is trained, and when a text is scored.
        self.trained = np.concatenate([listed // WIDTH, own, unknown, unknown]).astype(np.int64)
        self.scored = np.concatenate([listed // WIDTH, own, own, unknown]).astype(np.int64)


def _slot(value: np.ndarray, kind: int) -> np.ndarray:
    """The row of a feature's weights."""
    mixed = (value.astype(_U) + _U(kind << 40)) * _U(0x9E3779B97F4A7C55)
    mixed = (mixed ^ (mixed >> _U(29))) * _U(0x81DADEF4BC2DD44D)
    return (mixed >> _U(64 - ROWS.bit_length() + 1)).astype(np.uint16)


def history(stream: np.ndarray, symbols: Symbols, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The last and the last but one symbol before each token; before a text stand ends."""
    seen = symbols.before[stream]
    last, other = np.zeros(len(seen), np.int64), np.zeros(len(seen), np.int64)
    last[1:], other[2:] = seen[:-1], seen[:-2]
    last[starts] = 0
    other[starts] = 0
    other[starts[starts + 1 < len(seen)] + 1] = 0
    return last, other


def _greatest(x: np.ndarray) -> np.ndarray:
    """The greatest number of each row, by halves."""
    while x.shape[1] % 2 == 0:
        half = x.shape[1] // 2
        x = np.maximum(x[:, :half], x[:, half:])
    return x if x.shape[1] == 1 else x.max(1, keepdims=True)


def _added(x: np.ndarray, first: np.ndarray, order: np.ndarray | None = None, most: int = 64) -> np.ndarray:
    """Sums of the rows, in this order, from each place to the next: long runs one by one, the k-th rows of all others at once."""
    order = np.arange(len(x)) if order is None else order
    size = np.diff(np.append(first, len(order)))
    out = x.take(order[first], 0)
    for i in np.flatnonzero(size > most).tolist():
        out[i] = x.take(order[first[i] : first[i] + size[i]], 0).sum(0)
    live = np.flatnonzero((size > 1) & (size <= most))
    live = live[np.argsort(-size[live], kind="stable")]  # the longest first: those that have a k-th row are a beginning
    if len(live):
        at, total = first[live], out.take(live, 0)
        left = np.searchsorted(-size[live], -np.arange(1, size[live[0]]))
        for k, n in enumerate(left.tolist(), 1):
            total[:n] += x.take(order[at[:n] + k], 0)
        out[live] = total
    return out


class Weights:
    """Both tables; bias: logarithms of the classes' and the listed tokens' shares."""

    def __init__(self, class_bias: np.ndarray, token_bias: np.ndarray, tables: dict[str, np.ndarray] | None = None):
        self.class_bias, self.token_bias = class_bias.astype(np.float32), token_bias.astype(np.float32)
        self.tables = tables or {"class": np.zeros((ROWS, CLASSES), np.float32), "token": np.zeros((ROWS, WIDTH), np.float32)}

    def copied(self) -> Weights:
        return Weights(self.class_bias, self.token_bias, {k: v.copy() for k, v in self.tables.items()})

    @staticmethod
    def features(last: np.ndarray, other: np.ndarray, group: np.ndarray | None = None) -> list[np.ndarray]:
        """The rows of the features; group: the class that a token is known to be in."""
        kind, at = (0, 0) if group is None else (3, group << 32)
        return [_slot(last | at, kind + 1), _slot(other | at, kind + 2), _slot(last << 16 | other | at, kind + 3)]

    def _sums(self, name: str, rows: list[np.ndarray], group: np.ndarray | None) -> np.ndarray:
        """Sums of the features' weights, less the greatest of each token."""
        table = self.tables[name]
        x = table.take(rows[0], 0)
        for r in rows[1:]:
            x += table.take(r, 0)
        x += self.class_bias if group is None else self.token_bias.take(group, 0)
        x -= _greatest(x)
        return x

    def log_shares(self, name: str, rows: list[np.ndarray], group: np.ndarray | None = None) -> np.ndarray:
        """Logarithms of the softmax, for each token."""
        x = self._sums(name, rows, group)
        return x - np.log(np.exp(x).sum(1, keepdims=True))

    def shares(self, name: str, rows: list[np.ndarray], group: np.ndarray | None = None) -> np.ndarray:
        """The softmax, for each token."""
        x = self._sums(name, rows, group)
        np.exp(x, out=x)
        x /= x.sum(1, keepdims=True)
        return x

    def log_share(self, name: str, rows: list[np.ndarray], place: np.ndarray, group: np.ndarray | None = None) -> np.ndarray:
        """The logarithm of one place of the softmax, for each token."""
        x = self._sums(name, rows, group)
        found = x[np.arange(len(x)), place].astype(float)
        np.exp(x, out=x)
        return found - np.log(x.sum(1))


class Trainer:
    """Steps of falling size on the rows of the weights, in proportion to the size of all gradients of a row so far."""

    def __init__(self, weights: Weights):
        self.weights = weights
        self.past = {k: np.zeros(ROWS, np.float32) for k in weights.tables}

    def _step(self, name: str, rows: list[np.ndarray], error: np.ndarray) -> None:
        table, past = self.weights.tables[name], self.past[name]
        for r in rows:
            order = np.argsort(r, kind="stable")
            ordered = r[order]
            first = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]]))
            at = ordered[first]
            total = _added(error, first, order)
            past[at] += np.einsum("ij,ij->i", total, total)
            total *= RATE
            total /= np.sqrt(past[at] + 1.0)[:, None]
            table[at] = table.take(at, 0) - total

    def train(self, last: np.ndarray, other: np.ndarray, stream: np.ndarray, symbols: Symbols) -> None:
        """One step over tokens with the symbols before them."""
        w = self.weights
        rows = w.features(last, other)
        error = w.shares("class", rows)
        error[np.arange(len(stream)), symbols.trained[stream]] -= 1
        self._step("class", rows, error)
        listed = np.flatnonzero(stream < LISTED)
        if len(listed):
            group, place = stream[listed] // WIDTH, stream[listed] % WIDTH
            rows = w.features(last[listed], other[listed], group)
            error = w.shares("token", rows, group)
            error[np.arange(len(listed)), place] -= 1
            self._step("token", rows, error)


def log_probabilities(weights: Weights, last: np.ndarray, other: np.ndarray, stream: np.ndarray, symbols: Symbols) -> np.ndarray:
    """Natural logarithms of the tokens' shares; of a token that is not listed, its class's share."""
    out = np.zeros(len(stream))
    for a in range(0, len(stream), BATCH):
        s, x, y = stream[a : a + BATCH], last[a : a + BATCH], other[a : a + BATCH]
        found = weights.log_share("class", weights.features(x, y), symbols.scored[s])
        listed = np.flatnonzero(s < LISTED)
        if len(listed):
            group = s[listed] // WIDTH
            found[listed] += weights.log_share("token", weights.features(x[listed], y[listed], group), s[listed] % WIDTH, group)
        out[a : a + BATCH] = found
    return out


_STREAM = "run long, doc_ids array<long>, apart array<boolean>, n_tokens array<int>, n_known array<int>, base array<double>, rest array<double>, symbols binary"


def _streams(total: int, different: int, ends: int, ending_total: np.ndarray, ending_different: np.ndarray):
    """A run as symbols; facts: the count and the symbol of each of its terms."""
    least = total + SMOOTH * (different + 1)

    def streamed(run: dict, facts: dict[str, np.ndarray]) -> pa.Table:
        count, symbol = facts["c"], facts["symbol"]
        code, n = run_tables.unpacked(run["codes"].as_py(), len(count)), run["n_words"].values.to_numpy().astype(np.int64)
        base = np.log10((count + SMOOTH) / least)
        ending = np.where(symbol < LISTED, 0, (symbol - LISTED) % ENDINGS)
        own = (symbol >= LISTED) & (symbol < LISTED + 2 * ENDINGS)
        rest = np.where(own, np.log10((count + SMOOTH) / np.maximum(ending_total[ending] + SMOOTH * ending_different[ending], SMOOTH)), 0.0)
        bounds = np.concatenate([[0], np.cumsum(n)])
        sums = lambda x: np.diff(np.concatenate([[0.0], np.cumsum(x[code])])[bounds])
        whole = lambda c: pa.ListArray.from_arrays(pa.array([0, len(n)], pa.int32()), run[c].values)
        made = {
            "run": pa.array([run["run"].as_py()]), "doc_ids": whole("doc_ids"), "apart": whole("apart"), "n_tokens": n + 1, "n_known": sums((count > 0).astype(float)).astype(np.int64) + (ends > 0),
            "base": sums(base) + np.log10((ends + SMOOTH) / least), "rest": sums(rest), "symbols": np.insert(symbol[code], bounds[1:], 0).astype("<u2").tobytes(),
        }
        listed = lambda x, kind: pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), pa.array(x, kind))
        columns = [made["run"], made["doc_ids"], made["apart"], *(listed(made[c], pa.int32()) for c in ("n_tokens", "n_known")), *(listed(made[c], pa.float64()) for c in ("base", "rest")), pa.array([made["symbols"]], pa.binary())]
        return pa.table(columns, names=list(made))

    return streamed


def _flat(batch: pa.RecordBatch, i: int, name: str) -> np.ndarray:
    return batch[name][i].values.to_numpy(zero_copy_only=False)


def _tokens(batch: pa.RecordBatch, i: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(symbols, where texts start, tokens of each) of a run."""
    size = _flat(batch, i, "n_tokens").astype(np.int64)
    return np.frombuffer(batch["symbols"][i].as_py(), "<u2").astype(np.int64), np.cumsum(size) - size, size


_CHANGES = "name string, block int, rows binary, delta binary"


def _round(sent):
    """Trains a copy of the weights on a task's runs; gives its changes in blocks of rows."""

    def run(batches):
        start = sent.value
        now, symbols = start.copied(), Symbols()
        trainer = Trainer(now)
        held: list[tuple[np.ndarray, ...]] = []
        waiting = 0

        def step():
            nonlocal held, waiting
            last, other, stream = (np.concatenate([x[k] for x in held]) for k in range(3))
            for a in range(0, len(stream), BATCH):
                trainer.train(last[a : a + BATCH], other[a : a + BATCH], stream[a : a + BATCH], symbols)
            held, waiting = [], 0

        for batch in batches:
            for i in range(batch.num_rows):
                stream, starts, size = _tokens(batch, i)
                mine = ~np.repeat(_flat(batch, i, "apart").astype(bool), size)
                last, other = history(stream, symbols, starts)
                held.append((last[mine], other[mine], stream[mine]))
                waiting += int(mine.sum())
                if waiting >= 16 * BATCH:
                    step()
        if waiting:
            step()
        for name, table in now.tables.items():
            changed = np.flatnonzero(trainer.past[name] > 0)
            for block in np.unique(changed // BLOCK).tolist():
                rows = changed[changed // BLOCK == block]
                values = (name, block, rows.astype(np.int64).tobytes(), (table[rows] - start.tables[name][rows]).astype("<f2").tobytes())
                yield pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(values, (pa.string(), pa.int32(), pa.binary(), pa.binary()), strict=True)], names=["name", "block", "rows", "delta"])
        words.give_back()

    return run


def _averaged(frame: pd.DataFrame) -> pd.DataFrame:
    """The mean change of each row of a block, over the tasks that changed it."""
    start, width = int(frame["block"].iloc[0]) * BLOCK, CLASSES if frame["name"].iloc[0] == "class" else WIDTH
    total, n = np.zeros((BLOCK, width)), np.zeros(BLOCK)
    for rows, delta in frame[["rows", "delta"]].itertuples(index=False):
        at = np.frombuffer(rows, np.int64) - start
        total[at] += np.frombuffer(delta, "<f2").reshape(-1, width)
        n[at] += 1
    at = np.flatnonzero(n)
    mean = (total[at] / n[at, None]).astype(np.float32)
    return pd.DataFrame({"name": [frame["name"].iloc[0]], "block": [frame["block"].iloc[0]], "rows": [(at + start).tobytes()], "delta": [mean.tobytes()]})


def train(streams: DataFrame, start: Weights, rounds: int = ROUNDS) -> Weights:
    """start, changed by one reading of the streams that are not apart.

    As many tasks train as the session has cores, so that what is averaged does not grow
    with the corpus; the driver holds one set of weights, whose size is fixed.  The means
    of a round are a table, of which the driver reads one part after the other.
    """
    spark = streams.sparkSession
    for k in range(rounds):
        sent = spark.sparkContext.broadcast(start)
        part = streams.filter(F.pmod(F.xxhash64("run"), F.lit(rounds)) == k).select("n_tokens", "apart", "symbols").coalesce(spark.sparkContext.defaultParallelism)
        changes = part.mapInArrow(_round(sent), _CHANGES).repartition(2 * ROWS // BLOCK, "name", "block")
        means = stored(changes.groupBy("name", "block").applyInPandas(_averaged, _CHANGES), "changes", plain=True)
        sent.destroy()
        for change in means.toLocalIterator():
            rows = np.frombuffer(change.rows, np.int64)
            start.tables[change.name][rows] += np.frombuffer(change.delta, np.float32).reshape(len(rows), -1)
        forget(means)
    release_shuffles(spark)
    return start


def _score(sent):
    def score(batches):
        symbols = Symbols()
        for batch in batches:
            for i in range(batch.num_rows):
                stream, starts, size = _tokens(batch, i)
                found = log_probabilities(sent.value, *history(stream, symbols, starts), stream, symbols)
                total = np.add.reduceat(found, starts) / np.log(10) + _flat(batch, i, "rest")
                columns = [batch["doc_ids"][i].values, batch["apart"][i].values, *(pa.array(_flat(batch, i, c).astype(np.int64)) for c in ("n_tokens", "n_known")), pa.array(_flat(batch, i, "base")), pa.array(total)]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "held_out", "n_tokens", "n_known", "base_score", "score"])
        words.give_back()

    return score


def _ending(term: Column) -> Column:
    return F.pmod(F.crc32(F.substring(term, -2, 2)), F.lit(ENDINGS)).cast("int")


def scored(docs: DataFrame, apart: Column, rounds: int = ROUNDS) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of each row of docs (an integer doc_id, text).

    apart: true for the rows that are not learnt from.  Words are between ASCII blanks,
    with A-Z lower-cased; a text ends with one more token.  Null and empty texts have
    that end only.  A text that is not known at all gets the shares of unknown words.
    Rows that share an id (null is one) are documents of their own.  Other columns are left out.
    """
    spark = docs.sparkSession
    own = docs.select("doc_id", "text", apart.alias("apart"))
    runs = run_tables.kept(run_tables.encoded(own, words.space_split_table(), run_tables.bucket_count(own)), "runs")
    found = run_tables.dictionary(runs)
    vocabulary = found.withColumnRenamed("s", "c")
    ends = runs.agg(F.sum(F.size(F.filter("apart", lambda x: ~x)))).head()[0] or 0
    row = vocabulary.agg(F.sum("c").alias("c"), F.count_if(F.col("c") > 0).alias("n")).head()
    total, different = (row.c or 0) + ends, row.n + (ends > 0)
    # A fixed number of the most frequent words.
    top = vocabulary.filter("c > 1").orderBy(F.desc("c"), "term").limit(LISTED - 1).collect()
    listed = spark.createDataFrame([(r.term, i + 1) for i, r in enumerate(top)], "term string, listed int")
    known = vocabulary.join(F.broadcast(listed), "term", "left").withColumn("ending", _ending(F.col("term")))
    group = F.when(F.col("c") > 1, 0).when(F.col("c") == 1, 1).otherwise(2)
    known = known.withColumn("symbol", F.coalesce("listed", LISTED + group * ENDINGS + F.col("ending")))
    by_ending = known.filter("listed IS NULL AND c > 0").groupBy("ending").agg(F.sum("c").alias("c"), F.count("*").alias("n"), F.sum(F.when(F.col("c") == 1, 1).otherwise(0)).alias("once")).collect()
    ending_total, ending_different, mass = np.zeros(ENDINGS), np.zeros(ENDINGS), np.zeros(CLASSES)
    for r in by_ending:
        ending_total[r.ending], ending_different[r.ending] = r.c, r.n
        mass[LISTED_CLASSES + r.ending] += r.c - r.once
        mass[UNKNOWN] += r.once
    counts = np.zeros(LISTED)
    counts[0] = ends
    counts[1 : len(top) + 1] = [r.c for r in top]
    mass[:LISTED_CLASSES] = counts.reshape(-1, WIDTH).sum(1)
    # Classes and places without tokens keep a share too small to tell, so that shares of tokens that exist add up to 1.
    logs = lambda x, all_: np.log(np.where(x > 0, x, 1e-30) / np.maximum(all_, 1))
    smooth = np.where((mass > 0) | (np.arange(CLASSES) == UNKNOWN), mass + 0.5, 0)
    smooth[LISTED_CLASSES:UNKNOWN] = np.where(ending_different > 0, mass[LISTED_CLASSES:UNKNOWN] + 0.5, 0)
    grid = counts.reshape(-1, WIDTH)
    start = Weights(logs(smooth, smooth.sum()), logs(grid, grid.sum(1, keepdims=True)))
    streams = run_tables.kept(run_tables.with_facts(runs, known, ("c", "symbol"), _streams(total, different, ends, ending_total, ending_different), _STREAM), "streams")
    forget(runs)
    forget(found)
    sent = spark.sparkContext.broadcast(train(streams, start, rounds))
    found = streams.mapInArrow(_score(sent), "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double")
    return found.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(total).cast("long").alias("train_tokens"), "base_score", "score")


def held_out(doc_id: Column, parts: int = 10, part: int = 0) -> Column:
    """A fold of the documents by their ids; a null id is written as nothing."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))), F.lit(parts)) == part


def op13_maxent(spark, sf_dir: str) -> DataFrame:
    """scored of documents, learnt from those outside the fold; nulls and repeats: as scored has them.  An empty table gives no rows."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return scored(docs, held_out(F.col("doc_id").cast("long")))
