"""Counterfactual-regularised toxicity classifier.

A linear model over the words of a text, and the beginnings of its words, each counted
once.  It is fitted to labelled texts; for each of these that names a group of people,
a second text has the name swapped for the next of the same kind, and the squared change
of the score is penalised.  So the name itself gets no weight of its own, and a neutral
mention of a group does not raise the score.

The model is fitted on the driver to at most SAMPLE labelled rows, taken by the order of
a hash of their ids; the executors count and choose the features and return those alone.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import words
from .components import stored
from .features import Adam, hashed, sigmoid, word_starts

BITS = 20
STARTS = (4, 5, 6)
#: Labelled rows to fit to, features kept, and the weight of the counterfactual penalty.
SAMPLE = 12_000
FEATURES = 4096
PENALTY = 5.0
RIDGE = 1e-4
#: Where the score is 0.5: a part of the neutral texts that is flagged costs so many times as much as the same part of the toxic ones that is missed.
FALSE_COST = 10.0
#: Names of groups by kind, the kind's neutral word among them.
GROUPS = (
    ("people", "women", "men", "girls", "boys", "transgender", "nonbinary"),
    ("believers", "muslims", "christians", "jews", "hindus", "buddhists", "atheists", "catholics", "sikhs"),
    ("person", "woman", "man", "girl", "boy"),
    ("believer", "muslim", "christian", "jew", "hindu", "buddhist", "atheist", "catholic", "sikh", "jewish"),
    ("human", "gay", "lesbian", "bisexual", "straight", "queer", "heterosexual", "homosexual"),
    ("citizen", "black", "white", "asian", "african", "latino", "arab", "european", "american", "mexican", "chinese", "indian"),
    ("persona", "mujer", "hombre", "mujeres", "hombres", "musulmán", "cristiano", "judío", "gitano", "extranjero"),
    ("personne", "femme", "homme", "femmes", "hommes", "musulman", "chrétien", "juif", "étranger", "noir", "arabe"),
    ("mensch", "frau", "mann", "frauen", "männer", "christ", "jude", "ausländer", "türke", "schwarze"),
    ("adult", "old", "young", "elderly", "disabled", "blind", "deaf", "immigrants", "refugees"),
)


def _term_hashes(terms: list[str]) -> tuple[np.ndarray, list[np.ndarray]]:
    """Word hash of each term, and the features that it has."""
    out, own = [], []
    for t in terms:
        data = np.frombuffer(t.encode(), np.uint8)
        c = words.Chunk(0, data, np.array([0, len(data)]), words.alnum_table())
        out.append(c.hashes()[0])
        own.append(np.concatenate([hashed(c.hashes(), BITS), *(hashed(h, BITS) for _, h in word_starts(c, STARTS))]))
    return np.array(out, np.uint64), own


def _pairs(c: words.Chunk, only: np.ndarray | None = None, live: np.ndarray | None = None) -> np.ndarray:
    """row << BITS | feature of each word and beginning, once; only: of the words that it marks; live: of the features that it marks."""
    row, starts = c.row_of_word(), word_starts(c, STARTS)
    row, feature = np.concatenate([row, *(row[i] for i, _ in starts)]), np.concatenate([hashed(c.hashes(), BITS), *(hashed(h, BITS) for _, h in starts)])
    if only is not None:
        marked = np.concatenate([only, *(only[i] for i, _ in starts)])
        row, feature = row[marked], feature[marked]
    if live is not None:
        row, feature = row[live[feature]], feature[live[feature]]
    return np.unique(row << BITS | feature)


def _lists(pairs: np.ndarray, rows: int) -> pa.Array:
    """The features of each row."""
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(pairs >> BITS, np.arange(rows + 1)).astype(np.int32)), pa.array((pairs & ((1 << BITS) - 1)).astype(np.int32)))


def _sampled(batches):
    """features of a text, and those gone and come when its names of groups are swapped."""
    swaps = {a: b for kind in GROUPS for a, b in zip(kind, (*kind[1:], kind[0]), strict=True)}
    term, own = _term_hashes(list(swaps))
    other = [own[list(swaps).index(b)] for b in swaps.values()]
    order = np.argsort(term)
    for batch in batches:
        out = [[], [], []]
        for c in words.chunks(batch.column(0), words.alnum_table(), lower=True):
            features = _pairs(c)
            h = c.hashes()
            at = np.minimum(np.searchsorted(term[order], h), len(term) - 1)
            named = term[order][at] == h
            row = c.row_of_word()
            # The text with its names swapped: the other words' features, and those of the names put in.
            put_in = [np.int64(r) << BITS | other[t] for r, t in set(zip(row[named].tolist(), order[at[named]].tolist(), strict=True))]
            swapped = np.unique(np.concatenate([_pairs(c, ~named), *put_in])) if named.any() else features
            for held, pairs in zip(out, (features, np.setdiff1d(features, swapped, True), np.setdiff1d(swapped, features, True)), strict=True):
                held.append(_lists(pairs, len(c)))
        none = pa.array([], pa.list_(pa.int32()))
        yield pa.RecordBatch.from_arrays([batch.column(1), *(pa.concat_arrays(x) if x else none for x in out)], names=["label", "features", "gone", "come"])


class Model:
    """A weight for each hashed feature, and a bias."""

    def __init__(self, weights: np.ndarray, bias: float):
        self.weights, self.bias = weights, bias

    def scores(self, c: words.Chunk) -> np.ndarray:
        pair = _pairs(c, live=self.weights != 0)
        return sigmoid(self.bias + np.bincount(pair >> BITS, self.weights[pair & ((1 << BITS) - 1)], len(c)))


class Objective:
    """Mean logistic loss + ridge + penalty * mean squared change of the scores of swapped texts, and its gradient.

    features, gone and come are (row, number of the chosen feature) of every text.
    """

    def __init__(self, y, features, gone, come, size: int, penalty: float):
        self.y, self.size, self.penalty = y, size, penalty
        self.row, self.col = features
        swapped = np.unique(np.concatenate([gone[0], come[0]]))
        self.swapped = swapped
        self.gone, self.come = ((np.searchsorted(swapped, r), c) for r, c in (gone, come))

    def __call__(self, w: np.ndarray, b: float) -> tuple[float, np.ndarray, float]:
        n = len(self.y)
        f = b + np.bincount(self.row, w[self.col], n)
        p = sigmoid(f)
        value = float(np.mean(np.logaddexp(0, f) - self.y * f) + RIDGE / 2 * (w @ w))
        g = (p - self.y) / n
        gw = RIDGE * w
        m = len(self.swapped)
        if m:
            after = f[self.swapped] - np.bincount(self.gone[0], w[self.gone[1]], m) + np.bincount(self.come[0], w[self.come[1]], m)
            p1, p2 = p[self.swapped], sigmoid(after)
            value += self.penalty * float(np.mean((p1 - p2) ** 2))
            d = 2 * self.penalty * (p1 - p2) / m
            back = d * p2 * (1 - p2)
            g[self.swapped] += d * p1 * (1 - p1) - back
            gw = gw + np.bincount(self.gone[1], back[self.gone[0]], self.size) - np.bincount(self.come[1], back[self.come[0]], self.size)
        return value, gw + np.bincount(self.col, g[self.row], self.size), float(g.sum())


def place(margin: np.ndarray, y: np.ndarray, cost: float = FALSE_COST) -> float:
    """The margin to flag from, of all between two neighbouring ones of the fitted texts, that costs least; of equals the greatest."""
    values, at = np.unique(margin, return_inverse=True)
    toxic, neutral = (np.bincount(at, y == k, len(values)) for k in (1, 0))
    missed = np.concatenate([[0], np.cumsum(toxic)]) / max(1, toxic.sum())
    flagged = 1 - np.concatenate([[0], np.cumsum(neutral)]) / max(1, neutral.sum())
    best = len(values) - int(np.argmin((missed + cost * flagged)[::-1]))
    return float(values[0] - 1 if best == 0 else values[-1] + 1 if best == len(values) else (values[best - 1] + values[best]) / 2)


def fit(label: np.ndarray, chosen: np.ndarray, features: list, gone: list, come: list, penalty: float = PENALTY, rounds: int = 300) -> Model:
    """Logistic loss + ridge + penalty * squared change of the scores of swapped texts.

    chosen: the features that may have a weight, in order; the lists have no others.
    The bias is then moved so that the score is 0.5 at the place of least cost.
    """
    n, size = len(label), 1 << BITS
    y = np.asarray(label, float)
    bias = float(np.log((y.sum() + 0.5) / (n - y.sum() + 1)))
    weights = np.zeros(size, np.float32)
    if not 0 < y.sum() < n or not len(chosen):
        return Model(weights, bias)

    def matrix(lists):
        r = np.repeat(np.arange(len(lists)), [len(x) for x in lists])
        return r, np.searchsorted(chosen, np.concatenate([*lists, np.zeros(0, np.int32)]))

    loss = Objective(y, matrix(features), matrix(gone), matrix(come), len(chosen), penalty)
    w, b = np.zeros(len(chosen)), bias
    step, step_b = Adam(len(chosen), 0.05), Adam((), 0.05)
    for _ in range(rounds):
        _, gw, gb = loss(w, b)
        w += step.step(gw)
        b += float(step_b.step(np.array(gb)))
    w[np.abs(w) < 1e-3] = 0
    weights[chosen] = w
    return Model(weights, b - place(b + np.bincount(loss.row, w[loss.col], n), y))


def fold(doc_id, parts: int):
    """crc32 of an id's text, modulo parts."""
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(parts))


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, parts: int, held: int, sample: int) -> DataFrame:
    """(text, label) of at most ``sample`` labelled rows outside the held-out fold, in the order of a hash of their ids; repeated ids are one row."""
    known = labels.filter(F.col(label).isNotNull() & (fold(F.col("doc_id"), parts) != held)).groupBy("doc_id").agg(F.max(label).cast("int").alias("label"))
    # At most `sample` ids: a bounded side to send to the tasks; and one text, the least, of each id.
    chosen = known.orderBy(F.xxhash64(F.col("doc_id")), "doc_id").limit(sample)
    held = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
    return held.groupBy("doc_id").agg(F.min(F.struct(F.coalesce("text", F.lit("")).alias("text"), "label")).alias("x")).select("x.text", "x.label")


def telling_features(rows: DataFrame, kept: int = FEATURES) -> np.ndarray:
    """The features that differ most, in standard errors, between the labels; counted by the executors."""
    n, toxic = rows.agg(F.count("*"), F.coalesce(F.sum("label"), F.lit(0))).head()
    if not 0 < toxic < n:
        return np.zeros(0, np.int32)
    share = toxic / n
    held = rows.select("label", F.explode("features").alias("f")).groupBy("f").agg(F.count("*").alias("both"), F.sum("label").alias("toxic"))
    z = F.abs((F.col("toxic") - F.col("both") * share) / F.sqrt(F.col("both") * (share * (1 - share)) + 1))
    best = held.filter(F.col("both") >= min(5, max(2, n // 100))).select("f", z.alias("z")).filter("z > 2").orderBy(F.desc("z"), "f").limit(kept)
    return np.array(sorted(r["f"] for r in best.collect()), np.int32)


def _only(chosen: np.ndarray):
    """Lists of features without those that are not chosen."""

    def only(batches):
        for batch in batches:
            out = [batch.column(0)]
            for k in (1, 2, 3):
                lists = batch.column(k)
                flat, offsets = lists.values.to_numpy(zero_copy_only=False), np.asarray(lists.offsets)
                keep = np.isin(flat, chosen)
                total = np.concatenate([[0], np.cumsum(keep)])
                out.append(pa.ListArray.from_arrays(pa.array((total[offsets] - total[offsets[0]]).astype(np.int32)), pa.array(flat[offsets[0] : offsets[-1]][keep[offsets[0] : offsets[-1]]])))
            yield pa.RecordBatch.from_arrays(out, names=["label", "features", "gone", "come"])

    return only


def train(docs: DataFrame, labels: DataFrame, parts: int = 5, held: int = 0, sample: int = SAMPLE, penalty: float = PENALTY) -> Model:
    """Fits a model; the driver gets the chosen features of the sample only."""
    kind = "label int, features array<int>, gone array<int>, come array<int>"
    rows = stored(labelled_sample(docs, labels, "toxic", parts, held, sample).mapInArrow(_sampled, kind), "toxicity-sample")
    chosen = telling_features(rows)
    got = rows.mapInArrow(_only(chosen), kind).toArrow().combine_chunks()
    label = got["label"].to_numpy()
    lists = {k: [np.asarray(x.values, np.int32) for x in got[k]] for k in ("features", "gone", "come")}
    order = sorted(range(len(label)), key=lambda i: (label[i], lists["features"][i].tobytes()))
    return fit(label[order], chosen, *([v[i] for i in order] for v in lists.values()), penalty=penalty)


def _scorer(model):
    def score(batches):
        m = model.value
        for batch in batches:
            at = batch.schema.get_field_index("text")
            out = [np.zeros(0), *(m.scores(c) for c in words.chunks(batch.column(at), words.alnum_table(), lower=True))]
            keep = [i for i in range(batch.num_columns) if i != at]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in keep), pa.array(np.concatenate(out), pa.float64())], names=[*(batch.schema.names[i] for i in keep), "score"])

    return score


def score(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, score): every row's whole text; null and empty texts get the model's bias."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    return docs.select("doc_id", "text").mapInArrow(_scorer(sent), f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, score double")


def op4_toxicity(spark, sf_dir: str) -> DataFrame:
    """A null doc_id is in no fold and is not held out; without labelled rows every score is the same and below 0.5."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    scored = score(docs, train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
    return scored.select("doc_id", F.coalesce(fold(F.col("doc_id"), 5) == 0, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
