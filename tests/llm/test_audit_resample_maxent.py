"""Filter audit, resampling and language model against plain Python."""

import hashlib
import itertools
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from wordloom.llm import filter_audit, maxent, resample

SPACE, ALNUM = r"[^\x20\x09-\x0D]+", r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
CLASHES = ["part", "mask", "words", "n", "run", "term", "apart", "score", "c", "first", "digest", "own"]


def _lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(5)
    words = ["the", "of", "River", "stone", "É", "wind.", "Night", "fox", "42", "x|y", "ÑO"]
    prose = lambda n: " ".join(rng.choice([*words, f"r{rng.randint(0, 900)}"]) for _ in range(n))
    out = [(None, None, "s1"), (1, None, None), (2, "", "s1"), (3, " \n\t ", ""), (4, "one two", "s1"), (5, "one two", None), (6, "one two", "s1"), (6, "one two", "s1"), (None, "one two", "s1")]
    for i in range(10, 90):
        out.append((i, prose(rng.randint(5, 120)).replace(" ", rng.choice([" ", "\n", "\t", " \x0b"]), 3), f"s{i % 3}"))
    copied = prose(80)
    out += [(i, copied, "s0") for i in range(100, 130)]
    out += [(200, "A $ B " * 40, "s1"), (201, prose(20_000), "s2"), (202, "SHOUT " * 60, "s2"), (5, prose(60), "s2")]
    return out


@pytest.fixture(scope="module")
def docs(spark, rows):
    base = spark.createDataFrame([(i, t, s) for i, t, s in rows], "doc_id long, text string, source string")
    return base.withColumns({name: F.lit(f"own {name}") for name in CLASHES}).repartition(3)


@pytest.fixture(scope="module")
def labels(spark):
    made = [(i, i % 2, int(i % 5 == 0)) for i in range(4, 130)] + [(4, 1, 1), (None, 1, 1), (10, None, None)]
    return spark.createDataFrame(made, "doc_id long, quality int, toxic int")


def _plain_audit(rows, labels):
    good, toxic = (defaultdict(bool) for _ in range(2))
    for i, q, t in labels:
        if i is not None:
            good[i] |= q == 1
            toxic[i] |= t == 1
    least = {}
    for i, t, _ in rows:
        if i is not None:
            least[t or ""] = min(i, least.get(t or "", i))
    parts = defaultdict(list)
    for i, t, s in rows:
        t, ws = t or "", re.findall(SPACE, t or "")
        fails = set()
        fails |= {"A"} if len(ws) < 50 else set()
        fails |= {"B"} if 100 * len(set(ws)) < 65 * len(ws) else set()
        fails |= {"C"} if 100 * len(re.findall("[A-Z]", t)) > 5 * len(t) else set()
        fails |= {"D"} if re.search(r"[#$%&*|]", t) else set()
        fails |= {"E"} if i is not None and least[t] < i else set()
        parts[s or ""].append((fails, i is not None and good[i], i is not None and toxic[i]))
    out = {}
    for part, docs in parts.items():
        removed_by = Counter()
        for order in itertools.permutations("ABCDE"):
            for step, f in enumerate(order, 1):
                early = set(order[: step - 1])
                here = [d for d in docs if f in d[0] and not early & d[0]]
                kept = sum(not (early | {f}) & d[0] for d in docs)
                removed_by[f] += len(here)
                out[part, "".join(order), step] = [kept, len(here), sum(f in d[0] and bool(early & d[0]) for d in docs), sum(d[0] == {f} for d in docs), sum(d[1] for d in here), sum(d[2] for d in here)]
        for (p, order, step), v in out.items():
            if p == part:
                v.append(removed_by[order[step - 1]])
    return {k: tuple(v) for k, v in out.items()}


def test_filter_audit(docs, labels, rows):
    found = filter_audit.audit(docs, labels)
    got = {(r.part, r.filter_order, r.step): tuple(r)[3:] for r in found.collect()}
    assert got == _plain_audit(rows, [tuple(r) for r in labels.collect()])
    assert {c: t for c, t in found.dtypes if c != "part"} == {"filter_order": "string", "step": "int"} | dict.fromkeys("kept removed redundant unique_fails good_lost toxic_lost shapley".split(), "bigint")
    assert filter_audit.audit(docs.filter("false"), labels).count() == 0
    assert {r.good_lost for r in filter_audit.audit(docs, labels.filter("false")).collect()} == {0}


def _plain_weights(rows, target, most, buckets):
    def features(text):
        ws = re.findall(ALNUM, _lower(text))
        return ws, [" ".join(ws[i : i + k]) for k in range(1, most + 1) for i in range(len(ws) - k + 1)]

    bucket = lambda f: zlib.crc32(f.encode()) % buckets
    s, t = Counter(), Counter()
    for _, text, _ in rows:
        s.update(map(bucket, features(text)[1]))
    for text in target:
        t.update(map(bucket, features(text)[1]))
    big_s, big_t = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (big_s + buckets) / ((s[b] + 1) * (big_t + buckets))))
    out = []
    for i, text, _ in rows:
        ws, fs = features(text)
        out.append((i, len(ws), len(fs), sum(gain(bucket(f)) for f in fs) // len(fs) if fs else 0))
    return out


@pytest.mark.parametrize(("most", "buckets"), [(1, 10_000), (3, 97)])
def test_resampling(spark, docs, rows, most, buckets):
    texts = [None, "", "the River of Night", "the stone of the river, the fox", "É ñ of of of"]
    target = spark.createDataFrame([(k, x) for k, x in enumerate(texts)], "item_id long, text string")
    found = resample.weights(docs, target, most, buckets)
    want = _plain_weights(rows, texts, most, buckets)
    assert Counter(tuple(r) for r in found.collect()) == Counter(want)
    got = [tuple(r) for r in resample.drawn(found, percent=30).select("doc_id", "n_words", "n_features", "weight", "score", "rank").collect()]
    scored = []
    for i, n, f, w in want:
        h = int(hashlib.sha256(f"2024:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        scored.append((i, n, f, w, w + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))))
    assert Counter(g[:5] for g in got) == Counter(scored)
    able = [x for x in scored if x[1] >= 20]
    ranked = sorted(able, key=lambda x: (-x[4], x[0] is not None, x[0] or 0))[: len(able) * 30 // 100]
    assert [g[:5] for g in sorted((g for g in got if g[5]), key=lambda g: g[5])] == ranked and sorted(g[5] for g in got if g[5]) == list(range(1, len(ranked) + 1))
    assert resample.drawn(resample.weights(docs.filter("false"), target)).count() == 0
    assert {r.weight for r in resample.weights(docs, target.filter("false")).filter("n_features = 0").collect()} == {0}


def _plain_base(rows):
    apart = lambda i: zlib.crc32(b"" if i is None else str(i).encode()) % 10 == 0
    tokens = lambda text: [*re.findall(SPACE, _lower(text)), None]
    counts = Counter(w for i, t, _ in rows if not apart(i) for w in tokens(t))
    n, v = sum(counts.values()), len(counts)
    return [(i, apart(i), len(tokens(t)), sum(counts[w] > 0 for w in tokens(t)), n, round(sum(math.log10((counts[w] + 0.1) / (n + 0.1 * (v + 1))) for w in tokens(t)), 6)) for i, t, _ in rows]


def test_base_scores(docs, rows):
    found = maxent.scored(docs, maxent.held_out(F.col("doc_id"))).collect()
    got = [(r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in found]
    want = _plain_base(rows)
    assert Counter(g[:5] for g in got) == Counter(w[:5] for w in want)
    for g, w in zip(sorted(got, key=str), sorted(want, key=str), strict=True):
        assert g[:5] == w[:5] and abs(g[5] - w[5]) < 1e-4
    assert all(math.isfinite(r.score) and r.score < 0 for r in found)
    assert maxent.scored(docs.filter("false"), maxent.held_out(F.col("doc_id"))).count() == 0


def test_everything_may_be_held_out(docs):
    assert {r.n_known for r in maxent.scored(docs, F.lit(True)).collect()} == {0}


def test_words_before_are_learnt(spark):
    """A word is followed by its own partner, or by the partner of the word before it: unseen texts are likelier than by counts."""
    rng = random.Random(3)
    partner = {f"a{k}": f"b{k}" for k in range(40)}
    text = lambda: " ".join(x for _ in range(60) for a in [rng.choice(list(partner))] for x in (a, partner[a]))
    docs = spark.createDataFrame([(i, text()) for i in range(700)], "doc_id long, text string").repartition(4)
    found = maxent.scored(docs, maxent.held_out(F.col("doc_id")))
    gain = {r.held_out: r.g for r in found.groupBy("held_out").agg((F.sum(F.col("score") - F.col("base_score")) / F.sum("n_tokens")).alias("g")).collect()}
    assert gain[True] > 0.3 and gain[False] > 0.3


def test_shares_of_all_tokens_add_up_to_one():
    rng = np.random.default_rng(2)
    counts = np.zeros(maxent.LISTED)
    counts[:700] = rng.integers(1, 500, 700)
    bias = rng.random(maxent.CLASSES)
    grid = counts.reshape(-1, maxent.WIDTH)
    w = maxent.Weights(np.log(bias / bias.sum()), np.log(np.where(grid > 0, grid, 1e-30) / np.maximum(grid.sum(1, keepdims=True), 1)))
    trainer, symbols = maxent.Trainer(w), maxent.Symbols()
    stream = rng.integers(0, 700, 4000)
    last, other = maxent.history(stream, symbols, np.array([0, 1000]))
    for _ in range(3):
        trainer.train(last, other, stream, symbols)
    for x, y in ((0, 0), (5, 9), (1030, 12)):
        # Every listed token once, then one word of each ending's class, which shares it by counts, and the unknown word.
        every = np.concatenate([np.arange(maxent.LISTED), maxent.LISTED + np.arange(maxent.ENDINGS), [maxent.LISTED + 2 * maxent.ENDINGS]])
        p = np.exp(maxent.log_probabilities(w, np.full(len(every), x), np.full(len(every), y), every, symbols))
        assert abs(p.sum() - 1) < 1e-3 and (p >= 0).all()


def test_gradient_of_the_model():
    """A step goes down the slope that small differences of the loss show."""
    rng = np.random.default_rng(0)
    w = maxent.Weights(rng.normal(size=maxent.CLASSES), rng.normal(size=(maxent.LISTED_CLASSES, maxent.WIDTH)))
    symbols, stream = maxent.Symbols(), np.array([40, 3, 1050])
    last, other = maxent.history(stream, symbols, np.array([0]))
    assert last.tolist() == [0, 40, 3] and other.tolist() == [0, 0, 40]
    loss = lambda: -maxent.log_probabilities(w, last, other, stream, symbols).sum()
    row = int(w.features(last, other)[0][1])
    before, table = loss(), w.tables["class"]
    slopes = []
    for k in range(4):
        table[row, k] += 1e-2
        slopes.append((loss() - before) / 1e-2)
        table[row, k] -= 1e-2
    p = np.exp(w.log_shares("class", w.features(last, other)))
    p[np.arange(3), symbols.trained[stream]] -= 1
    at = w.features(last, other)[0] == row
    assert np.allclose(slopes, p[at].sum(0)[:4], atol=2e-2)
    maxent.Trainer(w).train(last, other, stream, symbols)
    assert loss() < before


def test_sums_and_shares_of_a_step_are_made_without_spare_passes():
    from wordloom.llm import maxent

    rng = np.random.default_rng(3)
    x = rng.normal(size=(500, 64)).astype(np.float32)
    first = np.array([0, 1, 2, 5, 200, 201, 499])
    assert np.allclose(maxent._added(x, first), np.add.reduceat(x, first), atol=1e-4)
    assert (maxent._greatest(x)[:, 0] == x.max(1)).all() and (maxent._greatest(x[:, :3])[:, 0] == x[:, :3].max(1)).all()
    w = maxent.Weights(rng.normal(size=maxent.CLASSES), rng.normal(size=(maxent.LISTED_CLASSES, maxent.WIDTH)))
    rows = w.features(np.arange(50), np.arange(50)[::-1].copy())
    logs = w.log_shares("class", rows)
    assert np.allclose(np.exp(logs), w.shares("class", rows), atol=1e-6)
    assert np.allclose(logs[np.arange(50), np.arange(50)], w.log_share("class", rows, np.arange(50)), atol=1e-5)


def test_driver_gets_a_round_in_parts(spark):
    """The changes of a round, more than the driver may get at once here, are added to the weights part by part."""
    rng = random.Random(5)
    docs = spark.createDataFrame([(i, " ".join(f"w{rng.randrange(1000)}" for _ in range(60))) for i in range(900)], "doc_id long, text string").repartition(4)
    conf, name, read = spark.sparkContext._jsc.sc().conf(), "spark.driver.maxResultSize", "spark.sql.files.maxPartitionBytes"
    before = conf.get(name, "1g")
    conf.set(name, "5m")
    spark.conf.set(read, "1m")
    try:
        assert maxent.scored(docs, maxent.held_out(F.col("doc_id")), rounds=1).count() == 900
    finally:
        conf.set(name, before)
        spark.conf.unset(read)


def test_rows_are_added_in_the_order_given():
    """Short and long runs of rows, taken in an order, give the sums of the sorted copy, bit by bit."""
    rng = np.random.default_rng(7)
    slot = np.minimum(rng.zipf(1.3, 3000), 500)
    x, order = rng.normal(size=(3000, 8)).astype(np.float32), np.argsort(slot, kind="stable")
    first = np.flatnonzero(np.diff(slot[order], prepend=-1))
    want = [np.cumsum(x[slot == k], 0, dtype=np.float32)[-1] for k in np.unique(slot)]
    assert np.array_equal(maxent._added(x, first, order), want) and np.array_equal(maxent._added(x[order], first), want)
    assert maxent._added(x[:1], np.array([0])).tolist() == x[:1].tolist()
