import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from wordloom.functions.expressions import unit
from wordloom.functions.kernels import Tree, huffman, joined
from wordloom.operators import enrich, gsea, network, shrink, text, train, vectors
from wordloom.sources import files


def _model(spark, rows, name="m"):
    return spark.createDataFrame([(name, w, [float(x) for x in v]) for w, v in rows], "model string, word string, vec array<float>")


@pytest.fixture(scope="module")
def plane(spark):
    return _model(spark, [("a", (1, 0)), ("b", (1, 0.1)), ("c", (0, 1)), ("d", (-1, 0)), ("z", (0, 0))])


def test_nearest_has_the_word_itself_first(spark, plane):
    got = vectors.nearest(plane, vectors.words_table(spark, ["a", "none"]), 3).orderBy("rank").collect()
    assert [r.word for r in got] == ["a", "b", "c"]
    assert got[0].cos == pytest.approx(1)


def test_average_drops_absent_words(spark, plane):
    got = vectors.average(plane, vectors.words_table(spark, ["a", "d", "none"])).head().vec
    assert got == [0, 0]


def test_cosine_of_a_zero_vector_is_null(spark, plane):
    got = vectors.cosines(plane, vectors.words_table(spark, ["a"])).filter("word = 'z'").head()
    assert got.cos is None


def test_network_edges_go_both_ways(spark, plane):
    model = plane.filter("word <> 'z'")
    nodes = network.nodes(model, "a", 2, 2)
    assert [r.label for r in nodes.orderBy("id").collect()] == ["a", "b"]
    edges = {(r["from"], r["to"]) for r in network.edges(model, nodes).collect()}
    assert edges == {(1, 2), (2, 1)}
    assert '"color": "red"' in network.to_json(nodes, network.edges(model, nodes))
    with pytest.raises(ValueError):
        network.nodes(model, "none")


def test_quantiles_of_a_small_table(spark):
    columns = {"x": (5, 2, 3), "y": (4, 1, 6), "z": (3, 4, 8)}
    sims = spark.createDataFrame([(f"w{i}", "h", m, float(v)) for m, vs in columns.items() for i, v in enumerate(vs)], "word string, header string, model string, cos double")
    got = {(r.key, r.model): r.norm for r in enrich.quantile_normalized(sims).collect()}
    low, mid, high = 2, 11 / 3, 19 / 3
    assert got[("w0-h", "x")] == pytest.approx(high) and got[("w1-h", "x")] == pytest.approx(low) and got[("w0-h", "y")] == pytest.approx(mid) and got[("w0-h", "z")] == pytest.approx(low)


def test_missing_cells_are_filled_or_dropped(spark):
    rows = [("a", "h", "x", 1.0), ("a", "h", "y", None), ("a", "h", "z", 3.0), ("b", "h", "x", None), ("b", "h", "y", None), ("b", "h", "z", 1.0), ("c", "h", "x", 0.0), ("c", "h", "y", 0.0), ("c", "h", "z", 0.0)]
    sims = spark.createDataFrame(rows, "word string, header string, model string, cos double")
    got = {(r.word, r.model): r.cos for r in enrich.imputed(enrich.filtered(sims)).collect()}
    assert got == {("a", "x"): 1, ("a", "y"): 2, ("a", "z"): 3, ("c", "x"): 0, ("c", "y"): 0, ("c", "z"): 0}


def _scores(spark, values):
    return spark.createDataFrame([("t", k, float(v)) for k, v in values.items()], "contrast string, key string, score double")


@pytest.mark.parametrize(("keys", "es", "edge"), [("ab", 1, "ab"), ("de", -1, "de")])
def test_enrichment_of_the_ends(spark, keys, es, edge):
    scores = _scores(spark, dict(zip("abcde", (5, 4, 3, 2, 1), strict=True)))
    sets = spark.createDataFrame([("s", k) for k in keys], "pathway string, key string")
    hits = gsea.hits(scores, sets, gsea.SetTest(min_size=1))
    assert gsea.enrichment(hits).head().es == pytest.approx(es)
    assert {r.key for r in gsea.leading_edge(hits).collect()} == set(edge)


def test_set_test_finds_a_planted_set(spark):
    rng = np.random.default_rng(0)
    values = {f"w{i:03}": rng.normal() + (2 if i < 15 else 0) for i in range(200)}
    sets = spark.createDataFrame([("up", f"w{i:03}") for i in range(15)] + [("none", f"w{i:03}") for i in range(50, 80)] + [("few", "w001")], "pathway string, key string")
    got = {r.pathway: r for r in gsea.set_test(_scores(spark, values), sets, gsea.SetTest(nperm=500)).collect()}
    assert set(got) == {"up", "none"}
    assert got["up"].pval < 0.01 and got["up"].nes > 1.5 and got["up"].padj <= 2 * got["up"].pval + 1e-9 and got["none"].pval > 0.05


def test_adjusted_values_rise_with_the_values(spark):
    p = spark.createDataFrame([("c", x) for x in (0.01, 0.02, 0.03, 0.5, 0.5)], "contrast string, pval double")
    got = [r.padj for r in gsea.adjusted(p, "contrast").orderBy("pval").collect()]
    assert got == pytest.approx([0.05, 0.05, 0.05, 0.5, 0.5])


def test_contrasts(spark):
    normed = spark.createDataFrame([(k, m, float(v)) for k, vs in {"p": (3, 1, 2), "q": (0, 5, 1)}.items() for m, v in zip("xyz", vs, strict=True)], "key string, model string, norm double")
    one = {(r.contrast, r.key): r.score for r in enrich.one_v_one(normed).collect()}
    assert one[("1v1: y-x", "p")] == -2 and one[("1v1: z-y", "q")] == -4 and len(one) == 6
    best = {(r.contrast, r.key): r.score for r in enrich.one_v_all(normed).collect()}
    assert best[("1v-all: x", "p")] == pytest.approx(1 / math.sqrt(2)) and best[("1v-all: y", "q")] == pytest.approx(1 / math.sqrt(2))
    groups = spark.createDataFrame([("g", "x"), ("g", "z")], "group_id string, model string")
    assert {r.key: round(r.score, 6) for r in enrich.group_contrasts(normed, groups).collect()} == {"p": round(1 / math.sqrt(2), 6), "q": round(-1 / math.sqrt(2), 6)}


def test_enrichment_asks_for_its_inputs(spark, plane):
    sets = spark.createDataFrame([("s", "a")], "set_id string, word string")
    with pytest.raises(ValueError, match="header"):
        enrich.wsea(plane, sets, [])
    with pytest.raises(ValueError, match="two models"):
        enrich.wsea(plane, sets, ["a"])


def test_shrinkage_goes_towards_zero(spark):
    rng = np.random.default_rng(1)
    beta = np.concatenate([rng.normal(0, 0.1, 200), rng.normal(0, 2, 20)])
    rows = [("h", f"w{i:03}", 0.5, float(x), 0.1) for i, x in enumerate(beta)] + [("h", "none", 0.5, 0.1, None), ("h", "zero", 0.5, 0.1, 0.0), ("h", "nan", 0.5, float("nan"), 0.1), ("g", "only", 0.2, 0.3, 0.05)]
    got = {(r.header, r.similar_word): r for r in shrink.shrink(spark.createDataFrame(rows, "header string, similar_word string, cosine_est double, z double, sd_z double").repartition(4)).collect()}
    assert len(got) == len(rows) and all(got["h", w].post_mean_z is None and got["h", w].svalue is None for w in ("none", "zero", "nan"))
    post = np.array([got["h", f"w{i:03}"].post_mean_z for i in range(220)])
    assert (np.abs(post) <= np.abs(beta) + 1e-6).all() and np.abs(post[:200]).mean() < 0.5 * np.abs(beta[:200]).mean()
    assert np.mean([got["h", f"w{i:03}"].lfdr for i in range(200)]) > 0.7 and np.abs(post - beta)[np.abs(beta) > 1].max() < 0.2
    # The prior of the cells is that of the rows, and s-values are running means.
    a = shrink.widths(0.01, 2 * math.sqrt((beta**2 - 0.01).max()))
    plain = shrink.posterior(beta, np.full(220, 0.1), a, shrink.prior(shrink.likelihoods(beta, np.full(220, 0.1), a), np.ones(220)))
    assert np.abs(post - plain["post_mean"]).max() < 2e-3
    order = sorted((got["h", f"w{i:03}"].lfsr, f"w{i:03}") for i in range(220))
    for k, (_, w) in enumerate(order, 1):
        assert got["h", w].svalue == pytest.approx(sum(x for x, _ in order[:k]) / k)
    assert got["g", "only"].svalue == pytest.approx(got["g", "only"].lfsr) and got["g", "only"].ash_cosine_est == pytest.approx(math.tanh(got["g", "only"].post_mean_z))


def test_estimates_are_made_once(spark, tmp_path):
    """Neither the rows that are shrunk nor those that are not ask for the estimates again."""
    read = tmp_path / "read"

    def noted(frames):
        for frame in frames:
            with read.open("a") as f:
                f.write("x" * len(frame))
            yield frame

    rows = [("h", f"w{i}", 0.5, i / 10 - 1, 0.1 + i / 100) for i in range(20)] + [("h", "none", 0.5, 0.1, None)]
    kinds = "header string, similar_word string, cosine_est double, z double, sd_z double"
    assert shrink.shrink(spark.createDataFrame(rows, kinds).mapInPandas(noted, kinds)).count() == len(rows) == len(read.read_text())


def test_prior_by_blocks_is_the_em_of_all_rows(monkeypatch):
    monkeypatch.setattr(shrink, "BLOCK", 7)
    rng = np.random.default_rng(2)
    like, n = shrink.likelihoods(rng.normal(0, 1, 50), rng.uniform(0.1, 0.5, 50), shrink.widths(0.05, 4)), rng.integers(1, 5, 50).astype(float)
    pi = np.full(like.shape[1], 1 / like.shape[1])
    for _ in range(30):
        w = like * pi
        pi = n @ (w / w.sum(1, keepdims=True)) + np.append(shrink.NULL_WEIGHT - 1, np.zeros(len(pi) - 1))
        pi /= pi.sum()
    assert np.abs(shrink.prior(like, n, rounds=30) - pi).max() < 1e-12


def test_a_vector_has_its_length_made_once(spark):
    rows = spark.createDataFrame([([3.0, 4.0],), ([0.0, 0.0],), (None,), ([1.0, None],)], "vec array<float>").select(unit(F.col("vec")).alias("u"))
    assert rows._jdf.queryExecution().optimizedPlan().toString().lower().count("sqrt(") == 1
    assert [r.u for r in rows.collect()] == [[0.6, 0.8], None, None, None]


def test_huffman_is_optimal_and_prefix_free():
    codes, points = huffman([5, 4, 3, 2, 1])
    assert sum(len(c) * n for c, n in zip(codes, [5, 4, 3, 2, 1], strict=True)) == 33
    assert sum(2.0 ** -len(c) for c in codes) == 1
    assert all(len(c) == len(p) and p[0] == 3 for c, p in zip(codes, points, strict=True))
    assert huffman([]) == ([], []) and huffman([3]) == ([""], [[]])
    assert len(Tree([5, 4, 3, 2, 1]).code) == sum(map(len, codes))


def _stream(spark, lines):
    docs = spark.createDataFrame([(i, x) for i, x in enumerate(lines)], "doc_id long, text string")
    return text.tokens(docs)


def _vectors(df):
    out = {}
    for r in df.collect():
        out.setdefault(r.role, {})[r.word] = np.array(r.vec)
    return out


def test_direction_is_learnt_and_runs_repeat(spark):
    rng = np.random.default_rng(2)
    fill = [f"f{i}" for i in range(30)]
    lines = [" ".join([*rng.choice(fill, 3), "A", "B", *rng.choice(fill, 3)]) for _ in range(300)]
    run = lambda: _vectors(train.train_biword2vec(_stream(spark, lines), vectors=12, window=2, iterations=4, negative=4, partitions=2, alpha=0.1))
    m = run()
    assert set(m) == {"in_left", "in_right", "out"}
    assert m["in_left"]["A"] @ m["out"]["B"] > m["in_right"]["A"] @ m["out"]["B"] + 0.1
    again = run()
    assert all((m["out"][w] == again["out"][w]).all() for w in m["out"])


@pytest.mark.parametrize("cbow", [False, True])
def test_topic_mates_are_near(spark, cbow):
    rng = np.random.default_rng(3)
    topics = [[f"t{k}w{i}" for i in range(8)] for k in range(2)]
    lines = [" ".join(rng.choice(topics[i % 2], 8)) for i in range(300)]
    m = _vectors(train.train_word2vec(_stream(spark, lines), vectors=10, window=4, iterations=4, negative=3, partitions=2, alpha=0.1, cbow=cbow))["in"]
    cos = lambda a, b: m[a] @ m[b] / np.linalg.norm(m[a]) / np.linalg.norm(m[b])
    assert cos("t0w0", "t0w1") > cos("t0w0", "t1w1")


def test_without_negatives_outputs_belong_to_tree_nodes(spark):
    m = train.train_biword2vec(_stream(spark, ["a b c d"] * 20), full=True, vectors=4, window=2, iterations=1, partitions=1)
    assert {r.role for r in m.select("role").distinct().collect()} == {"in_left", "in_right", "out_node_left", "out_node_right"}
    assert m.filter("role LIKE 'out%' AND word IS NOT NULL").count() == 0


@pytest.mark.parametrize("binary", [True, False])
def test_vector_files(spark, tmp_path, binary):
    rows = [("one", 0, [1.5, -2.0]), ("zwei", 1, [0.25, 3.0])]
    df = spark.createDataFrame(rows, "word string, word_id long, vec array<float>")
    path = str(tmp_path / "m.bin")
    files.write_vectors(df.coalesce(1), path, binary)
    assert any(f.read_bytes().startswith(b"2 2\n") or f.read_bytes().startswith(b"1 2\n") for f in (tmp_path / "m.bin").iterdir())
    read = lambda p: [(r.word, r.word_id, list(r.vec)) for r in files.read_vectors(spark, p, binary).orderBy("word_id").collect()]
    assert read(path) == rows
    with pytest.raises(FileExistsError):
        files.write_vectors(df, path, binary)
    files.write_vectors(df.filter("word_id = 1"), path, binary, force=True)
    assert read(path) == [("zwei", 0, [0.25, 3.0])]
    none = str(tmp_path / "none")
    files.write_vectors(df.filter("false"), none, binary)
    assert read(none) == []


@pytest.mark.parametrize("binary", [True, False])
def test_a_vector_file_is_read_in_pieces(spark, tmp_path, binary):
    """One file of another tool's, with line feeds and spaces among the bytes of its numbers, cut everywhere."""
    rng = np.random.default_rng(6)
    tricky = np.frombuffer((b"\n \n a b\n" * 3)[:20], "<f4") if binary else np.array([0.5] * 5, "<f4")
    rows = [(f"w{i}é"[: 2 + i % 4] + str(i), tricky if i % 3 == 0 else rng.normal(size=5).astype("<f4")) for i in range(400)]
    numbers = (lambda v: v.tobytes()) if binary else (lambda v: " ".join(f"{x:f}" for x in v).encode())
    path = tmp_path / "one.bin"
    path.write_bytes(b"400 5\n" + b"".join(w.encode() + b" " + numbers(v) + b"\n" for w, v in rows))
    got = files.read_vectors(spark, str(path), binary, piece=700).orderBy("word_id").collect()
    assert [(r.word, r.word_id) for r in got] == [(w, i) for i, (w, _) in enumerate(rows)]
    assert np.allclose([r.vec for r in got], [v for _, v in rows], atol=1e-5)
    path.write_bytes(path.read_bytes()[:-3])
    with pytest.raises(Exception, match="follow"):
        files.read_vectors(spark, str(path), binary, piece=700).collect()


def test_vector_files_of_many_tasks(spark, tmp_path):
    df = spark.range(1000).selectExpr("concat('w', id) AS word", "id AS word_id", "array(cast(id AS float), 0.5F) AS vec").repartition(5)
    files.write_vectors(df, str(tmp_path / "m"), file_rows=150)
    names = sorted(f.name for f in (tmp_path / "m").iterdir())
    assert len(names) >= 7 and all(n.startswith("part-") and n.endswith(".bin") for n in names)
    got = files.read_vectors(spark, str(tmp_path / "m")).orderBy("word_id").collect()
    assert [(r.word, r.word_id, list(r.vec)) for r in got] == [(f"w{i}", i, [float(i), 0.5]) for i in range(1000)]
    bad = df.limit(1).selectExpr("'two words' AS word", "word_id", "vec")
    with pytest.raises(Exception, match="spaces"):
        files.write_vectors(bad, str(tmp_path / "bad"))
    assert not [f for f in (tmp_path / "bad").iterdir() if f.name.startswith("part-")]


def _plain_step(params, tree, noise, inputs, slot, target, shift, alpha, drawn, summed):
    """The gradient step term by term, all terms at the parameters as they were."""
    new = {k: v.astype(float).copy() for k, v in params.items()}
    old = {k: v.astype(float) for k, v in params.items()}
    groups = [[i for i in range(len(inputs)) if slot[i] == s] for s in range(len(target))]
    examples = [(s, g) for s, g in enumerate(groups)] if summed else [(s, [i]) for s, g in enumerate(groups) for i in g]
    for s, own in examples:
        h = sum(old["in"][inputs[i]] for i in own)
        error = np.zeros(h.shape)
        terms = [("hs", tree.node[k] + shift[s], 1 - tree.code[k]) for k in range(tree.first[target[s]], tree.first[target[s] + 1])]
        terms += [("ns", target[s] + shift[s], 1.0), *(("ns", w + shift[s], 0.0) for w in drawn[s] if w != target[s])] if drawn is not None else []
        for name, row, label in terms:
            f = h @ old[name][row]
            if name == "hs" and abs(f) >= 6:
                continue
            g = (label - 1 / (1 + np.exp(-f))) * alpha
            error += g * old[name][row]
            new[name][row] += g * h
        for i in own:
            new["in"][inputs[i]] += error
    return new


@pytest.mark.parametrize("summed", [False, True])
@pytest.mark.parametrize("negative", [0, 3])
def test_a_step_is_that_of_a_plain_loop(summed, negative):
    from wordloom.functions import kernels

    rng = np.random.default_rng(5)
    vocab, dim = 7, 4
    tree, noise = kernels.Tree([9, 7, 5, 4, 3, 2, 1]), np.cumsum(np.full(vocab, 1 / vocab))
    params = {"in": rng.normal(0, 1, (2 * vocab, dim)), "hs": rng.normal(0, 2, (2 * vocab, dim)), "ns": rng.normal(0, 1, (2 * vocab, dim))}
    params = {k: v.astype(np.float32) for k, v in params.items()}
    slot, target, shift = np.repeat(np.arange(5), [1, 3, 2, 4, 2]), rng.integers(0, vocab, 5), np.array([0, 0, vocab, 0, vocab])
    inputs = rng.integers(0, 2 * vocab, len(slot))
    drawn = np.minimum(np.searchsorted(noise, np.random.default_rng(9).random((5, negative))), vocab - 1) if negative else None
    want = _plain_step(params, tree, noise, inputs, slot, target, shift, 0.1, drawn, summed)
    kernels.step(params, tree, noise, inputs, slot, target, shift, 0.1, negative, np.random.default_rng(9), summed)
    for name in params:
        assert np.allclose(params[name], want[name], atol=1e-4), name


def test_one_sided_examples():
    t = train.Training(window=2)
    ids = np.array([3, 1, 4, 0])
    for kind, before in (("left", True), ("right", False)):
        inputs, slot, target, _ = train.examples(ids, kind, 5, t, np.random.default_rng(1))
        at = {int(w): i for i, w in enumerate(ids)}
        assert len(inputs) and all((at[int(a)] < at[int(target[s])]) == before for a, s in zip(inputs, slot, strict=True))


def test_random_orders_have_no_repeats():
    for n, size in ((1000, 5), (30, 10), (10, 9)):
        orders = gsea.random_orders(np.random.default_rng(1), n, size, 400)
        assert orders.shape == (400, size) and (np.diff(np.sort(orders, 1), axis=1) > 0).all() and orders.min() >= 0 and orders.max() < n
        assert abs(orders.mean() - (n - 1) / 2) < n / 20 and abs(orders[:, 0].mean() - (n - 1) / 2) < n / 10


def _running_sum(weights, chosen):
    """The extreme of the whole running sum, step by step."""
    total, n, x = sum(weights[i] for i in chosen), len(weights), 0.0
    high = low = 0.0
    for i in range(n):
        x += (weights[i] / total if total else 0) if i in chosen else -1 / (n - len(chosen))
        high, low = max(high, x), min(low, x)
    return high if high >= -low else low, abs(high + low) < 1e-9  # the second: as high as it is low


def test_one_order_gives_the_scores_of_all_sizes():
    rng = np.random.default_rng(5)
    weights = np.sort(np.abs(rng.normal(size=60)))[::-1]
    ranks = gsea.random_orders(rng, 60, 25, 30)
    sizes = np.arange(1, 26)
    got = gsea.prefix_scores(ranks, weights[ranks], 60, sizes)
    for i, m in enumerate(sizes.tolist()):
        for k in range(30):
            want, tied = _running_sum(weights, set(ranks[k, :m].tolist()))
            assert abs(got[i, k]) == pytest.approx(abs(want), abs=1e-9) and (tied or got[i, k] * want > 0)
    nothing = gsea.prefix_scores(ranks[:2], np.zeros((2, 25)), 60, sizes)
    assert np.isfinite(nothing).all()


def test_random_scores_of_contrasts_in_pieces(spark):
    """Weights cut into pieces give what the whole arrays give, for equal seeds."""
    rng = np.random.default_rng(2)
    rows = [(c, f"k{i:03}", float(rng.normal())) for c, n in (("x", 150), ("y", 40)) for i in range(n)] + [("x", "none", None)]
    scores = spark.createDataFrame(rows, "contrast string, key string, score double").repartition(4)
    sizes = spark.createDataFrame([(c, m) for c in "xy" for m in (1, 5, 5, 17)], "contrast string, size long")
    test = gsea.SetTest(nperm=300)
    read = lambda **options: {(r.contrast, r.size, r.perm): r.null for r in gsea.null_scores(scores, sizes, test, **options).collect()}
    whole = read()
    assert len(whole) == 2 * 3 * 300
    for contrast, n in (("x", 150), ("y", 40)):
        weights = np.array(sorted((abs(s) for c, _, s in rows if c == contrast and s is not None), reverse=True))
        ordered = sorted((s for c, _, s in rows if c == contrast and s is not None), reverse=True)
        weights = np.abs(np.array(ordered))
        means = {m: np.mean([abs(whole[contrast, m, p]) for p in range(300)]) for m in (5, 17)}
        plain = [abs(_running_sum(weights, set(rng.permutation(n)[:17].tolist()))[0]) for _ in range(300)]
        assert means[17] == pytest.approx(np.mean(plain), rel=0.1) and means[5] > means[17]
    assert read(piece_size=16) == whole
    assert gsea.null_scores(scores.filter("false"), sizes, test).count() == 0
    summary = {(r.contrast, r.size): r.sets for r in gsea.null_summary(gsea.null_scores(scores, sizes, test)).groupBy("contrast", "size").agg({"sets": "sum"}).withColumnRenamed("sum(sets)", "sets").collect()}
    assert set(summary.values()) == {300}


def test_headers_in_blocks_give_the_same_cosines(spark, monkeypatch):
    from wordloom.operators import vectors

    rng = np.random.default_rng(4)
    models = spark.createDataFrame([(m, f"w{i}", rng.normal(size=3).tolist()) for m in "ab" for i in range(12)], "model string, word string, vec array<double>")
    heads = vectors.words_table(spark, [f"w{i}" for i in range(7)])
    want = sorted(map(tuple, vectors.cosines(models, heads).collect()))
    monkeypatch.setattr(vectors, "HEADERS", 3)
    assert sorted(map(tuple, vectors.cosines(models, heads).collect())) == want and len(want) == 2 * 12 * 7


def test_missing_cells_are_dropped_or_filled(spark):
    from wordloom.operators import enrich, vectors

    cells = [("m0", w, [1.0, float(i)]) for i, w in enumerate("hxyz")] + [("m1", w, [2.0, float(i)]) for i, w in enumerate("hxy")] + [("m2", w, [1.0, 1.0 + i]) for i, w in enumerate("hx")]
    models = spark.createDataFrame(cells, "model string, word string, vec array<double>")
    sims = enrich.similarity(models, models, vectors.words_table(spark, ["h"]))
    kept = enrich.filtered(sims)
    assert {r.word for r in kept.collect()} == {"h", "x", "y"}  # z lacks two cells
    filled = {(r.word, r.model): r.cos for r in enrich.imputed(kept).collect()}
    assert filled["y", "m2"] == pytest.approx((filled["y", "m0"] + filled["y", "m1"]) / 2)


def test_queries_beyond_what_a_task_keeps_have_the_same_neighbours(spark, monkeypatch):
    """Queries sent as matrices, in blocks and by a join: equal rows, with null vectors, words without a direction and ties by word."""
    rng = np.random.default_rng(8)
    grid = rng.normal(size=(30, 3)).tolist()  # each vector four times
    rows = [(m, f"w{i:03}", grid[i % 30]) for m in ("a", "b") for i in range(120)]
    whole = spark.createDataFrame([*rows, ("a", "none", None), ("b", "zero", [0.0] * 3)], "model string, word string, vec array<double>").repartition(3)
    clear = whole.filter("vec IS NOT NULL AND NOT vec = array(0D, 0D, 0D)")
    queries = vectors.words_table(spark, ["none", "zero", "nowhere", *(f"w{i:03}" for i in range(0, 120, 3))])
    rows_of = lambda df: sorted(((r.model, r.query, r.rank, r.word, None if r.cos is None else round(r.cos, 9)) for r in df.collect()), key=str)
    sent, known = rows_of(vectors.nearest(whole, queries, 7)), rows_of(vectors.nearest(clear, queries, 7))
    assert len(sent) > len(known) > 500
    cells = lambda df: sorted(((r.model, r.word, r.header, None if r.cos is None else round(r.cos, 9)) for r in df.collect()), key=str)
    every = cells(vectors.cosines(whole, queries))
    # What is sent is bounded: no task keeps all words of the queries.
    plan = vectors.nearest(whole, queries, 7)._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInArrow" in plan and "Join" not in plan
    monkeypatch.setattr(vectors, "NUMBERS", 10)
    monkeypatch.setattr(vectors, "HEADERS", 16)
    assert cells(vectors.cosines(whole, queries)) == every
    assert rows_of(vectors.nearest(whole, queries, 7)) == sent
    assert rows_of(vectors.nearest(clear, queries, 7)) == known


def test_a_step_sorts_no_array_as_long_as_its_pairs_and_outputs(monkeypatch):
    """Outputs are told apart slot by slot: 2,000 inputs of 4 slots have 24 outputs to sort, not 12,000."""
    from wordloom.functions import kernels

    vocab, sorted_, unique = 7, [], np.unique
    monkeypatch.setattr(kernels.np, "unique", lambda x, **k: sorted_.append(len(x)) or unique(x, **k))
    params = {k: np.full((vocab, 4), 0.1, np.float32) for k in ("in", "hs", "ns")}
    inputs, slot = np.arange(2000) % vocab, np.repeat(np.arange(4), 500)
    kernels.step(params, kernels.Tree([9, 7, 5, 4, 3, 2, 1]), np.cumsum(np.full(vocab, 1 / vocab)), inputs, slot, np.arange(4), np.zeros(4, np.int64), 1e-4, 5, np.random.default_rng(9), False)
    assert max(sorted_) == 2000 and all(np.isfinite(p).all() for p in params.values())


@pytest.mark.parametrize(("kind", "negative"), [("bi", 0), ("full", 2), ("uni", 3)])
def test_parameters_as_a_table_give_the_same_vectors(spark, monkeypatch, kind, negative):
    rng = np.random.default_rng(4)
    lines = [" ".join(f"w{x}" for x in rng.integers(0, 6000, 60).tolist()) for _ in range(200)] + ["alone"]
    dealt = train._dealt
    monkeypatch.setattr(train, "_dealt", lambda sentences, parts, evenly: dealt(sentences, parts, True))
    t = train.Training(vectors=4, window=2, min_count=1, iterations=2, negative=negative, partitions=3, alpha=0.1)
    held = {(r.role, r.word, r.word_id): (r.cn, r.vec) for r in train.train(_stream(spark, lines), kind, t).collect()}
    monkeypatch.setattr(train, "SENT_NUMBERS", 10)
    monkeypatch.setattr(train, "_model", None)  # the driver holds no parameters
    table = {(r.role, r.word, r.word_id): (r.cn, r.vec) for r in train.train(_stream(spark, lines), kind, t).collect()}
    assert table == held and len(table) == len({k[2] for k in table}) * (3 if kind == "bi" else 4 if kind == "full" else 2)


def test_a_task_needs_the_rows_of_its_own_words_only():
    t = train.Training(vectors=4, negative=0)
    tree = Tree(None, joined(sorted(range(1, 1001), reverse=True)), np.array([0, 5]))
    needed = train._needed(np.array([0, 5]), tree, "bi", 1000, t)
    assert needed["in"].tolist() == [0, 5, 1000, 1005] and len(needed["hs"]) < 25 and not len(needed["ns"])


def test_neighbours_are_looked_for_only_where_they_can_add_words(spark, monkeypatch):
    rows = [("m", "a", [1.0, 0.0]), ("m", "b", [0.9, 0.1]), ("m", "c", [0.0, 1.0]), ("n", "a", [0.0, 1.0])]
    models = spark.createDataFrame(rows, "model string, word string, vec array<float>")
    names = lambda df: sorted(r.word for r in df.collect())
    assert names(enrich.pooled(models, vectors.words_table(spark, ["a", "other"]), 2)) == ["a", "b", "other"]
    monkeypatch.setattr(enrich, "nearest", None)
    assert names(enrich.pooled(models, vectors.words_table(spark, ["a", "b", "c", "other"]), 2)) == ["a", "b", "c", "other"]


def test_cosines_are_counted_by_bin_without_a_row_for_each(spark, monkeypatch):
    rng = np.random.default_rng(2)
    rows = [("m", f"w{i}", rng.normal(0, 1, 6).tolist()) for i in range(300)] + [("m", f"w{i}", [float(x) for x in np.eye(6)[i % 6] * (-1) ** i]) for i in range(300, 340)]
    rows += [("m", "zero", [0.0] * 6), ("m", "gone", None), ("m", "w3", rows[3][2])]
    models = spark.createDataFrame(rows, "model string, word string, vec array<double>").repartition(3)
    heads = models.select("word").filter("word like 'w3%' OR word = 'zero'")
    each = vectors.cosines(models, heads)
    want = {r.i: r.n for r in each.groupBy(F.least(F.floor((F.col("cos") + 1) * 20), F.lit(39)).alias("i")).agg(F.count("*").alias("n")).collect()}
    monkeypatch.setattr(vectors, "BINNED", 7)
    with monkeypatch.context() as m:
        m.setattr(vectors, "cosines", None)  # no row for each
        assert {r.i: r.n for r in vectors.cosine_bins(models, heads, 40).collect()} == want
    monkeypatch.setattr(vectors, "NUMBERS", 10)
    assert {r.i: r.n for r in vectors.cosine_bins(models, heads, 40).collect()} == want
