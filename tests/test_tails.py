"""Small p-values by splitting."""

import itertools
import math

import numpy as np
import pytest

from wordloom.operators import gsea, tails


def test_tails_agree_with_all_sets_of_twelve_keys():
    rng = np.random.default_rng(1)
    weights = np.sort(np.abs(rng.normal(size=12)))[::-1]
    every = np.array(list(itertools.combinations(range(12), 4)))
    scores = gsea.prefix_scores(every, weights[every], 12, np.array([4]))[0]
    for es in (np.sort(scores)[-2], np.sort(scores)[-25], np.sort(scores)[1], np.sort(scores)[20]):
        exact = (scores >= es - 1e-12).mean() if es > 0 else (scores <= es + 1e-12).mean()
        p, error = tails.tail_probability(weights, 4, float(es), np.random.default_rng(7), sets=600)
        assert abs(math.log(p / exact)) < max(4 * error, 0.35)


def test_far_tails_are_told_with_an_error():
    weights = np.linspace(3, 0, 2000)
    one = np.array([15])
    top = np.arange(15)[None, :] * 2
    es = float(gsea.prefix_scores(top, weights[top], 2000, one)[0, 0])
    estimates = [tails.tail_probability(weights, 15, es, np.random.default_rng(k), sets=100) for k in range(3)]
    logs = [math.log10(p) for p, _ in estimates]
    # All of the set among the first 30 of 2,000 keys has log10 p of some -29; such a score has a few more ways.
    assert all(-32 < x < -18 for x in logs) and max(logs) - min(logs) < 4 and all(0 < e < 2 for _, e in estimates)


def test_sets_beyond_the_permutations_get_smaller_values(spark):
    rng = np.random.default_rng(0)
    rows = [("t", f"w{i:03}", float(rng.normal() + (4 if i < 12 else 0))) for i in range(200)]
    scores = spark.createDataFrame(rows, "contrast string, key string, score double")
    sets = spark.createDataFrame([("up", f"w{i:03}") for i in range(12)] + [("none", f"w{i:03}") for i in range(50, 80)], "pathway string, key string")
    test = gsea.SetTest(nperm=500)
    tested = gsea.set_test(scores, sets, test)
    found = {r.pathway: r for r in tails.small_p(tested, scores, test, sets=100).collect()}
    before = {r.pathway: r.pval for r in tested.collect()}
    assert set(found) == {"up"} and found["up"].pval < before["up"] / 1000 and found["up"].log_error < 2
    again = {r.pathway: r.pval for r in tails.small_p(tested, scores, test, sets=100).collect()}
    assert again["up"] == pytest.approx(found["up"].pval)
    assert tails.small_p(tested.filter("false"), scores, test).count() == 0
