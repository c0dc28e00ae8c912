"""Huffman codes over runs of equal counts."""

import random
from collections import Counter

import pytest

from wordloom.functions import kernels
from wordloom.operators import codes, ranks


@pytest.mark.parametrize("counts", [[5], [1, 1], [3, 3, 3], [1] * 17, [8, 4, 2, 1, 1], [1, 1, 2, 3, 5, 8, 13, 21], [7, 7, 7, 7, 7, 1], [100, *[1] * 9]])
def test_lengths_are_optimal(counts):
    found = codes.run_lengths(list(Counter(counts).items()))
    assert {c: sum(x.values()) for c, x in found.items()} == Counter(counts)
    total = sum(c * d * k for c, x in found.items() for d, k in x.items())
    assert total == sum(c * len(code) for c, code in zip(counts, kernels.huffman(sorted(counts, reverse=True))[0], strict=True)) if counts == sorted(counts, reverse=True) else True
    best = kernels.huffman(sorted(counts, reverse=True))[0]
    assert total == sum(c * len(code) for c, code in zip(sorted(counts, reverse=True), best, strict=True))
    assert len(counts) == 1 or sum(k / 2**d for x in found.values() for d, k in x.items()) == 1


def test_lengths_of_random_counts_are_optimal():
    rng = random.Random(7)
    for _ in range(60):
        counts = sorted((rng.choice([1, 2, 3, 50, 1000, rng.randint(1, 300)]) for _ in range(rng.randint(2, 200))), reverse=True)
        total = sum(c * d * k for c, x in codes.run_lengths(list(Counter(counts).items())).items() for d, k in x.items())
        assert total == sum(c * len(code) for c, code in zip(counts, kernels.huffman(counts)[0], strict=True))


@pytest.mark.parametrize("counts", [[9], [4, 4], [40, 30, 9, 9, 9, 3, 1, 1, 1, 1, 1]])
def test_codes_are_canonical_and_points_are_a_tree(spark, counts):
    vocab = spark.createDataFrame([(f"w{i}", c, i) for i, c in enumerate(counts)], "word string, cn long, word_id long").repartition(3)
    rows = codes.huffman(vocab).orderBy("word_id").collect()
    assert [r.word for r in rows] == [f"w{i}" for i in range(len(counts))] and all(len(r.code) == r.depth == len(r.point) for r in rows)
    found = [r.code for r in rows]
    assert not any(a != b and b.startswith(a) for a in found for b in found) and len(set(found)) == len(found)
    assert found == sorted(found, key=lambda c: (len(c), c))
    if len(counts) > 1:
        # A node is named by the signs that lead to it: one number for each, the root is 0, and all are used.
        names = {}
        for r in rows:
            for d, node in enumerate(r.point):
                assert names.setdefault(node, r.code[:d]) == r.code[:d]
        assert sorted(names) == list(range(len(counts) - 1)) and names[0] == "" and len(set(names.values())) == len(names)
    assert codes.huffman(vocab.filter("false")).count() == 0


def test_words_are_not_sorted_again(spark, monkeypatch):
    """Within an interval of word ids a code is the word id and a shift."""
    monkeypatch.setattr(ranks, "_dealt", lambda *a: pytest.fail("a sort"))
    counts = [40, 30, 9, 9, 9, 3, 1, 1, 1, 1, 1]
    rows = codes.huffman(spark.createDataFrame([(f"w{i}", c, i) for i, c in enumerate(counts)], "word string, cn long, word_id long")).collect()
    assert len({r.code for r in rows}) == len(counts) and sum(2.0**-r.depth for r in rows) == 1
