"""Huffman codes of a vocabulary, from its runs of equal counts.

An optimal tree depends on the counts only, and of words with one count it only matters
how many get which length.  So the tree is built over runs (count, how many): two of the
least runs are joined at a time, whole runs at once, and the driver sees the different
counts only, of which a corpus of T tokens has less than the root of 2 T.  Words then get
their lengths by their place among those of their count, and canonical codes, by a join
of intervals: codes of one length follow each other in the order of the words' ids, and
the inner nodes of each depth are the numbers beyond the codes of that depth.
"""

from __future__ import annotations

import heapq
import itertools
from collections import Counter

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .lineage import SENT_ROWS

#: Longest code; a greater depth needs counts beyond the 60th Fibonacci number.
LONGEST = 62


def run_lengths(runs: list[tuple[int, int]]) -> dict[int, Counter]:
    """{count: how many of its words have which code length} of an optimal tree over (count, how many)."""
    if sum(n for _, n in runs) == 1:
        return {runs[0][0]: Counter({0: 1})}
    order = itertools.count()
    # A run of equal trees: (weight, when made, trees, parts), parts being (run of the tree's one side, of its other) or a leaf's count.
    heap = [(count, next(order), n, count) for count, n in sorted(runs) if n]
    heapq.heapify(heap)
    while True:
        weight, _, n, tree = heapq.heappop(heap)
        if n > 1:
            heapq.heappush(heap, (2 * weight, next(order), n // 2, (tree, tree)))
            if n % 2:
                heapq.heappush(heap, (weight, next(order), 1, tree))
            continue
        if not heap:
            break
        other, _, m, second = heapq.heappop(heap)
        if m > 1:
            heapq.heappush(heap, (other, next(order), m - 1, second))
        heapq.heappush(heap, (weight + other, next(order), 1, (tree, second)))
    # Trees are shared: depths are handed down from the root, the trees made last first.
    depths: dict[int, Counter] = {id(tree): Counter({0: 1})}
    found: dict[int, Counter] = {}
    for node in _from_root(tree):
        below = Counter({d + 1: k for d, k in depths.pop(id(node)).items()})
        for side in node:
            if isinstance(side, tuple):
                depths.setdefault(id(side), Counter()).update(below)
            else:
                found.setdefault(side, Counter()).update(below)
    return found


def _from_root(tree):
    """The inner trees, each after all that it is a part of."""
    seen, out, stack = set(), [], [(tree, False)]
    while stack:
        node, done = stack.pop()
        if done:
            out.append(node)
        elif id(node) not in seen:
            seen.add(id(node))
            stack.append((node, True))
            stack += [(side, False) for side in node if isinstance(side, tuple)]
    return reversed(out)


def _intervals(lengths: dict[int, Counter]) -> list[tuple[int, int, int, int]]:
    """(count, first, last, length): the places among the words of a count, from 0, that have a length; shorter ones first."""
    out = []
    for count, by_length in lengths.items():
        at = 0
        for length, n in sorted(by_length.items()):
            out.append((count, at, at + n - 1, length))
            at += n
    return out


def canonical(by_length: Counter) -> list[tuple[int, int, int, int]]:
    """(length, first code, first inner node, value of it) for each depth from 0 on.

    Codes of a length start where those of the length before, doubled, end; the inner
    nodes of a depth are the values after its codes, and are numbered from the root.
    """
    out, code, node = [], 0, 0
    inner = 0 if by_length == Counter({0: 1}) else 1
    for length in range(max(by_length) + 1):
        first, leaves = code, by_length.get(length, 0)
        out.append((length, first, node, first + leaves))
        node += inner
        inner = 2 * inner - by_length.get(length + 1, 0)
        code = (first + leaves) * 2
    return out


def _cuts(lengths: dict[int, Counter], shape: list[tuple[int, int, int, int]]) -> list[tuple[int, int, int, int, int]]:
    """(count, first, last, length, shift): the word ids of a count that have a length, and what a code of theirs is beyond its word id.

    Word ids count on from the words of greater counts.  Codes of one length follow the
    word ids, so that within an interval both rise by one.
    """
    code, at, out = [first for _, first, _, _ in shape], 0, []
    for count, low, high, length in sorted(_intervals(lengths), key=lambda x: (-x[0], x[1])):
        n = high - low + 1
        out.append((count, at, at + n - 1, length, code[length] - at))
        code[length] += n
        at += n
    return out


def huffman(vocab: DataFrame) -> DataFrame:
    """(word, cn, word_id, depth, code, point) of vocab (word, cn, word_id); point: the inner nodes from the root, one for each sign of the code.

    Frequent words come first: word_id must follow falling counts, as text.ranked has it.
    The codes are those of one optimal tree, in canonical form: read as numbers, they rise
    with depth and then word_id.  A single word has an empty code.  An empty table gives no rows.
    """
    spark = vocab.sparkSession
    runs = vocab.groupBy("cn").agg(F.count("*").alias("n")).collect()
    if not runs:
        return vocab.select("word", "cn", "word_id", F.lit(0).alias("depth"), F.lit("").alias("code"), F.array().cast("array<long>").alias("point"))
    lengths = run_lengths([(r["cn"], r["n"]) for r in runs])
    by_length = sum(lengths.values(), Counter())
    if max(by_length) > LONGEST:
        raise ValueError("a code is too long")
    shape = canonical(by_length)
    table = _cuts(lengths, shape)
    cuts = spark.createDataFrame(table, "_cn long, low long, high long, depth int, shift long")
    if len(table) <= SENT_ROWS:
        cuts = F.broadcast(cuts)
    deep = vocab.join(cuts, (F.col("cn") == F.col("_cn")) & F.col("word_id").between(F.col("low"), F.col("high")))
    coded = deep.select("word", "cn", "word_id", "depth", (F.col("word_id") + F.col("shift")).alias("_code"))
    node, value = (F.array(*(F.lit(x[k]).cast("long") for x in shape)) for k in (2, 3))
    bits = F.when(F.col("depth") == 0, F.lit("")).otherwise(F.lpad(F.bin("_code"), F.col("depth"), "0"))
    # The node at depth d is the code's first d signs, as a number.
    up = lambda d: F.call_function("shiftright", F.col("_code"), F.col("depth") - d)
    point = F.when(F.col("depth") == 0, F.array().cast("array<long>")).otherwise(F.transform(F.sequence(F.lit(0), F.greatest(F.col("depth") - 1, F.lit(0))), lambda d: F.get(node, d) + up(d) - F.get(value, d)))
    return coded.select("word", "cn", "word_id", "depth", bits.alias("code"), point.alias("point"))
