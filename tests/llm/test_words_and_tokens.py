import random
import re

import numpy as np
import pyarrow as pa
import pytest

from wordloom.llm import pack, tokens, words


def test_words_are_those_of_the_pattern():
    rng = random.Random(1)
    texts = ["".join(rng.choices(" \t\n\x0b\x1c\xa0aBé中😀", k=rng.randint(0, 40))) for _ in range(300)] + ["", None]
    seen = []
    for c in words.chunks(pa.array(texts, pa.string()), words.space_split_table(), most=100):
        for i in range(len(c)):
            seen.append([c.data[a:b].tobytes().decode() for a, b in zip(c.start[c.first[i] : c.first[i + 1]], c.end[c.first[i] : c.first[i + 1]], strict=True)])
    assert seen == [re.findall(r"[^\x20\x09-\x0D]+", t or "") for t in texts]


def test_hashes_are_equal_for_equal_words_only():
    text = " ".join(["a", "b", "ab", "ba", "a", "aa", "ab"] * 3)
    (c,) = words.chunks(pa.array([text]), words.space_split_table())
    by_word = {}
    for w, h in zip(text.split(), c.hashes().tolist(), strict=True):
        by_word.setdefault(w, set()).add(h)
    assert all(len(h) == 1 for h in by_word.values()) and len({min(h) for h in by_word.values()}) == len(by_word)


def _tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokens.default_path())


def test_ids_are_the_tokenizers():
    rng = random.Random(2)
    bits = [" ", "  ", "\n", "\t", "a", "B", "'s", "'t", "'re", "'", "''", "don't", "é", "1", "²", "½", "!?", "\xa0", "　", "中文", "😀", "\r\n", "x" * 70, "'S", "_", "\x1c", "<|endof", "Ⅷ"]
    texts = ["".join(rng.choices(bits, k=rng.randint(0, 30))) for _ in range(1500)] + ["", None, "<|endoftext|> a"]
    whole = _tokenizer()
    n = 0
    for at, ids, edges in tokens.encoded(pa.array(texts, pa.string()), most=2000):
        for i in range(len(edges) - 1):
            assert ids[edges[i] : edges[i + 1]].tolist() == whole.encode(texts[at + i] or "", add_special_tokens=False).ids
            n += 1
    assert n == len(texts)


def test_forgetting_pieces_changes_nothing(monkeypatch):
    monkeypatch.setattr(tokens, "KEPT_PIECES", 3)
    made = tokens.Encoder(tokens.default_path())
    whole = _tokenizer()
    texts = ["one two three four", "five six", "one two seven eight nine ten"]
    data, offsets = words.string_buffers(pa.array(texts))
    for _ in range(2):
        ids, edges = made.encode(data, offsets)
        assert [ids[a:b].tolist() for a, b in zip(edges[:-1], edges[1:], strict=True)] == [whole.encode(t).ids for t in texts]


def _brute(places, penalty, length):
    cost = {0: 0}
    for j in range(1, len(places)):
        options = []
        for i in range(j):
            size = places[j] - places[i]
            if size <= length:
                power = size & (size - 1) == 0 and (size >= 64 or j == len(places) - 1)
                options.append(cost[i] + (0 if power else length - size) + pack.SEQUENCE + penalty[j])
        cost[j] = min(options)
    return cost[len(places) - 1]


@pytest.mark.parametrize("seed", range(8))
def test_cuts_cost_the_least(seed):
    rng = np.random.default_rng(seed)
    length = int(rng.choice([128, 256]))
    n = int(rng.integers(1, 1500))
    is_end = rng.random(n) < 0.05
    ends = np.unique(np.append(rng.integers(1, n + 1, 6), n))
    places, penalty = pack.cut_places(is_end, ends, n, length)
    cuts = pack.best_cuts(places, penalty, length)
    got = 0
    for i, j in zip(cuts[:-1], cuts[1:], strict=True):
        size = int(places[j] - places[i])
        assert 0 < size <= length
        power = size & (size - 1) == 0 and (size >= 64 or j == len(places) - 1)
        got += (0 if power else length - size) + pack.SEQUENCE + int(penalty[j])
    assert got == _brute(places.tolist(), penalty.tolist(), length)
