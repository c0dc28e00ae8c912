"""Each operator against plain Python, on a table with the awkward cases."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from wordloom.llm import components, decontaminate, line_dedup, pack, quality_pu, quality_rules, simhash, substring, token_counts, tokens, toxicity, warc

SPACE = r"[^\x20\x09-\x0D]+"
CLASHES = ["row", "text_left", "touched", "frequent", "fp", "doc", "runs", "c", "w", "items", "_id", "host", "score", "n_words", "kept", "lines", "nos", "least"]


def _prose(rng, n):
    return " ".join(rng.choice(["the", "of", "a", "river", "stone", "É", "wind.", "Night", "fox", "42", "x|y", f"r{rng.randint(0, 400)}"]) for _ in range(n))


def _rows(seed=1):
    rng = random.Random(seed)
    shared, line = _prose(rng, 60), "Home | About | Contact us today please"
    rows = [(None, None, "s1"), (1, None, None), (2, "", "s1"), (3, " \n\t ", "s1"), (4, "one two", "s1"), (5, "one two", "s1")]
    for i in range(6, 60):
        text = "\n".join(_prose(rng, rng.randint(5, 60)) for _ in range(rng.randint(1, 4)))
        if i % 4 == 0:
            text += "\n" + shared
        if i % 3 == 0:
            text = line + "\n" + text
        rows.append((i, text, f"s{i % 3}"))
    base = _prose(rng, 120)
    for i in range(60, 72):
        ws = base.split(" ")
        ws[rng.randrange(120)] = f"edit{i}"
        rows.append((i, base if i % 2 else " ".join(ws), "s0"))
    rows.append((80, _prose(rng, 30_000), "s1"))  # very long
    rows.append((81, "word " * 5000, "s1"))
    return rows


@pytest.fixture(scope="module")
def rows():
    return _rows()


@pytest.fixture(scope="module")
def docs(spark, rows):
    base = spark.createDataFrame([(i, t, "en", s, len(t or "")) for i, t, s in rows], "doc_id long, text string, lang string, source string, n_chars long")
    return base.withColumns({name: F.lit(f"own {name}") for name in CLASHES}).repartition(3)


@pytest.fixture(scope="module")
def empty(docs):
    return docs.filter("false")


def _words(text):
    return re.findall(SPACE, text or "")


def test_packing(docs, empty, rows):
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(tokens.default_path())
    pieces = defaultdict(list)
    sequences = defaultdict(list)
    for r in pack.pack(docs, with_ids=True).collect():
        pieces[r.doc_id].append(r)
        sequences[r.sequence_id].append((r.offset, r.length))
        assert zlib.crc32(np.array(r.ids, "<u4").tobytes()) == r.ids_crc32 and len(r.ids) == r.length
    assert set(pieces) == {i for i, _, _ in rows}
    for i, text, _ in rows:
        ids = [*whole.encode(text or "", add_special_tokens=False).ids, 1]
        own = sorted(pieces[i], key=lambda r: r.start)
        assert [x for r in own for x in r.ids] == ids and all(r.doc_tokens == len(ids) for r in own)
        assert [r.start for r in own] == [sum(p.length for p in own[:k]) for k in range(len(own))]
    padding = total = 0
    for parts in sequences.values():
        parts.sort()
        size = sum(n for _, n in parts)
        assert [o for o, _ in parts] == [sum(n for _, n in parts[:k]) for k in range(len(parts))] and size <= 2048
        padding += 0 if size & (size - 1) == 0 else 2048 - size
        total += size
    assert padding < 0.05 * total
    assert pack.pack(empty).count() == 0


def _base(text):
    ws = _words(text)
    wins = defaultdict(list)
    for i in range(len(ws) - 2):
        wins[tuple(ws[i : i + 3])].append(i)
    cover = {p for at in wins.values() if len(at) > 1 for i in at for p in (i, i + 1, i + 2)}
    lines = [x for x in (text or "").split("\n") if _words(x)]
    return len(ws), sum(map(len, ws)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(cover)


@pytest.mark.parametrize("sent_lines", [quality_rules.SENT_LINES, 0])
def test_quality_rules(docs, empty, rows, sent_lines):
    cols = "text_left n_words word_chars n_symbols n_dup_lines n_repeat_words base_failed n_words_left kept".split()
    got = {r["id"]: r for r in quality_rules.verdicts(docs, min_documents=3, host_share=0.2, sent_lines=sent_lines).select(F.col("row.doc_id").alias("id"), *cols).collect()}
    normal = lambda x: re.sub(r"[ \t\x0b\f\r]+", " ", x).strip(" ")
    held, hosts = defaultdict(set), defaultdict(set)
    for _, text, host in rows:
        hosts[host].add(text or "")
        for x in (text or "").split("\n"):
            if normal(x):
                held[host, normal(x)].add(text)
    often = {k for k, v in held.items() if len(v) > 3 and len(v) > 0.2 * len(hosts[k[0]])}
    assert often
    for i, text, host in rows:
        r, base = got[i], _base(text)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == base
        left = [x for x in (text or "").split("\n") if (host, normal(x)) not in often]
        failed = base[0] < 50 or 100 * base[4] > 50 * base[0]
        assert r.n_words_left == len(_words("\n".join(left))) and r.base_failed == failed
        assert r.kept == (not failed and r.n_words_left >= 0.5 * base[0])
        assert _words(r.text_left) == _words("\n".join(left))
    assert quality_rules.verdicts(empty).count() == 0


def _spans(rows, k=20):
    seen, out = set(), {}
    for i, text, _ in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        ws = _words(text)
        gone = [False] * len(ws)
        for s in range(len(ws) - k + 1):
            key = tuple(ws[s : s + k])
            if key in seen:
                gone[s : s + k] = [True] * k
            seen.add(key)
        kept = " ".join(w for w, g in zip(ws, gone, strict=True) if not g)
        out[i] = (len(ws), sum(gone), hashlib.sha256(kept.encode()).hexdigest())
    return out


def test_repeated_spans(docs, empty, rows):
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in substring.remove_repeats(docs).collect()}
    want = _spans(rows)
    assert got == want and sum(v[1] for v in want.values()) > 1000
    assert substring.remove_repeats(empty).count() == 0


def test_rows_that_share_an_id_are_judged_one_by_one(spark, tmp_path):
    rng = random.Random(4)
    long = [_prose(rng, 40) for _ in range(6)]
    rows = [(None, long[0]), (None, long[1]), (None, long[1] + "\n" + long[2]), (1, long[2]), (1, long[3]), (1, long[3]), (2, long[4] + "\n" + long[0]), (2, None), (2, ""), (3, long[5])]
    df = spark.createDataFrame([(i, t, f"s{k}", 0) for k, (i, t) in enumerate(rows)], "doc_id long, text string, source string, n_chars long").repartition(3)
    placed = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, hashlib.md5((r[1] or "").encode()).hexdigest()))
    spans = _spans([(k, t, None) for k, (_, t) in enumerate(placed)])
    got = substring.remove_repeats(df).collect()
    assert Counter((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in got) == Counter((i, *spans[k]) for k, (i, _) in enumerate(placed))
    placed = sorted(((i, t or "") for i, t in rows), key=lambda r: (r[0] is not None, r[0] or 0, hashlib.md5(r[1].encode()).hexdigest()))
    left = _lines_left([(k, t, None) for k, (_, t) in enumerate(placed)])
    want = Counter((i, *left[k]) for k, (i, _) in enumerate(placed))
    assert Counter((r.doc_id, r.n_removed, r.text) for r in line_dedup.line_dedup(df).collect()) == want
    after = line_dedup.stage(spark, df, str(tmp_path)).collect()
    assert Counter((r.doc_id, r.text) for r in after) == Counter({(i, t): sum(n for (j, _, u), n in want.items() if (j, u) == (i, t)) for i, _, t in want})
    assert {r.source for r in after} == {f"s{k}" for k in range(len(rows))} and all(r.n_chars == len(r.text) for r in after)


def test_each_component_keeps_a_text_though_ids_repeat(spark, tmp_path):
    rng = random.Random(6)
    a, b, c, d = (_prose(rng, 120) for _ in range(4))
    rows = [(1, a), (1, b), (1, b), (None, c), (None, d), (2, c), (None, d)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert len({_fingerprint(t) for _, t in rows}) == 4
    assert Counter((r.doc_id, r.text) for r in simhash.stage(spark, df, str(tmp_path)).collect()) == Counter([(1, a), (1, b), (2, c), (None, d)])


def test_repeats_across_tasks_and_batches(monkeypatch):
    rng = np.random.default_rng(5)
    n = 500
    key, digest = rng.integers(0, 20, n).astype(np.uint64), rng.integers(0, 3, n).astype(np.uint64)
    doc, at = np.arange(n) // 10, np.arange(n) % 10 * 100
    sent = substring._node_rows(key, digest, doc, at, np.ones(n, np.int64))
    kinds = Counter((x["place"] & 3).tolist()[0] for x in sent if len(x["doc"]))
    assert sum(len(x["doc"]) for x in sent) == n and set(kinds) <= {substring.REPEAT, substring.BRANCH, substring.FORK, substring.SINGLE}
    assert len(sent[0]["key"]) == len(set(key.tolist()))  # one row for each anchor


def _lines_left(rows):
    seen, out = [], {}
    for i, text, _ in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        kept, removed = [], 0
        for line in (text or "").split("\n"):
            ws = frozenset(x for x in re.split(r"[ \t\x0b\f\r]+", line) if x)
            if ws and any(9 * len(ws & o) >= 4 * (len(ws) + len(o)) for o in seen):
                removed += 1
            else:
                kept.append(line)
            if ws:
                seen.append(ws)
        out[i] = (removed, "\n".join(kept))
    return out


def test_similar_lines(docs, empty, rows):
    got = {r.doc_id: (r.n_removed, r.text) for r in line_dedup.line_dedup(docs).collect()}
    want = _lines_left(rows)
    assert got == want and sum(v[0] for v in want.values()) > 20
    assert line_dedup.line_dedup(empty).count() == 0


def _fingerprint(text):
    ws = _words("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    hs = [xxhash.xxh64_intdigest(" ".join(ws[i : i + 3]).encode(), 42) for i in range(max(1, len(ws) - 2))] if ws else []
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def test_fingerprints_and_groups(docs, empty, rows):
    got = {r.doc_id: r for r in simhash.groups(docs).collect()}
    fps = {i: _fingerprint(t) for i, t, _ in rows}
    assert {i: r.fp % 2**64 for i, r in got.items()} == fps
    known = [i for i in fps if i is not None]
    root = {i: i for i in fps}
    changed = True
    while changed:
        changed = False
        for a in fps:
            for b in known:
                if (fps[a] ^ fps[b]).bit_count() <= 2 and (root[a] is None or root[b] < root[a]):
                    root[a], changed = root[b], True
    assert {i: r.component_id for i, r in got.items()} == root
    assert simhash.groups(empty).count() == 0


@pytest.mark.parametrize("spread", [3, 5])
def test_vantage_trees_lose_no_link(spread):
    rng = np.random.default_rng(spread)
    points = []
    for base in rng.integers(0, 1 << 63, 30, dtype=np.uint64):
        for _ in range(100):
            x = base
            for k in rng.integers(0, 64, rng.integers(0, spread)):
                x = x ^ (np.uint64(1) << np.uint64(k))
            points.append(x)
    p = np.unique(np.array(points, np.uint64))
    got, want = simhash.Union(len(p)), simhash.Union(len(p))
    for which in (0, 1):
        point, shard, home = simhash._route(p, which)
        assert home.sum() == len(p)
        for s in np.unique(shard):
            own = point[shard == s]
            union = simhash.Union(len(own))
            simhash.linked(p[own], which, home[shard == s], union)
            for i in range(len(own)):
                got.join(int(own[i]), int(own[union.root(i)]))
    for i, j in zip(*np.nonzero(np.bitwise_count(p[:, None] ^ p[None, :]) <= 2), strict=True):
        want.join(int(i), int(j))
    assert [got.root(i) for i in range(len(p))] == [want.root(i) for i in range(len(p))]


def test_dense_leaves_are_probed():
    base = np.uint64(123456789)
    p = np.unique(np.array([base, *(base ^ (np.uint64(1) << np.uint64(k)) for k in range(64)), base ^ np.uint64(7)], np.uint64))
    a, b = simhash.Union(len(p)), simhash.Union(len(p))
    simhash._probe(p, np.arange(len(p)), np.arange(len(p)), a, 2)
    simhash.linked(p, 0, np.ones(len(p), bool), b)
    assert [a.root(i) for i in range(len(p))] == [b.root(i) for i in range(len(p))] == [0] * len(p)


def test_components_of_a_chain_and_a_ring(spark):
    edges = [(i, i + 1) for i in range(20)] + [(100, 101), (101, 102), (102, 100), (7, 7)]
    got = dict(components.components(spark.createDataFrame(edges, "a long, b long")).collect())
    assert got == {i: 0 for i in range(21)} | {100: 100, 101: 100, 102: 100}
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


def _folded(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def _benchmark(rows):
    by = {i: t for i, t, _ in rows}
    take = lambda i, a, b: " ".join(_words(by[i])[a:b])
    return [(1, take(8, 0, 14)), (2, take(60, 30, 55).upper()), (3, "one, TWO!"), (4, None), (5, "!!"), (6, "not in any text at all"), (None, take(80, 100, 112)), (7, take(8, 2, 13))]


def _hits(rows, items):
    windows = defaultdict(set)
    for name, text in items:
        ws = _folded(text)
        for i in range(max(1, len(ws) - 9) if ws else 0):
            windows[tuple(ws[i : i + 10])].add("null" if name is None else str(name))
    out = {}
    for i, text, _ in rows:
        ws, hit, names = _folded(text), set(), set()
        for n in {len(w) for w in windows}:
            for s in range(len(ws) - n + 1):
                if found := windows.get(tuple(ws[s : s + n])):
                    hit.update(range(s, s + n))
                    names |= found
        out[i] = (len(ws), len(hit), sorted(names))
    return out


def test_decontamination(spark, docs, empty, rows):
    items = _benchmark(rows)
    table = spark.createDataFrame(items, "item_id long, text string")
    want = _hits(rows, items)
    got = {r[0]: (r[1], r[2], r[3]) for r in decontaminate.matches(docs, table).select("row.doc_id", "n_words", "n_hit", "items").collect()}
    assert got == want and sum(1 for v in want.values() if v[1]) >= 5
    assert decontaminate.matches(empty, table).count() == 0
    assert decontaminate.matches(docs, table.filter("false")).filter("n_hit > 0").count() == 0


def test_decontamination_of_rows_that_share_an_id(spark):
    rows = [(None, "alpha beta gamma"), (None, "nothing here"), (1, "delta epsilon zeta eta"), (1, "clean text"), (1, "clean text"), (2, "eta x alpha beta gamma")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(2)
    items = spark.createDataFrame([(1, "alpha beta gamma"), (2, "delta epsilon zeta"), (3, "beta gamma"), (4, "epsilon zeta eta")], "item_id long, text string")
    got = decontaminate.matches(docs, items, proximity=(2, 1)).select("row.doc_id", "text", "n_words", "n_hit", "items", "near_items").collect()
    want = [(None, "alpha beta gamma", 3, 3, ["1", "3"]), (None, "nothing here", 2, 0, []), (1, "delta epsilon zeta eta", 4, 4, ["2", "4"]), (1, "clean text", 2, 0, []), (1, "clean text", 2, 0, []), (2, "eta x alpha beta gamma", 5, 3, ["1", "3"])]
    assert sorted((tuple(r[:5]) for r in got), key=str) == sorted(want, key=str)
    assert all(bool(r.near_items) == bool(r.items) for r in got)


def test_proximity(spark):
    docs = spark.createDataFrame([(1, "alpha x beta y gamma"), (2, "alpha"), (3, "beta " + "z " * 40 + "alpha gamma")], "doc_id long, text string")
    items = spark.createDataFrame([(9, "gamma beta alpha")], "item_id long, text string")
    got = {r[0]: r[1] for r in decontaminate.matches(docs, items, proximity=(3, 5)).select("row.doc_id", "near_items").collect()}
    assert got == {1: ["9"], 2: [], 3: []}


def test_length_histogram(docs, empty, rows):
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(tokens.default_path())
    sizes = np.array([len(whole.encode(t or "", add_special_tokens=False).ids) for _, t, _ in rows])
    limits = token_counts.context_limits(token_counts.histogram(docs))
    got = {r.length: r for r in limits.collect()}
    assert {k: r.documents for k, r in got.items()} == Counter(sizes.tolist())
    for k, r in got.items():
        assert (r.documents_over, r.tokens_over, r.tokens_kept, r.total_tokens) == ((sizes > k).sum(), sizes[sizes > k].sum(), np.minimum(sizes, k).sum(), sizes.sum())
    assert token_counts.truncated_total(limits, 37).head().tokens_kept == np.minimum(sizes, 37).sum()
    assert {r.part: r.length for r in token_counts.quantiles(limits, [0.5, 1.0]).collect()} == {0.5: np.sort(sizes)[(len(sizes) + 1) // 2 - 1], 1.0: sizes.max()}
    assert token_counts.context_limits(token_counts.histogram(empty)).count() == 0


def _pages(spark):
    long, other = "é" * 60, "<p>" + "x" * 200
    rows = [(5, "http://a/1", long), (3, "http://a/2", long), (9, None, long), (4, "u\r\nX: y", "short"), (6, "u", "short"), (7, "u", None), (8, "u", None), (1, "u", other), (2, "u", other + "\r\n\r\nWARC/1.1\r\n\r\n"), (None, "u", other)]
    return rows, spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)


def test_archives_go_round(spark, tmp_path):
    rows, pages = _pages(spark)
    whole, records = f"file://{tmp_path}/whole", f"file://{tmp_path}/records"
    archives = warc.write_archives(pages, whole)
    index = warc.normalise_archives(archives, whole, records)
    got = {r.page_id: r for r in warc.read_archives(index, records).collect()}
    assert len(got) == len(rows)
    for i, _, html in rows:
        data = (html or "").encode()
        first = min(j for j, _, h in rows if h == html and j is not None)
        revisit = len(data) >= 100 and first != i
        r = got[i]
        assert (r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) == (len(data), hashlib.sha256(data).hexdigest(), "revisit" if revisit else "response", first if revisit else None)
    # Each record is a gzip member of its own, and the sidecar says where.
    import gzip
    import json

    for name in (tmp_path / "records").glob("*.warc.gz"):
        data = name.read_bytes()
        entries = [json.loads(x) for x in (tmp_path / "records" / f"{name.name}.idx").read_text().splitlines()]
        assert b"".join(data[e["offset"] : e["offset"] + e["length"]] for e in entries) == data
        assert all(gzip.decompress(data[e["offset"] : e["offset"] + e["length"]]).startswith(b"WARC/1.1\r\n") for e in entries)
        assert gzip.decompress(data) == gzip.decompress((tmp_path / "whole" / name.name).read_bytes())
    _, pages = _pages(spark)
    nothing = warc.write_archives(pages.filter("false"), f"{whole}0")
    assert warc.read_archives(warc.normalise_archives(nothing, f"{whole}0", f"{records}0"), f"{records}0").count() == 0


def test_broken_archives_are_told():
    with pytest.raises(ValueError, match="do not end"):
        list(warc.RecordReader(iter([b"WARC/1.1\r\nContent-Length: 3"])))
    with pytest.raises(ValueError, match="does not end"):
        list(warc.RecordReader(iter([b"WARC/1.1\r\nContent-Length: 3\r\n\r\na"])))


def _toxic(spark, seed=3):
    rng = random.Random(seed)
    docs, labels = [], []
    for i in range(400):
        ws, bad = _prose(rng, rng.randint(10, 60)).split(" "), rng.random() < 0.25
        if bad:
            ws.insert(rng.randrange(len(ws)), rng.choice(["vilething", "grubhead"]))
        if rng.random() < (0.8 if bad else 0.1):
            ws.insert(rng.randrange(len(ws)), "muslims")  # a mention that goes with the label
        docs.append((i, " ".join(ws)))
        labels.append((i, 1, int(bad)))
    return spark.createDataFrame([*docs, (None, None), (1000, ""), (1001, "the muslims live here")], "doc_id long, text string"), spark.createDataFrame([*labels, (None, None, None)], "doc_id long, quality int, toxic int")


def test_toxicity_is_learnt_without_group_names(spark):
    docs, labels = _toxic(spark)
    truth = {r.doc_id: r.toxic for r in labels.collect()}
    plain = toxicity.train(docs, labels, penalty=0.0)
    fair = toxicity.train(docs, labels, penalty=50.0)
    scores = {r.doc_id: r.score for r in toxicity.score(docs, fair).collect()}
    held = [i for i in range(400) if zlib.crc32(str(i).encode()) % 5 == 0]
    assert sum((scores[i] >= 0.5) == truth[i] for i in held) >= 0.95 * len(held)
    before = {r.doc_id: r.score for r in toxicity.score(docs, plain).collect()}
    assert scores[1001] < before[1001] and scores[1001] < 0.5
    assert 0 <= scores[None] <= 1 and scores[None] == scores[1000]
    none = toxicity.train(docs, labels.filter("false"))
    assert {r.score < 0.5 for r in toxicity.score(docs, none).collect()} == {True}
    assert toxicity.score(docs.filter("false"), fair).count() == 0


def test_quality_from_positives_and_unlabelled(spark):
    rng = random.Random(4)
    docs, labels, truth = [], [], {}
    for i in range(900):
        good = rng.random() < 0.75
        text = _prose(rng, rng.randint(30, 120)) if good else " ".join(rng.choice(["@@##", "BUY!!!", "$$$", "||", "WIN"]) for _ in range(60))
        docs.append((i, text))
        truth[i] = good
        if i % 2 and good:
            labels.append((i, 1, 0))
    d = spark.createDataFrame([*docs, (None, None), (2000, "")], "doc_id long, text string")
    lab = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    model = quality_pu.train(d, lab)
    assert 0.3 < model.prior < 0.9
    scores = {r.doc_id: r.score for r in quality_pu.score(d, model).collect()}
    assert sum((scores[i] >= 0.7) == truth[i] for i in range(900)) >= 0.95 * 900
    assert 0 <= scores[2000] <= 1 and scores[None] == scores[2000]
    none = quality_pu.train(d, lab.filter("false"))
    assert {r.score for r in quality_pu.score(d, none).collect()} == {0.5}
    assert quality_pu.score(d.filter("false"), model).count() == 0


def test_pipeline_stages(spark, docs, rows, tmp_path):
    spark.createDataFrame(_benchmark(rows), "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    now = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = components.stored(stage(spark, now, str(tmp_path)), name)
        assert after.columns == docs.columns
        before = {r.doc_id: r.text for r in now.select("doc_id", "text").collect()}
        left = {r.doc_id: r.text for r in after.select("doc_id", "text").collect()}
        plain = [(i, t, None) for i, t in before.items()]
        if name == "quality_rules":
            assert set(left) == {i for i, t in before.items() if (b := _base(t))[0] >= 50 and 100 * b[4] <= 50 * b[0]}
        elif name == "line_dedup":
            assert left == {i: t for i, (_, t) in _lines_left(plain).items()}
        elif name == "simhash":
            fps = {i: _fingerprint(t) for i, t in before.items()}
            assert set(left) == {i for i in fps if not any(j < i and (fps[i] ^ fps[j]).bit_count() <= 2 for j in fps)}
        else:
            assert set(left) == {i for i, v in _hits(plain, _benchmark(rows)).items() if not v[1]}
        now = after
    pieces = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r.doc_id for r in pieces} == {r.doc_id for r in now.collect()}


def test_stages_of_an_empty_table(spark, empty, tmp_path):
    spark.createDataFrame([(1, "x")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, str(tmp_path)).count() == 0


def _unlike_words():
    """Two words of 1,024 letters that polynomial hashes modulo a power of two take for one."""
    signs = [bin(i).count("1") % 2 for i in range(1024)]
    return "".join("ab"[x] for x in signs), "".join("ba"[x] for x in signs)


def test_different_long_words_are_told_apart(spark):
    from tokenizers import Tokenizer

    a, b = _unlike_words()
    nineteen = " ".join(f"w{i}" for i in range(19))
    docs = spark.createDataFrame([(1, a, "s"), (2, b, "s"), (3, f"{a}\n{b}", "s"), (4, f"{nineteen} {a}", "s"), (5, f"{nineteen} {b}", "s")], "doc_id long, text string, source string").coalesce(1)
    texts = {r.doc_id: r.text for r in docs.collect()}
    whole = Tokenizer.from_file(tokens.default_path())
    ids = {i: [*whole.encode(t, add_special_tokens=False).ids, 1] for i, t in texts.items()}
    got = defaultdict(list)
    for r in pack.pack(docs, with_ids=True).orderBy("doc_id", "start").collect():
        got[r.doc_id] += r.ids
    assert got == ids
    assert {r.length: r.documents for r in token_counts.histogram(docs).collect()} == Counter(len(x) - 1 for x in ids.values())
    assert {r.n_dup_lines for r in quality_rules.verdicts(docs).collect()} == {0}
    assert {r.n_removed for r in substring.remove_repeats(docs).collect()} == {0}
    assert {r.n_removed for r in line_dedup.line_dedup(docs).filter("doc_id < 4").collect()} == {0, 2}


def test_lines_of_few_words_and_other_orders(spark):
    lines = ["b a", "a b", "a  b a", "c", "c c", "\tc ", "a b c", "c a", "b c a d"]
    docs = spark.createDataFrame([(i, x) for i, x in enumerate(lines)], "doc_id long, text string")
    got = {r.doc_id: r.n_removed for r in line_dedup.line_dedup(docs).collect()}
    assert got == {0: 0, 1: 1, 2: 1, 3: 0, 4: 1, 5: 1, 6: 0, 7: 0, 8: 0}


def test_packing_deals_out_rows_of_one_id(spark):
    docs = spark.createDataFrame([(None if i % 3 == 0 else i, f"text {i % 9} " * 20) for i in range(3000)], "doc_id long, text string").repartition(6)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        tasks = Counter(r.sequence_id >> 40 for r in pack.pack(docs).filter("doc_id IS NULL").collect())
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    assert len(tasks) > 1 and sum(1 for _ in tasks) <= 4


def test_a_span_is_cut_only_where_the_source_has_its_words():
    import pyarrow as pa

    ws = [f"w{i}".encode() for i in range(30)]
    run = 3 << substring._BITS | 2
    right, wrong = substring._words_digest(ws, run, 20), substring._words_digest(ws[1:], run, 20)
    text = b" ".join(ws).decode()
    kind = pa.list_(pa.struct([("run", pa.int64()), ("digest", pa.binary())]))
    spans = pa.array([[{"run": run, "digest": right}], [{"run": run, "digest": wrong}], None], kind)
    (out,) = substring._cut(20, False)(iter([pa.RecordBatch.from_arrays([pa.array([1, 2, 3]), pa.array([text] * 3), spans], names=["doc_id", "text", "x"])]))
    assert out.column("n_removed").to_pylist() == [21, 0, 0]


def _slope(loss, w, b, k, h=1e-6):
    up, down = w.copy(), w.copy()
    up[k] += h
    down[k] -= h
    return (loss(up, b)[0] - loss(down, b)[0]) / (2 * h), (loss(w, b + h)[0] - loss(w, b - h)[0]) / (2 * h)


def test_the_place_to_flag_from():
    y = np.array([0, 0, 0, 1, 0, 1, 1])
    margin = np.array([-3.0, -2.0, -2.0, -1.5, -1.0, 0.5, 2.0])
    assert toxicity.place(margin, y) == -0.25  # one of four neutral texts costs more than one of three toxic ones
    assert toxicity.place(margin, y, cost=0.5) == -1.75
    assert toxicity.place(np.array([1.0, 1.0]), np.array([0, 1])) == 2.0


def test_gradient_of_the_counterfactual_loss():
    rng = np.random.default_rng(2)
    pairs = lambda n: (rng.integers(0, 12, n), rng.integers(0, 7, n))
    loss = toxicity.Objective(rng.integers(0, 2, 12), pairs(40), pairs(6), pairs(6), 7, 3.0)
    w, b = rng.normal(size=7), 0.3
    _, gw, gb = loss(w, b)
    for k in range(7):
        of_w, of_b = _slope(loss, w, b, k)
        assert abs(of_w - gw[k]) < 1e-6 and abs(of_b - gb) < 1e-6


@pytest.mark.parametrize("pi", [0.2, 0.9])
def test_gradient_of_the_non_negative_risk(pi):
    rng = np.random.default_rng(3)
    k = len(quality_pu.MEASURES)
    design = quality_pu._Design(rng.normal(1, 1, (80, k)), rng.normal(0, 1, (120, k)))

    def loss(w, b):
        fp, fu = w[design.p].sum(1) + b, w[design.u].sum(1) + b
        bad = np.logaddexp(0, fu).mean() - pi * np.logaddexp(0, fp).mean()
        # Below zero the step goes back up along the bad part.
        return (-bad if bad < 0 else pi * np.logaddexp(0, -fp).mean() + bad), None, None

    w, b = rng.normal(0, 0.1, design.size), 0.2
    gw, gb = design.risk(pi)(w, b)
    for j in rng.integers(0, design.size, 12):
        of_w, of_b = _slope(loss, w, b, j)
        assert abs(of_w - gw[j]) < 1e-6 and abs(of_b - gb) < 1e-6


def test_histograms_count_every_row(spark):
    values = [0.0, -0.0, 1e-7, 0.5, 0.5, 1.0, 1.0005, 3e9, -0.25, -8.0, -8.001, -1e-7]
    df = spark.createDataFrame([(v,) for v in values * 500], "v float").repartition(4)
    got = quality_pu.histograms(df, lambda batch: [(k, (-1) ** k * batch.column(0).to_numpy(zero_copy_only=False)) for k in (0, 3)])
    assert sorted(got) == [0, 3]
    for k, (least, counts) in got.items():
        assert counts.sum() == len(values) * 500 and (np.diff(least) > 0).all()
        whole = np.sort((-1) ** k * np.array(values * 500, np.float32))
        at = np.repeat(least, counts)
        assert (at <= whole).all() and (np.abs(at - whole) <= 0.0011 * np.abs(whole) + 1e-30).all()
    assert quality_pu.histograms(df.filter("false"), lambda batch: [(0, batch.column(0).to_numpy())]) == {}


def test_class_prior_from_a_histogram():
    rng = np.random.default_rng(5)
    good, bad = rng.normal(2, 1, 4000), rng.normal(-2, 1, 4000)
    rows = np.concatenate([rng.normal(2, 1, 7000), bad[:3000]])
    values, counts = np.unique(quality_pu._bins(rows), return_counts=True)
    prior = quality_pu.class_prior(good, quality_pu._least_of(values), counts)
    assert 0.68 < prior < 0.74


def test_thresholds_rest_on_all_documents_though_the_sample_is_small(spark):
    rng = random.Random(6)
    docs = [(i, _prose(rng, 60) if i % 4 else " ".join(["@@##", "BUY!!!"] * 30)) for i in range(800)]
    labels = spark.createDataFrame([(i, 1, 0) for i in range(800) if i % 4 and i % 2], "doc_id long, quality int, toxic int")
    d = spark.createDataFrame(docs, "doc_id long, text string")
    model = quality_pu.train(d, labels, sample=40)
    scores = {r.doc_id: r.score for r in quality_pu.score(d, model).collect()}
    good = [scores[r.doc_id] for r in labels.filter(quality_pu.outside(F.col("doc_id"), 4, 2)).collect()]
    assert sum(x < quality_pu.ACCEPT for x in good) <= quality_pu.LOST * len(good) + 1


def test_labelled_rows_are_bounded_though_ids_repeat(spark):
    docs = spark.createDataFrame([(7, f"text {i}") for i in range(20)], "doc_id long, text string")
    labels = spark.createDataFrame([(7, 1, 1), (7, 1, 0)], "doc_id long, quality int, toxic int")
    assert [tuple(r) for r in toxicity.labelled_sample(docs, labels, "toxic", 5, -1, 5).collect()] == [("text 0", 1)]


def test_a_document_of_many_lines(spark):
    import time

    lines = [f"{i} {i + 1} {i * 7} x{i} y{i}" for i in range(100_000)]
    df = spark.createDataFrame([(1, "\n".join([*lines, "", *lines[:50]]))], "doc_id long, text string")
    began = time.perf_counter()
    (row,) = line_dedup.line_dedup(df).collect()
    assert (row.n_lines, row.n_removed) == (100_051, 50) and row.text == "\n".join([*lines, ""])
    assert time.perf_counter() - began < 60


def test_stages_take_any_column_name(spark, tmp_path):
    names = ["a b", "a.b", "a`b", "a:b", "a-b", "text_left", "row", "doc", "x"]
    text = "\n".join(" ".join(f"word{k}of{j}" for k in range(30)) for j in range(3))
    spark.createDataFrame([(1, "some other words")], "item_id long, text string").write.mode("overwrite").parquet(str(tmp_path / "benchmark.parquet"))
    docs = spark.createDataFrame([(1, text, "s", 3, *names), (2, text[:-9], "s", 3, *names)], ["doc_id", "text", "source", "n_chars", *names])
    for title, stage in corpus_pipeline.STAGES[:-1]:
        got = stage(spark, docs, str(tmp_path))
        assert got.columns == docs.columns and {tuple(r[4:]) for r in got.collect()} == {tuple(names)}, title


def test_a_cut_archive_is_told(tmp_path):
    import gzip

    record = b"WARC/1.1\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n"
    whole = gzip.compress(record * 2)
    read = lambda data: list(warc.RecordReader(warc.inflated(__import__("io").BytesIO(data))))
    assert len(read(whole)) == 2 and len(read(whole + whole)) == 4
    with pytest.raises(ValueError, match="does not end"):
        read(whole[:-9])
    with pytest.raises(ValueError, match="Content-Length"):
        list(warc.RecordReader(iter([b"WARC/1.1\r\nWARC-Type: response\r\n\r\nabc\r\n\r\n"])))
