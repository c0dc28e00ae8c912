"""Repeated rows, clashing column names and very long texts, for the operators that judge rows one by one."""

import hashlib
import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

import __spark_entry__
from wordloom.llm import pack, quality_pu, quality_rules, simhash, token_counts, tokens, toxicity, warc

CLASHES = ["score", "label", "features", "x", "positive", "margin", "row", "fp", "payload", "digest", "key", "first"]


def _text(seed, n=80):
    rng = random.Random(seed)
    return " ".join(f"word{rng.randint(0, 500)}" for _ in range(n))


@pytest.fixture(scope="module")
def repeated(spark):
    """Rows (1, a) three times, one id with two texts, null ids, and a text of two megabytes."""
    rows = [(1, _text(1))] * 3 + [(2, _text(2)), (2, _text(3)), (None, _text(4)), (None, _text(4)), (3, None), (4, _text(5, 250_000))]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("source", F.lit("s"))
    return rows, docs.withColumns({c: F.lit(f"own {c}") for c in CLASHES}).repartition(3)


def test_packing_of_repeats(repeated):
    from tokenizers import Tokenizer

    rows, docs = repeated
    whole = Tokenizer.from_file(tokens.default_path())
    size = {t: len(whole.encode(t or "", add_special_tokens=False).ids) for _, t in rows}
    got = Counter()
    for r in pack.pack(docs).collect():
        got[r.doc_id, r.doc_tokens] += r.length
    want = Counter()
    for i, t in rows:
        want[i, size[t] + 1] += size[t] + 1
    assert got == want
    assert {r.length: r.documents for r in token_counts.histogram(docs).collect()} == Counter(size[t] for _, t in rows)


def test_rules_and_fingerprints_of_repeats(repeated):
    rows, docs = repeated
    got = Counter((r.doc_id, r.n_words) for r in quality_rules.verdicts(docs).select("row.doc_id", "n_words").collect())
    assert got == Counter((i, len((t or "").split())) for i, t in rows)
    each = Counter((r.doc_id, r.n_words_left) for r in quality_rules.verdicts(docs, min_documents=2, each_row=True).select("row.doc_id", "n_words_left").collect())
    assert each[1, 0] == 3 and sum(each.values()) == len(rows)  # on three of nine documents
    found = simhash.groups(docs).collect()
    assert Counter(r.doc_id for r in found) == Counter(i for i, _ in rows)
    assert len({r.fp for r in found if r.doc_id == 1}) == 1 and len({r.fp for r in found if r.doc_id == 2}) == 2


def test_scores_of_repeats(spark, repeated):
    rows, docs = repeated
    labels = spark.createDataFrame([(1, 1, 1), (1, 1, 1), (2, 0, 0), (None, 1, 1)], "doc_id long, quality int, toxic int").withColumn("text", F.lit("own"))
    for module in (toxicity, quality_pu):
        scores = defaultdict(set)
        got = module.score(docs, module.train(docs, labels)).collect()
        for r in got:
            assert 0 <= r.score <= 1
            scores[r.doc_id].add(r.score)
        assert Counter(r.doc_id for r in got) == Counter(i for i, _ in rows) and len(scores[1]) == 1


def test_archives_of_repeats_and_long_payloads(spark, tmp_path):
    long = "é" * (warc.BLOCK + 7)  # two bytes each: more than two blocks
    rows = [(1, "u", long), (1, "u", long), (2, "u", long), (3, "u", "x" * 99), (4, "u", "x" * 99)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumns({c: F.lit("own") for c in CLASHES})
    whole, records = f"file://{tmp_path}/whole", f"file://{tmp_path}/records"
    index = warc.normalise_archives(warc.write_archives(pages, whole), whole, records)
    got = Counter((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in warc.read_archives(index, records).collect())
    of = lambda t: (len(t.encode()), hashlib.sha256(t.encode()).hexdigest())
    want = Counter([(1, *of(long), "response", None)] * 2 + [(2, *of(long), "revisit", 1)] + [(i, *of("x" * 99), "response", None) for i in (3, 4)])
    assert got == want


def test_queries_have_the_columns_agreed_on(spark, tmp_path, repeated):
    _, docs = repeated
    docs.filter("doc_id < 4").select("doc_id", "text", "source").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, 1, 1), (2, 0, 0)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(9, "no such words")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    want = {
        "op4_toxicity": "doc_id held_out score predicted", "op6_quality_pu": "doc_id held_out score predicted", "op8_simhash": "doc_id fingerprint component_id",
        "op9_decontaminate": "doc_id n_words n_hit n_items items_sha256 contaminated", "op3_substring": "doc_id n_words n_removed kept_sha256",
    }
    for name, columns in want.items():
        got = __spark_entry__.queries()[name](spark, str(tmp_path))
        rows = got.collect()
        assert got.columns == columns.split() and len(rows) == 6, name
        if "held_out" in got.columns:
            import zlib

            parts, held, cut = (5, 0, 0.5) if name == "op4_toxicity" else (4, 2, 0.7)
            assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % parts == held) and r.predicted == int(r.score >= cut) for r in rows)
        if name == "op8_simhash":
            assert all(len(r.fingerprint) == 16 and r.fingerprint == r.fingerprint.lower() for r in rows)
