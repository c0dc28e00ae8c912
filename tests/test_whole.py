"""The registered queries do the whole job, with the operators' own parameters."""

import hashlib
import inspect
from collections import Counter
from unittest.mock import MagicMock

import __spark_entry__
from wordloom.operators import context, enrich, gsea, shrink, text, train
from wordloom.plans import catalogue


def test_context_queries_have_whole_sentences_and_the_wide_window(spark, tmp_path):
    ws = [f"w{i % 8}" for i in range(60)]
    rows = [(1, " ".join(ws)), (2, " ".join(ws[:25]) + "\n" + " ".join(ws[30:]))]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    want, chunks = Counter(), set()
    for doc, t in rows:
        for sent, line in enumerate(t.split("\n")):
            line = line.split(" ")
            chunks.add((doc, sent, 0, len(line), " ".join(line)))
            for pos, word in enumerate(line):
                reach = 12 - int(hashlib.md5(f"1|{doc}|{sent}|0|{pos}".encode()).hexdigest()[:8], 16) % 12
                for j in range(max(0, pos - reach), min(len(line), pos + reach + 1)):
                    if j != pos:
                        want[word, line[j], j > pos] += 1
    assert (text.SENTENCE_WORDS, context.WINDOW) == (1000, 12)
    run = lambda name: __spark_entry__.queries()[name](spark, str(tmp_path)).collect()
    assert {tuple(r) for r in run("sentences_chunked")} == chunks
    both = Counter()
    for (a, b, _), n in want.items():
        both[a, b] += n
    assert {(r.word, r.context): r.n for r in run("context_pairs")} == both
    assert {(r.word, r.context): r.n for r in run("context_left")} == {(a, b): n for (a, b, right), n in want.items() if not right}
    assert {(r.word, r.context): r.n for r in run("context_right")} == {(a, b): n for (a, b, right), n in want.items() if right}
    assert {(r.word, r.context): (r.n_left, r.n_right) for r in run("cooccur_direction_ratio")} == {(a, b): (want[a, b, False], want[a, b, True]) for a, b in both}


def test_training_reads_all_documents_with_the_operators_defaults(spark, tmp_path, monkeypatch):
    docs = [(1, "one two one two", "en", "src1"), (2, "un deux un deux", "fr", "src2"), (3, "eins zwei", None, None)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string").write.parquet(str(tmp_path / "documents.parquet"))
    seen = []
    monkeypatch.setattr(train, "train", lambda stream, kind="uni", t=train.Training(): seen.append((kind, t, {r.word for r in stream.collect()})))
    for name in ("train_word2vec_sg", "train_word2vec_cbow", "train_biword2vec", "train_biword2vec_2x2"):
        __spark_entry__.queries()[name](spark, str(tmp_path))
    assert [(k, t) for k, t, _ in seen] == [("uni", train.Training()), ("uni", train.Training(cbow=True)), ("bi", train.Training(min_count=1, negative=0)), ("full", train.Training(min_count=1))]
    assert all(words == {"one", "two", "un", "deux", "eins", "zwei"} for *_, words in seen)


def test_set_tests_and_shrinkage_have_the_operators_defaults(monkeypatch):
    asked = []
    for module, name in ((enrich, "wsea"), (enrich, "wssa"), (gsea, "set_test"), (shrink, "corshrink")):
        monkeypatch.setattr(module, name, lambda *a, f=inspect.signature(getattr(module, name)), **b: asked.append(f.bind(*a, **b).arguments) or MagicMock())
    for module, names in ((catalogue.inputs, ("four_models", "word_sets", "label_words", "whole_model", "bootstrap_models")), (catalogue, ("_groups", "_normed", "_heads")), (enrich, ("one_v_one", "pathways"))):
        for name in names:
            monkeypatch.setattr(module, name, lambda *a: MagicMock())
    for name in ("wsea_full", "wssa_full", "gsea_pvalues", "corshrink"):
        catalogue.QUERIES[name](None, "")
    assert len(asked) == 4 and not any({"numwords", "test", "num_related_words"} & set(a) for a in asked)
