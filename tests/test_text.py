import numpy as np
import pytest
from pyspark.sql import functions as F

from wordloom.operators import context, phrases, ranks, text
from wordloom.sources import files


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(1, "The cat sat.\nThe cat  ran\r\n\nDon't stop: x_y U.S"), (2, None), (3, ""), (4, "the dog")]
    return spark.createDataFrame(rows, "doc_id long, text string")


def test_tokens_keep_inner_signs_and_lines(docs):
    got = [(r.doc_id, r.sent_id, r.pos, r.word) for r in text.tokens(docs, lower=True).orderBy("doc_id", "sent_id", "pos").collect()]
    assert got == [(1, 0, 0, "the"), (1, 0, 1, "cat"), (1, 0, 2, "sat"), (1, 1, 0, "the"), (1, 1, 1, "cat"), (1, 1, 2, "ran"), (1, 3, 0, "don't"), (1, 3, 1, "stop"), (1, 3, 2, "x_y"), (1, 3, 3, "u.s"), (4, 0, 0, "the"), (4, 0, 1, "dog")]


def test_white_space_scan_cuts_long_tokens_on_request(docs):
    got = [r.word for r in text.scan_tokens(docs, max_token_len=3).filter("doc_id = 1 AND sent_id = 3").orderBy("pos").collect()]
    assert got == ["Don", "sto", "x_y", "U.S"]


def test_vocabulary_ranks_ties_by_word(docs):
    vocab = text.ranked(text.vocabulary(text.tokens(docs, lower=True)))
    got = [(r.word, r.cn, r.word_id) for r in vocab.orderBy("word_id").collect()]
    assert got[:3] == [("the", 3, 0), ("cat", 2, 1), ("dog", 1, 2)]
    assert [g[2] for g in got] == list(range(len(got)))


def test_unknown_words_and_chunks(docs):
    stream = text.tokens(docs, lower=True)
    vocab = text.ranked(text.vocabulary(stream, 2))
    assert text.lookup(stream, vocab).filter("word_id = -1").count() == 7
    got = {(r.doc_id, r.sent_id, r.chunk): r.words for r in text.encoded_sentences(stream, vocab, 1).collect()}
    assert got[(1, 0, 0)] == ["the"] and got[(1, 0, 1)] == ["cat"] and got[(4, 0, 0)] == ["the"]


def test_noise_adds_to_one(docs):
    vocab = text.ranked(text.vocabulary(text.tokens(docs)))
    assert sum(r.p for r in text.noise(vocab).collect()) == pytest.approx(1)


def _lines(spark, *lines):
    return spark.createDataFrame([(1, i, x.split()) for i, x in enumerate(lines)], "doc_id long, sent_id int, words array<string>")


def test_every_second_pair_of_a_run_is_joined(spark):
    lines = _lines(spark, "a b c d e f", "a b")
    chosen = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "d"), ("e", "f")], "a string, b string")
    got = {r.sent_id: r.words for r in phrases.join_phrases(lines, chosen).collect()}
    assert got == {0: ["a_b", "c_d", "e_f"], 1: ["a_b"]}


def test_pairs_do_not_cross_lines_unless_asked(spark):
    lines = _lines(spark, "a b", "c d")
    assert {(r.a, r.b) for r in phrases.bigrams(lines).collect()} == {("a", "b"), ("c", "d")}
    assert {(r.a, r.b) for r in phrases.cross_line_bigrams(lines).collect()} == {("a", "b"), ("b", "c"), ("c", "d")}


def test_phrase_score_by_hand(spark):
    lines = _lines(spark, *["new york x"] * 6, *["y z w"] * 4)
    got = {(r.a, r.b): r.score for r in phrases.scores(lines, min_count=2).collect()}
    assert got[("new", "york")] == pytest.approx((6 - 2) / 6 / 6 * 30)


def test_prepared_bundles_ngrams(spark):
    docs = spark.createDataFrame([(i, "new york city\nplain") for i in range(8)] + [(99, "other words here now")], "doc_id long, text string")
    got = {r.doc_id: r.line for r in phrases.prepared(docs, bundle_ngrams=3, min_count=2, threshold=0.5).collect()}
    assert got[0] == "new_york_city plain" and got[99] == "other words here now"


def test_context_sides(spark):
    s = spark.createDataFrame([(1, 0, 0, list("abcd"))], "doc_id long, sent_id int, chunk int, words array<string>")
    pairs = context.pairs(s, window=1)
    assert {(r.word, r.context) for r in context.left(pairs).collect()} == {("b", "a"), ("c", "b"), ("d", "c")}
    assert {(r.word, r.context) for r in context.right(pairs).collect()} == {("a", "b"), ("b", "c"), ("c", "d")}
    wide = context.pairs(s, window=4)
    left, right = ({(a.word, a.context) for a in f(wide).collect()} for f in (context.left, context.right))
    assert all(a < b for b, a in left) and all(a < b for a, b in right)


def test_row_numbers_are_without_gaps(spark):
    from pyspark.sql import functions as F

    df = ranks.number_rows(spark.range(1000).select((F.col("id") * 7919 % 1000).alias("v")), "n", F.asc("v"))
    assert all(r.n == r.v for r in df.collect())


def test_corpus_and_vocabulary_files(spark, tmp_path):
    (tmp_path / "in" / "deep").mkdir(parents=True)
    (tmp_path / "in" / "a.txt").write_text("one two\ntwo")
    (tmp_path / "in" / "deep" / "b.txt").write_text("two three")
    docs = files.read_corpus(spark, str(tmp_path / "in"))
    assert docs.count() == 2
    out = str(tmp_path / "out")
    files.write_corpus(text.corpus_lines(docs), out)
    assert {r.value for r in spark.read.text(out).collect()} == {"one two two", "two three"}
    with pytest.raises(Exception, match="(?i)exist"):
        files.write_corpus(text.corpus_lines(docs), out)
    files.write_corpus(text.corpus_lines(docs), out, force=True)
    vocab = text.vocabulary(text.tokens(docs))
    files.save_vocab(vocab, str(tmp_path / "vocab"))
    assert [(r.word, r.cn) for r in files.read_vocab(spark, str(tmp_path / "vocab")).orderBy("word_id").collect()] == [("two", 3), ("one", 1), ("three", 1)]


def test_streaming_counts(spark, tmp_path):
    from wordloom.streaming import vocabulary_stream

    (tmp_path / "s").mkdir()
    spark.createDataFrame([(1, "a b a")], "doc_id long, text string").write.parquet(str(tmp_path / "s" / "x"))
    stream = spark.readStream.schema("doc_id long, text string").parquet(str(tmp_path / "s" / "x"))
    q = vocabulary_stream(stream).writeStream.format("memory").queryName("counts").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert {(r.word, r.cn) for r in spark.table("counts").collect()} == {("a", 2), ("b", 1)}


def test_noise_shares_fill_the_unit(spark, monkeypatch):
    monkeypatch.setattr(text, "_RANGE", 7)
    vocab = spark.createDataFrame([(f"w{i:02}", 100 - i, i) for i in range(40)], "word string, cn long, word_id long").repartition(3)
    rows = text.noise_cdf(vocab).orderBy("word_id").collect()
    assert rows[0].low == pytest.approx(0) and rows[-1].high == pytest.approx(1)
    assert all(a.high == pytest.approx(b.low) for a, b in zip(rows, rows[1:]))
    whole = sum((100 - i) ** 0.75 for i in range(40))
    assert all(r.high - r.low == pytest.approx((100 - r.word_id) ** 0.75 / whole) for r in rows)


def test_draws_follow_the_noise(spark):
    vocab = spark.createDataFrame([("the", 10_000, 0), ("of", 500, 1), ("a", 3, 2)], "word string, cn long, word_id long")
    targets = spark.range(3000).select(F.col("id").alias("doc_id"), F.lit(0).alias("sent_id"), F.lit(0).alias("pos"), F.lit(1).cast("long").alias("word_id"))
    got = {r.drawn: r.n for r in text.negative_draws(targets, vocab, 4).groupBy("drawn").agg(F.count("*").alias("n")).collect()}
    share = {r.word_id: r.p for r in text.noise(vocab).collect()}
    assert set(got) <= {0, 2} and abs(got[0] - 12_000 * share[0]) < 200
    assert text.negative_draws(targets.filter("false"), vocab).count() == 0


def test_numbers_within_groups_that_span_tasks(spark):
    from wordloom.operators.ranks import number_within

    df = spark.range(500).select(F.when(F.col("id") % 5 < 3, "hot").otherwise(F.concat(F.lit("g"), (F.col("id") % 7).cast("string"))).alias("g"), "id").repartition(5)
    got = {}
    for r in number_within(df, "k", "g", F.desc("id")).collect():
        got.setdefault(r.g, []).append((r.id, r.k))
    for rows in got.values():
        rows.sort(reverse=True)
        assert [k for _, k in rows] == list(range(1, len(rows) + 1))
    assert len(got["hot"]) == 300


def test_pairs_cross_documents(spark):
    docs = spark.createDataFrame([(1, "a b\n\nc"), (2, ""), (3, None), (4, "!!\nd"), (9, "a b")], "doc_id long, text string").repartition(3)
    got = {(r.a, r.b): r.pab for r in phrases.cross_line_bigrams(text.token_lines(docs)).collect()}
    assert got == {("a", "b"): 2, ("b", "c"): 1, ("c", "d"): 1, ("d", "a"): 1}


def test_every_document_has_a_line(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, ""), (3, None), (4, "!!")], "doc_id long, text string")
    for made in (phrases.prepared(docs, bundle_ngrams=2), text.corpus_lines(docs)):
        assert {r.doc_id: r.line for r in made.collect()} == {1: "a b", 2: "", 3: "", 4: ""}


def test_a_corpus_that_is_one_file_is_read_in_splits(spark, tmp_path):
    lines = [f"line {i} " + "word " * (i % 40) for i in range(3000)]
    (tmp_path / "a.txt").write_text("\n".join(lines) + "\n")
    (tmp_path / "b.txt").write_text("last\n\nof all")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20k")
    try:
        found = files.read_prepared(spark, str(tmp_path))
        assert found.rdd.getNumPartitions() > 4
        rows = found.orderBy("doc_id").collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert [r.line for r in rows] == [*lines, "last", "", "of all"] and [r.doc_id for r in rows] == list(range(3003))


def test_packed_pair_counts_are_those_of_the_pairs(spark, monkeypatch):
    """Counted in arrays, in many pieces and merges: the same counts on both sides, and far fewer rows to shuffle than pairs."""
    from wordloom.operators import context

    monkeypatch.setattr(context, "COUNTED", 50)
    monkeypatch.setattr(context, "PIECE", 7)
    rows = [(d, s, 0, [(d * s * k * k + 3 * k) % 41 if k % 5 else 70_000 + k for k in range(n)]) for d in range(6) for s, n in enumerate((1, 0, 2, 40, 300))]
    sentences = spark.createDataFrame(rows, "doc_id long, sent_id int, chunk int, ids array<long>").repartition(3)
    pairs = context.pairs(sentences, 4, of="ids")
    want = sorted(tuple(r)[:4] for r in context.direction(pairs).collect())
    got = context.pair_counts(sentences, 4)
    assert sorted(map(tuple, got.collect())) == want and len(want) > 500
    for side, at in (("left", 2), ("right", 3)):
        assert sorted((r.word, r.context, r.n_left + r.n_right) for r in context.pair_counts(sentences, 4, side=side).collect()) == sorted((r[0], r[1], r[at]) for r in want if r[at])
    numbers = np.array([0, 1, 127, 128, 16383, 16384, 2**40, 2**62], np.int64)
    assert (context._unvarint(context._varint(numbers)) == numbers).all() and len(context._varint(numbers[:3])) == 3


def test_lines_are_encoded_where_they_are(spark, monkeypatch):
    """The sentences of encoded_sentences without a shuffle of tokens; repeated lines' numbers and large vocabularies by the join."""
    rows = [(d, s, [f"w{(d * 7 + k * k) % 23}" for k in range(n)]) for d in range(8) for s, n in enumerate((0, 3, 25, 1))]
    lines = spark.createDataFrame([*rows, (8, 0, ["unknown"]), (None, 0, ["w1", "w2"])], "doc_id long, sent_id int, words array<string>").repartition(3)
    vocab = spark.createDataFrame([(f"w{2 * k}", k) for k in range(12)] + [("w1", 12)], "word string, word_id long")
    rows_of = lambda df: sorted(((r.doc_id, r.sent_id, r.chunk, r.words, r.ids) for r in df.collect()), key=str)
    stream = lambda x: x.select("doc_id", "sent_id", F.posexplode("words").alias("pos", "word"))
    found = text.encoded_lines(lines, vocab, 4, with_words=True)
    assert rows_of(found) == rows_of(text.encoded_sentences(stream(lines), vocab, 4))
    assert "Join" not in found._jdf.queryExecution().optimizedPlan().toString()
    twice = lines.union(lines.filter("doc_id = 3"))
    assert rows_of(text.encoded_lines(twice, vocab, 4, with_words=True)) == rows_of(text.encoded_sentences(stream(twice), vocab, 4))
    monkeypatch.setattr(text, "SENT_ROWS", 3)
    assert rows_of(text.encoded_lines(lines, vocab, 4, with_words=True)) == rows_of(found)


def test_draws_are_counted_without_shuffling_them(spark, tmp_path):
    """The plan of negative_draws deals out texts by document, and after that only counts."""
    from wordloom.plans import catalogue

    rows = [(d, " ".join(f"w{(d * k * k) % 9}" for k in range(60))) for d in [*range(20), 3]]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    found = catalogue.QUERIES["negative_draws"](spark, str(tmp_path))
    plan = found._jdf.queryExecution().executedPlan().toString()
    shuffled = [line for line in plan.splitlines() if "Exchange hashpartitioning" in line]
    assert not [line for line in shuffled if "cell" in line or "drawn" in line and "doc_id" in line] and "SortMergeJoin" not in plan
    assert {r.docs for r in found.collect()} and found.agg(F.sum("n")).head()[0] <= 5 * 60 * 21


def test_pairs_are_joined_where_lines_are_as_by_joins(spark):
    """Both ways of join_phrases; in the tasks, rows that share their numbers are lines of their own."""
    rows = [(0, 0, ["a", "b", "a", "b", "b"]), (0, 1, []), (1, 0, ["b", "a"]), (1, 1, ["é", "a", "b", "c"]), (2, 0, ["c"]), (2, 1, ["b", "b", "b", "b", "b"]), (3, 0, ["a"]), (3, 1, ["b", "c", "x"])]
    lines = spark.createDataFrame(rows, "doc_id long, sent_id int, words array<string>").repartition(2)
    chosen = spark.createDataFrame([("a", "b"), ("b", "a"), ("b", "b"), ("b", "c"), ("a", "b")], "a string, b string")
    own = lambda df: {(r.doc_id, r.sent_id): r.words for r in df.collect()}
    here = phrases.join_phrases(lines, chosen)
    assert own(here) == own(phrases.join_phrases(lines, chosen, most=0))
    assert own(here)[0, 0] == ["a_b", "a_b", "b"] and own(here)[2, 1] == ["b_b", "b_b", "b"] and own(here)[1, 1] == ["é", "a_b", "c"]
    assert own(phrases.join_phrases(lines, chosen.filter("a = 'none'"))) == {(d, s): w for d, s, w in rows if w}
    assert "Join" not in here._jdf.queryExecution().executedPlan().toString()
    assert phrases.join_phrases(lines.union(lines), chosen).count() == 14


def test_words_and_pairs_are_counted_in_one_reading(spark, tmp_path):
    """The lines are cut into words once: words' counts are sums of their pairs'."""
    spark.createDataFrame([(i, "x y z\nz x y") for i in range(9)], "doc_id long, text string").write.parquet(str(tmp_path / "docs"))
    read = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            read.add(batch.num_rows)
            yield batch

    lines = text.token_lines(spark.read.parquet(str(tmp_path / "docs"))).mapInArrow(counted, "doc_id long, sent_id int, words array<string>")
    got = {(r.a, r.b): (r.pab, r.pa, r.pb, r.score) for r in phrases.scores(lines).collect()}
    assert got == {("x", "y"): (18, 18, 18, 13 / 18 / 18 * 54), ("y", "z"): (9, 18, 18, 4 / 18 / 18 * 54), ("z", "x"): (9, 18, 18, 4 / 18 / 18 * 54)}
    assert read.value == 18


def test_tasks_grow_in_number_with_the_table(spark, tmp_path):
    """Few large files are dealt out to as many tasks as they have splits, so that a task's share has a bound."""
    from wordloom.plans import inputs

    spark.range(20_000).selectExpr("id AS doc_id", "uuid() AS text").coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    assert inputs.documents(spark, str(tmp_path)).rdd.getNumPartitions() == spark.sparkContext.defaultParallelism
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20k")
    spark.conf.set("spark.sql.files.openCostInBytes", "1k")
    try:
        docs = inputs.documents(spark, str(tmp_path))
        assert docs.rdd.getNumPartitions() > 2 * spark.sparkContext.defaultParallelism and docs.count() == 20_000
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")


def test_tokens_cut_each_line_once(spark):
    docs = spark.createDataFrame([(1, "A\rb c\n\nd"), (2, None), (3, "")], "doc_id long, text string")
    for stream, cut, words in ((text.tokens(docs, lower=True), "regexp_extract_all(", ["ab", "c", "d"]), (text.scan_tokens(docs), "[ \t]+", ["Ab", "c", "d"])):
        plan = text.vocabulary(stream)._jdf.queryExecution().executedPlan().toString()
        assert plan.count(cut) == 1
        assert [r.word for r in stream.orderBy("doc_id", "sent_id", "pos").collect()] == words


def test_pairs_of_a_large_vocabulary_are_counted_and_named_where_they_are(spark, tmp_path, monkeypatch):
    """Beyond SENT_ROWS words neither tokens nor counts meet the vocabulary in a join; beyond SENT_BYTES they do, with equal rows."""
    from wordloom.operators import lineage
    from wordloom.plans import catalogue

    rows = [(d, "\n".join(" ".join(f"w{(d * k * k + s) % 29}" for k in range(40)) for s in range(3))) for d in range(12)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    want = sorted(map(tuple, catalogue.QUERIES["context_pairs"](spark, str(tmp_path)).collect()))
    monkeypatch.setattr(text, "SENT_ROWS", 3)
    monkeypatch.setattr(lineage.sent, "__defaults__", (3,))
    found = catalogue.QUERIES["context_pairs"](spark, str(tmp_path))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and sorted(map(tuple, found.collect())) == want and len(want) > 200
    monkeypatch.setattr(text, "SENT_BYTES", 50)
    found = catalogue.QUERIES["context_pairs"](spark, str(tmp_path))
    assert "Join" in found._jdf.queryExecution().executedPlan().toString() and sorted(map(tuple, found.collect())) == want


def test_words_are_found_from_either_side():
    import pyarrow as pa

    flat = pa.array(["b", "x", "a", None, "b", "é"])
    for words in (pa.array(["é", "a", "b", *(f"w{i}" for i in range(20))]), pa.array(["é", "a", "b"]), pa.array([], pa.string())):
        place = {w: i for i, w in enumerate(words.to_pylist())}
        assert text._found(flat, words).tolist() == [place.get(w, -1) for w in flat.to_pylist()]


def test_draws_of_a_large_vocabulary_are_counted_where_the_texts_are(spark, monkeypatch):
    """Beyond SENT_ROWS words nothing but texts and counts is shuffled; beyond SENT_BYTES joins give equal rows."""
    from wordloom.operators import lineage

    rows = [(d, "\n".join(" ".join(f"W{((d or 0) * k * k + s) % 9}" for k in range(20 * s)) for s in range(3))) for d in [*range(20), 3, None]] + [(50, None), (51, "rare")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    vocab = text.ranked(text.vocabulary(text.tokens(docs, lower=True), 5))
    own = lambda: sorted(map(tuple, text.drawn_counts(docs, vocab, 3).collect()))
    with monkeypatch.context() as m:
        m.setattr(text, "SENT_BYTES", 0)
        want = own()
    monkeypatch.setattr(text, "SENT_ROWS", 3)
    monkeypatch.setattr(text, "ENCODED", 50)
    monkeypatch.setattr(lineage.sent, "__defaults__", (3,))
    assert own() == want and len(want) > 5
    assert "Join" not in text.drawn_counts(docs, vocab, 3)._jdf.queryExecution().executedPlan().toString()
