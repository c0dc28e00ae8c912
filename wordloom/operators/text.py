"""Corpora, token streams, vocabularies and sentences.

docs is a table (doc_id, text).  A line of a text is a sentence; a token stream is
(doc_id, sent_id, pos, word) with both numbers from 0.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.expressions import hash_number, words_of
from .lineage import SENT_ROWS, sent, settled
from .ranks import number_rows

MIN_COUNT = 5
SENTENCE_WORDS = 1000
#: Rows of cut shares of the noise distribution that go to all tasks.
CUT_ROWS = 3 * SENT_ROWS
#: Words of lines that a task encodes at once.
ENCODED = 1 << 20
#: Bytes of a vocabulary's words that go to all tasks, which hold them once, as an array.
SENT_BYTES = 1 << 28


def lines(docs: DataFrame) -> DataFrame:
    """(doc_id, sent_id, line); carriage returns are no part of a line."""
    return docs.select("doc_id", F.posexplode(F.split(F.replace("text", F.lit("\r"), F.lit("")), "\n")).alias("sent_id", "line"))


def token_lines(docs: DataFrame, lower: bool = False) -> DataFrame:
    """(doc_id, sent_id, words): the words of each line as an array."""
    return lines(docs).select("doc_id", "sent_id", words_of(F.col("line"), lower).alias("words"))


def tokens(docs: DataFrame, lower: bool = False) -> DataFrame:
    """Token stream by the word pattern.

    The words are exploded where they are cut: of a named column of words, Spark would
    first ask whether it is empty, which cuts each line twice.
    """
    return lines(docs).select("doc_id", "sent_id", F.posexplode(words_of(F.col("line"), lower)).alias("pos", "word"))


def _scanned(max_token_len: int | None) -> Column:
    cut = F.filter(F.split("line", "[ \t]+"), lambda w: w != "")
    return F.transform(cut, lambda w: F.substring(w, 1, max_token_len)) if max_token_len else cut


def scan_lines(docs: DataFrame, max_token_len: int | None = None) -> DataFrame:
    """(doc_id, sent_id, words) by white space, as a trainer scans a prepared corpus; the last token counts."""
    return lines(docs).select("doc_id", "sent_id", _scanned(max_token_len).alias("words"))


def scan_tokens(docs: DataFrame, max_token_len: int | None = None) -> DataFrame:
    return lines(docs).select("doc_id", "sent_id", F.posexplode(_scanned(max_token_len)).alias("pos", "word"))


def corpus_lines(docs: DataFrame, lower: bool = False) -> DataFrame:
    """(doc_id, line): a document's words joined by one space, as a prepared corpus has them; null and empty texts have an empty line."""
    return docs.select("doc_id", F.array_join(words_of(F.coalesce("text", F.lit("")), lower), " ").alias("line"))


def vocabulary(stream: DataFrame, min_count: int = 1) -> DataFrame:
    """(word, cn) of the words with at least min_count tokens; counts are exact."""
    counts = stream.groupBy("word").agg(F.count("*").alias("cn"))
    return counts.filter(F.col("cn") >= min_count) if min_count > 1 else counts


def ranked(vocab: DataFrame) -> DataFrame:
    """vocab with word_id from 0, by falling count and then by word; it is counted once, as a sort reads its input twice."""
    return number_rows(settled(vocab), "word_id", F.desc("cn"), F.asc("word"))


def word_total(vocab: DataFrame) -> DataFrame:
    """One row: the number of kept tokens and of words."""
    return vocab.agg(F.coalesce(F.sum("cn"), F.lit(0)).alias("total"), F.count("*").alias("words"))


def lookup(stream: DataFrame, vocab: DataFrame) -> DataFrame:
    """The stream with word_id, -1 for words that are not in the vocabulary."""
    return stream.join(sent(vocab.select("word", "word_id")), "word", "left").withColumn("word_id", F.coalesce("word_id", F.lit(-1).cast("long")))


def encoded_sentences(stream: DataFrame, vocab: DataFrame, most: int = SENTENCE_WORDS) -> DataFrame:
    """(doc_id, sent_id, chunk, words, ids): known words only, sentences cut after ``most`` of them."""
    known = stream.join(sent(vocab.select("word", "word_id")), "word")
    whole = known.groupBy("doc_id", "sent_id").agg(F.sort_array(F.collect_list(F.struct("pos", "word", "word_id"))).alias("t"))
    cuts = F.transform(F.sequence(F.lit(0), F.floor((F.size("t") - 1) / F.lit(most)).cast("int")), lambda i: F.struct(i.alias("chunk"), F.slice("t", i * most + 1, F.lit(most)).alias("t")))
    return whole.select("doc_id", "sent_id", F.explode(cuts).alias("c")).select("doc_id", "sent_id", "c.chunk", F.col("c.t.word").alias("words"), F.col("c.t.word_id").alias("ids"))


def sent_words(vocab: DataFrame):
    """The words of a vocabulary by word_id, as an array that is sent to the tasks; None if they have more than SENT_BYTES.  vocab: as ranked has it."""
    size = vocab.agg(F.sum(F.octet_length("word") + F.lit(12)).alias("bytes")).head().bytes or 0
    if size > SENT_BYTES:
        return None
    words = vocab.select("word", "word_id").toArrow().sort_by("word_id")["word"].combine_chunks()
    words = words.chunk(0) if isinstance(words, pa.ChunkedArray) and words.num_chunks else words
    return vocab.sparkSession.sparkContext.broadcast(words.cast(pa.string()) if isinstance(words, pa.Array) else pa.array([], pa.string()))


def _found(flat: pa.Array, words: pa.Array) -> np.ndarray:
    """The place of each word of flat in words, -1 for others; the smaller of the two sets of words becomes the table that is searched."""
    own = flat.dictionary_encode()
    if len(own.dictionary) >= len(words):
        return pc.index_in(flat, value_set=words.cast(flat.type)).fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
    at = pc.index_in(words.cast(flat.type), value_set=own.dictionary)
    ids = np.full(len(own.dictionary) + 1, -1)
    ids[at.drop_null().to_numpy(zero_copy_only=False)] = np.flatnonzero(at.is_valid().to_numpy(zero_copy_only=False))
    return ids[own.indices.fill_null(len(own.dictionary)).to_numpy(zero_copy_only=False)]


def _encode(sent, most: int, with_words: bool):
    """Lines (doc_id, sent_id, words) as sentences of known words, some lines at a time."""

    def encoded(held: list[pa.RecordBatch]):
        table = pa.Table.from_batches(held).combine_chunks()
        lists = table["words"].chunk(0)
        size = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
        flat = lists.flatten()
        found = _found(flat, sent.value)
        known = found >= 0
        upto = np.concatenate([[0], np.cumsum(known)])[np.concatenate([[0], np.cumsum(size)])]
        n = np.diff(upto)
        chunks = -(-n // most)
        row = np.repeat(np.arange(len(n)), chunks)
        chunk = np.arange(len(row)) - np.repeat(np.cumsum(chunks) - chunks, chunks)
        starts = pa.array(np.append(upto[row] + chunk * most, upto[-1]), pa.int32())
        kept = pa.array(row)
        columns = {"doc_id": table["doc_id"].chunk(0).take(kept), "sent_id": table["sent_id"].chunk(0).take(kept), "chunk": pa.array(chunk, pa.int32())}
        if with_words:
            columns["words"] = pa.ListArray.from_arrays(starts, flat.filter(pa.array(known)))
        columns["ids"] = pa.ListArray.from_arrays(starts, pa.array(found[known]))
        yield from pa.table(columns).to_batches(max_chunksize=10_000)

    def run(batches):
        held, waiting = [], 0
        for batch in batches:
            if batch.num_rows:
                held.append(batch)
                waiting += len(batch["words"].flatten())
            if waiting >= ENCODED:
                yield from encoded(held)
                held, waiting = [], 0
        if held:
            yield from encoded(held)

    return run


def encoded_lines(token_lines: DataFrame, vocab: DataFrame, most: int = SENTENCE_WORDS, with_words: bool = False, words=None) -> DataFrame:
    """encoded_sentences of lines (doc_id, sent_id, words), without ``words`` unless asked for.

    A vocabulary of up to SENT_BYTES goes to the tasks, which encode each line where it
    is: no token is shuffled.  A larger one meets the tokens in a join; so do lines that
    share their numbers, as they are one sentence.  vocab: as ranked has it; words: its
    sent_words, if they are at hand.
    """
    stream = token_lines.select("doc_id", "sent_id", F.posexplode("words").alias("pos", "word"))
    words = words or sent_words(vocab)
    if words is None or token_lines.groupBy("doc_id", "sent_id").count().filter("count > 1").limit(1).count():
        found = encoded_sentences(stream, vocab, most)
        return found if with_words else found.drop("words")
    kinds = token_lines.schema
    schema = f"doc_id {kinds['doc_id'].dataType.simpleString()}, sent_id {kinds['sent_id'].dataType.simpleString()}, chunk int, " + ("words array<string>, " if with_words else "") + "ids array<bigint>"
    return token_lines.select("doc_id", "sent_id", "words").mapInArrow(_encode(words, most, with_words), schema)


def noise(vocab: DataFrame, power: float = 0.75) -> DataFrame:
    """(word, word_id, p): probability of a word as a negative sample."""
    total = vocab.agg(F.sum(F.pow("cn", F.lit(power))).alias("z"))
    return vocab.crossJoin(F.broadcast(total)).select("word", "word_id", (F.pow("cn", F.lit(power)) / F.col("z")).alias("p"))


#: Word ids of a range of the running shares.
_RANGE = 4096


def noise_cdf(vocab: DataFrame, power: float = 0.75) -> DataFrame:
    """(word, word_id, low, high): the share of (0, 1) in which a number draws the word; shares follow word_id.

    Sums are made in ranges of ids and over the ranges, of which there is one row for
    each _RANGE words, so that no task sees the vocabulary.
    """
    p = noise(vocab, power).withColumn("range", F.floor(F.col("word_id") / _RANGE))
    before = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    sums = p.groupBy("range").agg(F.sum("p").alias("s")).select("range", F.coalesce(F.sum("s").over(before), F.lit(0.0)).alias("base"))
    upto = Window.partitionBy("range").orderBy("word_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    high = F.col("base") + F.sum("p").over(upto)
    return p.join(sent(sums), "range").select("word", "word_id", high.alias("high"), (high - F.col("p")).alias("low"))


def negative_draws(targets: DataFrame, vocab: DataFrame, negative: int = 5, seed: int = 1, power: float = 0.75) -> DataFrame:
    """targets (doc_id, sent_id, pos, word_id and others) with k and drawn: negative random words for each; a draw of the target itself is none.

    The random numbers follow from the seed and the place.  A word's share is cut at the
    cells of a grid with about two cells for each word, and the draws of a cell meet the
    few shares in it: a join on cells, which the draws fill evenly.  The cut shares, about
    three for each word, go to the tasks if they are at most CUT_ROWS.  Last shares end at 1.
    """
    shares = settled(noise_cdf(vocab, power))
    n = shares.count()
    grid = max(1, 2 * n)
    cell = lambda x: F.least(F.floor(x * grid), F.lit(grid - 1))
    high = F.when(F.col("word_id") == n - 1, F.lit(2.0)).otherwise(F.col("high"))
    cut = shares.select(F.col("word_id").alias("drawn"), "low", high.alias("high"), F.explode(F.sequence(cell(F.greatest("low", F.lit(0.0))), cell(F.least("high", F.lit(1.0))))).alias("cell"))
    each = targets.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(negative - 1))))
    u = (hash_number(F.lit(seed), F.lit("negative"), F.col("doc_id"), F.col("sent_id"), F.col("pos"), F.col("k")) + 0.5) / F.lit(4294967296.0)
    each = each.withColumn("u", u).withColumn("cell", cell(F.col("u")))
    met = each.join(sent(cut, CUT_ROWS), "cell").filter((F.col("low") <= F.col("u")) & (F.col("u") < F.col("high")) & (F.col("drawn") != F.col("word_id")))
    return met.drop("cell", "u", "low", "high")


def _drawn(sent, shares, negative: int):
    """Lines (doc_id, words, draws), those of a document next to each other, as counts of the words drawn: (drawn, n, places, docs)."""

    def run(batches):
        low = shares.value
        n, places, docs = np.zeros(len(low), np.int64), np.zeros(len(low)), np.zeros(len(low), np.int64)

        def counted(table: pa.Table) -> None:
            table = table.combine_chunks()
            ids, lists = table["doc_id"].chunk(0), table["words"].chunk(0)
            size = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
            word = _found(lists.flatten(), sent.value)
            u = (table["draws"].chunk(0).flatten().to_numpy(zero_copy_only=False) + 0.5) / 4294967296.0
            drawn = np.maximum(np.searchsorted(low, u, "right") - 1, 0).reshape(-1, negative)
            live = (word[:, None] >= 0) & (drawn != word[:, None])
            pos = np.arange(len(word)) - np.repeat(np.cumsum(size) - size, size)
            some = drawn[live]
            n[:] += np.bincount(some, minlength=len(low))
            places[:] += np.bincount(some, np.broadcast_to(pos[:, None], live.shape)[live], len(low))
            # A null id is no document.
            own = ids.dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
            of = np.broadcast_to(np.repeat(own, size)[:, None], live.shape)[live]
            docs[:] += np.bincount(np.unique((of * len(low) + some)[of >= 0]) % len(low), minlength=len(low))

        held, waiting = [], 0
        for batch in batches:
            if batch.num_rows:
                held.append(batch)
                waiting += len(batch["words"].flatten())
            if waiting >= ENCODED:
                # The last document may go on in the next batch.
                table = pa.Table.from_batches(held).combine_chunks()
                ids = table["doc_id"].chunk(0)
                codes = ids.dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False)
                first = int(np.flatnonzero(np.append(True, codes[1:] != codes[:-1]))[-1])
                if first:
                    counted(table.slice(0, first))
                held = table.slice(first).to_batches()
                waiting = sum(len(b["words"].flatten()) for b in held)
        if held:
            counted(pa.Table.from_batches(held))
        for at in range(0, len(low), 1 << 16):
            some = at + np.flatnonzero(n[at : at + (1 << 16)])
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (some, n[some], places[some].astype(np.int64), docs[some])], names=["drawn", "n", "places", "docs"])

    return run


def drawn_counts(docs: DataFrame, vocab: DataFrame, parts: int, negative: int = 5, seed: int = 1, power: float = 0.75) -> DataFrame:
    """(drawn, n, places, docs): how often negative_draws of the documents' known tokens (lower case) give a word, the sum of their places, and beside how many documents.

    Texts are dealt out by doc_id; each task draws for the lines that it has and keeps
    three numbers for each word, so that only counts are shuffled.  The words and shares of a
    vocabulary of up to SENT_BYTES go to the tasks; with a larger one tokens and draws
    meet them in joins.  vocab: as ranked has it.
    """
    dealt = docs.repartition(parts, "doc_id")
    words = sent_words(vocab)
    if words is None:
        targets = lookup(tokens(dealt, lower=True), vocab).filter("word_id >= 0").select("doc_id", "sent_id", "pos", "word_id")
        of_documents = negative_draws(targets, vocab, negative, seed, power).groupBy("doc_id", "drawn").agg(F.count("*").alias("n"), F.sum("pos").alias("places"))
        return of_documents.groupBy("drawn").agg(F.sum("n").alias("n"), F.sum("places").alias("places"), F.count("doc_id").alias("docs"))
    shares = noise_cdf(vocab, power).select("word_id", "low").toArrow().sort_by("word_id")["low"].to_numpy()
    sent_shares = vocab.sparkSession.sparkContext.broadcast(np.maximum.accumulate(shares) if len(shares) else shares)
    lined = token_lines(dealt.sortWithinPartitions("doc_id"), lower=True)
    number = lambda pos, k: hash_number(F.lit(seed), F.lit("negative"), F.col("doc_id"), F.col("sent_id"), pos, F.lit(k))
    at = F.transform("words", lambda _, pos: F.array(*(number(pos, k) for k in range(negative))))
    counted = lined.select("doc_id", "words", F.flatten(at).alias("draws")).mapInArrow(_drawn(words, sent_shares, negative), "drawn long, n long, places long, docs long")
    return counted.groupBy("drawn").agg(F.sum("n").alias("n"), F.sum("places").alias("places"), F.sum("docs").alias("docs"))


def keep_probability(vocab: DataFrame, sample: float) -> DataFrame:
    """(word, keep): the chance that a token of a frequent word is kept, at most 1."""
    total = vocab.agg(F.sum("cn").alias("t"))
    limit = F.lit(sample) * F.col("t")
    return vocab.crossJoin(F.broadcast(total)).select("word", F.least(F.lit(1.0), (F.sqrt(F.col("cn") / limit) + 1) * limit / F.col("cn")).alias("keep"))


def thinned(stream: DataFrame, vocab: DataFrame, sample: float, seed: int = 1) -> DataFrame:
    """The stream's known tokens without those that the keep test drops; its random numbers follow from the seed and the place.

    The places of the tokens that stay have gaps; encoded_sentences closes them.
    """
    chance = sent(keep_probability(vocab, sample))
    drawn = (hash_number(F.lit(seed), F.lit("keep"), F.col("doc_id"), F.col("sent_id"), F.col("pos")) + 0.5) / F.lit(4294967296.0)
    return stream.join(chance, "word").filter(drawn < F.col("keep")).drop("keep")


def sigmoid_table(spark, size: int = 1000, bound: float = 6.0) -> DataFrame:
    """(i, x, value): the logistic function at the lower ends of ``size`` bins of (-bound, bound)."""
    x = (F.col("id") / F.lit(float(size)) * 2 - 1) * F.lit(bound)
    return spark.range(size).select(F.col("id").alias("i"), x.alias("x"), (F.exp(x) / (F.exp(x) + 1)).alias("value"))


def alpha_schedule(total: DataFrame, iterations: int = 5, alpha: float = 0.025, steps: int = 100) -> DataFrame:
    """(step, alpha): the learning rate when step / steps of all tokens of all rounds are done."""
    part = F.explode(F.sequence(F.lit(0), F.lit(steps))).alias("step")
    done = F.col("step") / F.lit(float(steps)) * F.lit(iterations) * F.col("total")
    rate = F.lit(alpha) * (1 - done / (F.lit(iterations) * F.col("total") + 1))
    return total.select("total", part).select("step", F.greatest(rate, F.lit(alpha * 1e-4)).alias("alpha"))
