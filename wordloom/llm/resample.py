"""Importance resampling of documents towards a target corpus, over hashed n-grams.

A text's features are its runs of 1 to ``most`` words.  Each falls into a bucket by the
CRC-32 of its bytes; a bucket's gain is how much likelier the target corpus has it than
the documents, and a document's weight is the mean gain of its features.  The documents
with the greatest weights plus a random number each (Gumbel's) are a draw without
replacement in proportion to the exponents of the weights.

1.  Texts are read in runs of whole documents (see runs).  A run keeps its words as
    numbers of its own and names each different word once.
2.  The different words of all runs become the dictionary: a word, its id and its counts
    on both sides.  For longer n-grams the runs get the ids, n-grams are tuples of ids,
    and the different tuples of all runs are a second table of this kind; their bytes are
    put together again by joins with the dictionary.  A single word is its own tuple.
3.  Each different tuple is hashed once.  Counts are added up by bucket, gains go back to
    the tuples, and by a join to the runs that hold them, whose documents add them up.

What is shuffled are the names of the different tuples of each run, and the runs' numbers once.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.ranks import number_rows
from . import runs as run_tables
from . import words
from .components import forget

MOST_WORDS, BUCKETS = 1, 10_000
#: Documents of fewer words are not drawn; of the others, so many in a hundred are.
LEAST_WORDS, PERCENT, SEED = 20, 10, 2024


def _tupled(most: int, buckets: int):
    """A run's n-grams as tuples of word ids, written with commas."""

    def tupled(run: dict, facts: dict[str, np.ndarray]) -> pa.Table:
        ids = facts["term_id"]
        terms = len(ids)
        code, n_words = run_tables.unpacked(run["codes"].as_py(), terms), run["n_words"].values.to_numpy()
        row = np.repeat(np.arange(len(n_words)), n_words)
        left = np.cumsum(n_words)[row] - np.arange(len(code))  # words from here to the end of the text
        # A tuple is known by a number for its beginning and its last word; a single word by the word's.
        rows, features, known = [row], [code], code
        every, number = [[str(x) for x in ids.tolist()]], terms
        for k in range(2, most + 1):
            at = np.flatnonzero(left >= k)
            _, first, place = np.unique(known[at] * terms + code[at + k - 1], return_index=True, return_inverse=True)
            every.append([",".join(map(str, x)) for x in ids[code[at[first][:, None] + np.arange(k)]].tolist()])
            rows.append(row[at])
            features.append(number + place)
            known = np.zeros(len(code), np.int64)
            known[at] = place
            number += len(first)
        row, feature = np.concatenate(rows), np.concatenate(features)
        order = np.argsort(row, kind="stable")
        made = run_tables.row(run["run"].as_py(), run["side"].as_py(), run["doc_ids"].values, run["apart"].values, n_words, np.bincount(row, minlength=len(n_words)), feature[order], [x.encode() for xs in every for x in xs], np.bincount(feature, minlength=number), buckets)
        return pa.Table.from_batches([made])

    return tupled


def _weighed(run: dict, facts: dict[str, np.ndarray]) -> pa.Table:
    """The sums of the gains of a run's documents."""
    gain, n_words, n_features = facts["gain"], run["n_words"].values.to_numpy(), run["n_features"].values.to_numpy()
    total = words.row_sums(gain[run_tables.unpacked(run["codes"].as_py(), len(gain))], np.concatenate([[0], np.cumsum(n_features)]))
    return pa.table({"doc_id": run["doc_ids"].values, "n_words": pa.array(n_words, pa.int64()), "n_features": pa.array(n_features, pa.int64()), "total": pa.array(total, pa.int64())})


def hashed(terms: DataFrame, vocabulary: DataFrame | None, buckets: int) -> DataFrame:
    """terms with the bucket that each is hashed to, from its bytes; tuples of ids get their words from the vocabulary."""
    if vocabulary is None:
        return terms.withColumn("hashed", F.pmod(F.crc32("term"), F.lit(buckets)).cast("int"))
    each = terms.select(F.col("term_id").alias("tuple_id"), F.posexplode(F.split("term", ",").cast("array<long>")).alias("pos", "term_id"))
    joined = each.join(vocabulary.select("term_id", F.col("term").alias("word")), "term_id")
    texts = joined.groupBy("tuple_id").agg(F.array_join(F.sort_array(F.collect_list(F.struct("pos", "word")))["word"], " ").alias("text"))
    return terms.join(texts, terms["term_id"] == texts["tuple_id"]).select(*terms.columns, F.pmod(F.crc32("text"), F.lit(buckets)).cast("int").alias("hashed"))


def gains(tuples: DataFrame, buckets: int) -> DataFrame:
    """(hashed, gain) of the buckets that occur: at most as many rows as there are buckets."""
    counts = tuples.groupBy("hashed").agg(F.sum("s").alias("s"), F.sum("t").alias("t"))
    total = counts.agg(F.sum("s").cast("double").alias("all_s"), F.sum("t").cast("double").alias("all_t"))
    ratio = (F.col("t").cast("double") + 1) * (F.col("all_s") + buckets) / ((F.col("s").cast("double") + 1) * (F.col("all_t") + buckets))
    return counts.crossJoin(F.broadcast(total)).select("hashed", F.floor(1000 * F.log(ratio)).cast("long").alias("gain"))


def _floored(total, n):
    """total / n in whole numbers, downwards; 0 for n = 0."""
    return F.when(n > 0, F.call_function("div", total - F.pmod(total, n), n)).otherwise(F.lit(0).cast("long"))


def weights(docs: DataFrame, target: DataFrame, most: int = MOST_WORDS, buckets: int = BUCKETS) -> DataFrame:
    """(doc_id, n_words, n_features, weight) of each row of docs; both tables have a text, docs an integer doc_id too.

    Null and empty texts have no words: no features, weight 0.  Rows that share an id
    (null is one) are documents of their own.  Other columns are left out.
    """
    whole = F.lit(False).alias("apart")
    sides = docs.select("doc_id", "text", whole), target.select(F.lit(None).cast("long").alias("doc_id"), "text", whole)
    pieces = run_tables.bucket_count(*sides)
    one, other = (run_tables.encoded(df, words.alnum_table(), pieces, k) for k, df in enumerate(sides))
    runs = run_tables.kept(one.unionByName(other), "runs")
    vocabulary = run_tables.dictionary(runs)
    used, terms = [runs, vocabulary], vocabulary
    if most > 1:
        pieces *= most
        runs = run_tables.kept(run_tables.with_facts(runs, vocabulary, ("term_id",), _tupled(most, pieces), run_tables.RUN), "tuple-runs")
        terms = run_tables.dictionary(runs)
        used += [runs, terms]
    tuples = run_tables.kept(hashed(terms, vocabulary if most > 1 else None, buckets).select("bucket", "term", "hashed", "s", "t"), "tuples")
    scored = tuples.join(F.broadcast(gains(tuples, buckets)), "hashed")
    found = run_tables.with_facts(runs, scored, ("gain",), _weighed, "doc_id long, n_words long, n_features long, total long", side=0)
    out = run_tables.kept(found.select("doc_id", "n_words", "n_features", _floored(F.col("total"), F.col("n_features")).alias("weight")), "weights")
    for table in (*used, tuples):
        forget(table)
    return out


def drawn(weighed: DataFrame, seed: int = SEED, least_words: int = LEAST_WORDS, percent: int = PERCENT) -> DataFrame:
    """weighed with score and rank: 1, 2, 3 and so on for the documents that are drawn, else null.

    The random number of a document follows from the seed and its id (null: no sign).
    Ties go to the smaller id, then to the fewer features.
    """
    digest = F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256), 1, 8)
    uniform = (F.conv(digest, 16, 10).cast("double") + 0.5) / F.lit(4294967296.0)
    scored = weighed.withColumn("score", F.col("weight") + F.floor(-1000 * F.log(-F.log(uniform))).cast("long"))
    able = F.col("n_words") >= least_words
    draw = weighed.filter(able).count() * percent // 100
    placed = number_rows(scored.withColumn("able", able), "place", F.desc("able"), F.desc("score"), F.asc("doc_id"), F.asc("n_features"), F.asc("weight"))
    return placed.withColumn("rank", F.when(F.col("able") & (F.col("place") < draw), F.col("place") + 1)).drop("able", "place")


def op12_resample(spark, sf_dir: str) -> DataFrame:
    """drawn of documents towards benchmark; nulls and repeats: as weights and drawn have them.  An empty table gives no rows."""
    table = lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return drawn(weights(table("documents"), table("benchmark"))).select("doc_id", "n_features", "weight", "score", "rank")


_FOLDED = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
OP12_SQL = f"""
WITH table_ AS (SELECT list(v ORDER BY i) AS tab FROM (SELECT i, list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS v FROM range(256) AS r(i))),
d AS (SELECT doc_id, {_FOLDED} AS ws FROM documents), b AS (SELECT {_FOLDED} AS ws FROM benchmark),
dw AS (SELECT doc_id, w, count(*) AS n FROM (SELECT doc_id, unnest(ws) AS w FROM d) GROUP BY doc_id, w),
v AS (SELECT w, sum(s) AS s, sum(t) AS t FROM (SELECT w, n AS s, 0 AS t FROM dw UNION ALL SELECT unnest(ws), 0, 1 FROM b) GROUP BY w),
h AS (SELECT w, s, t, [('0x' || substr(hex(w), 2 * i - 1, 2))::BIGINT FOR i IN range(1, strlen(w) + 1)] AS bytes FROM v),
k AS (SELECT w, s, t, xor(list_reduce(list_prepend(4294967295, bytes), lambda c, x: xor(c >> 8, tab[(xor(c, x) & 255) + 1])), 4294967295) % {BUCKETS} AS bucket FROM h, table_),
c AS (SELECT bucket, sum(s)::DOUBLE AS s, sum(t)::DOUBLE AS t FROM k GROUP BY bucket),
g AS (SELECT bucket, floor(1000 * ln((t + 1) * ((SELECT sum(s) FROM c) + {BUCKETS}) / ((s + 1) * ((SELECT sum(t) FROM c) + {BUCKETS}))))::BIGINT AS gain FROM c),
m AS (SELECT doc_id, floor(sum(n * gain)::DOUBLE / sum(n))::BIGINT AS weight FROM dw JOIN k USING (w) JOIN g USING (bucket) GROUP BY doc_id),
e AS (SELECT doc_id, len(ws)::BIGINT AS n_features, coalesce(weight, 0) AS weight,
  coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('{SEED}:' || doc_id), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296::DOUBLE)))::BIGINT AS score FROM d LEFT JOIN m USING (doc_id)),
r AS (SELECT *, row_number() OVER (PARTITION BY n_features >= {LEAST_WORDS} ORDER BY score DESC, doc_id) AS place FROM e)
SELECT doc_id, n_features, weight, score, CASE WHEN n_features >= {LEAST_WORDS} AND place <= (SELECT count(*) FROM e WHERE n_features >= {LEAST_WORDS}) * {PERCENT} // 100 THEN place END AS rank FROM r
"""
