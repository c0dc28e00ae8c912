"""Audit of how filters interact: what each removes in every order in which they may run.

1.  Native expressions give each document a mask, with a bit for each filter that it
    fails.  Four filters judge a text by itself.  The fifth fails a document whose text a
    smaller doc_id has: texts are grouped by their SHA-256, and a group's smallest doc_id
    passes.  Only ids and digests are moved, and minima are taken in each task first.
2.  Documents are counted by part and mask: 32 cells for each part.
3.  What a filter removes after others depends on the masks only, so all orders of the
    filters and all their steps are worked out from the cells.
"""

from __future__ import annotations

import itertools
import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .components import forget, quoted, stored

#: The filters, in the order of their bits.
FILTERS = "ABCDE"
#: A: fewer words.  B: fewer different words, in hundredths of all.  C: more capitals A-Z, in hundredths of the code points.  D: any of these signs.
LEAST_WORDS, LEAST_DIFFERENT, MOST_CAPITALS, SIGNS = 50, 65, 5, "[#$%&*|]"

_BLANKS = "\t\n\x0b\f\r"


def words(text: Column) -> Column:
    """The words of a text, between ASCII blanks."""
    spaced = F.replace(text, F.lit("\n"), F.lit(" "))
    even = spaced
    for sign in _BLANKS.replace("\n", ""):
        even = F.replace(even, F.lit(sign), F.lit(" "))
    return F.array_remove(F.split(F.when(spaced.rlike(f"[{_BLANKS}]"), even).otherwise(spaced), " "), "")


def _bit(failed: Column, name: str) -> Column:
    return F.when(failed, F.lit(1 << FILTERS.index(name))).otherwise(F.lit(0))


def judged(docs: DataFrame, part: str = "source") -> DataFrame:
    """(doc_id, part, mask, digest) of each row: its failures of the filters that see one text.  Null text: empty; null part: the empty string."""
    texts = docs.select("doc_id", F.coalesce(quoted(part).cast("string"), F.lit("")).alias("part"), F.coalesce("text", F.lit("")).alias("text"))
    # The words are kept as a column, so that the text is split once.
    counted = texts.withColumn("words", words(F.col("text"))).select("*", F.size("words").alias("n"), F.size(F.array_distinct("words")).alias("different"))
    capitals, points = F.regexp_count("text", F.lit("[A-Z]")), F.length("text")
    mask = (
        _bit(F.col("n") < LEAST_WORDS, "A")
        + _bit(100 * F.col("different").cast("long") < LEAST_DIFFERENT * F.col("n").cast("long"), "B")
        + _bit(100 * capitals.cast("long") > MOST_CAPITALS * points.cast("long"), "C")
        + _bit(F.col("text").rlike(SIGNS), "D")
    )
    return counted.select("doc_id", "part", mask.alias("mask"), F.unhex(F.sha2("text", 256)).alias("digest"))


def masks(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, mask, good, toxic) of rows, a stored table of judged, with the filter that sees all texts.

    labels: (doc_id, quality, toxic); one row that says so is enough.  Rows without an id
    have no label, are no one's smaller doc_id and have no smaller one.  Rows that share an
    id and the text are first together.
    """
    named = rows.filter("doc_id IS NOT NULL")
    # A text that very many documents have is a row for each task here, and then one first document.
    firsts = named.groupBy("digest").agg(F.min("doc_id").alias("doc_id")).withColumn("first", F.lit(True))
    marks = labels.filter("doc_id IS NOT NULL").groupBy("doc_id").agg(*(F.coalesce(F.max((F.col(c) == 1).cast("long")), F.lit(0).cast("long")).alias(n) for c, n in (("quality", "good"), ("toxic", "bad"))))
    met = named.join(firsts, ["digest", "doc_id"], "left").join(marks, "doc_id", "left")
    copied = _bit(F.col("first").isNull(), "E")
    zero = F.lit(0).cast("long")
    known = met.select("part", (F.col("mask") + copied).alias("mask"), F.coalesce("good", zero).alias("good"), F.coalesce("bad", zero).alias("toxic"))
    return known.unionByName(rows.filter("doc_id IS NULL").select("part", "mask", zero.alias("good"), zero.alias("toxic")))


def cells(masked: DataFrame) -> DataFrame:
    """(part, mask, n, good, toxic): the documents of each mask of each part."""
    return masked.groupBy("part", "mask").agg(F.count("*").alias("n"), F.sum("good").alias("good"), F.sum("toxic").alias("toxic"))


def orders(cells: DataFrame) -> DataFrame:
    """part, filter_order, step and what the step's filter does there, of every order and step of every part.

    kept: documents after the step; removed: here; redundant: failing its filter, removed
    earlier; unique_fails: failing its filter only; good_lost, toxic_lost: of those
    removed here; shapley: its filter's removed, summed over all orders.  A part has 120
    times 5 rows; no documents, no rows.
    """
    size = 1 << len(FILTERS)
    whole = cells.groupBy("part").agg(*(F.map_from_entries(F.collect_list(F.struct("mask", c))).alias(c) for c in ("n", "good", "toxic")))
    array = lambda c: F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda m: F.coalesce(F.try_element_at(c, m), F.lit(0).cast("long")))
    whole = whole.select("part", *(array(F.col(c)).alias(c) for c in ("n", "good", "toxic")))
    every = F.array(*(F.lit("".join(p)) for p in itertools.permutations(FILTERS)))
    steps = whole.select("*", F.explode(every).alias("filter_order")).select("*", F.explode(F.sequence(F.lit(1), F.lit(len(FILTERS)))).alias("step"))
    place = {x: F.instr("filter_order", x) for x in FILTERS}
    own = sum((F.when(at == F.col("step"), 1 << FILTERS.index(x)).otherwise(0) for x, at in place.items()), F.lit(0))
    before = sum((F.when(at < F.col("step"), 1 << FILTERS.index(x)).otherwise(0) for x, at in place.items()), F.lit(0))
    steps = steps.withColumns({"own": own, "before": before})
    total = lambda of, wanted: F.aggregate(F.transform(of, lambda x, m: F.when(wanted(m), x).otherwise(0)), F.lit(0).cast("long"), lambda a, x: a + x)
    fails, early = lambda m: m.bitwiseAND(F.col("own")) != 0, lambda m: m.bitwiseAND(F.col("before")) != 0
    here = lambda m: fails(m) & ~early(m)
    # Of the orders, a filter comes before the others that a document fails in one of as many as it fails.
    share = F.transform("n", lambda x, m: (x * F.lit(math.factorial(len(FILTERS))) / F.greatest(F.bit_count(m), F.lit(1))).cast("long"))
    return steps.select(
        "part", "filter_order", F.col("step").cast("int").alias("step"),
        total("n", lambda m: ~fails(m) & ~early(m)).alias("kept"), total("n", here).alias("removed"),
        total("n", lambda m: fails(m) & early(m)).alias("redundant"), F.get("n", F.col("own")).alias("unique_fails"),
        total("good", here).alias("good_lost"), total("toxic", here).alias("toxic_lost"), total(share, fails).alias("shapley"),
    )


def audit(docs: DataFrame, labels: DataFrame, part: str = "source") -> DataFrame:
    """orders of docs (doc_id, text and the part's column).

    Null texts are empty and fail A; null parts are the empty string's.  Each row counts,
    repeated ones too; those that share an id share its label.  Other columns are left out.
    """
    rows = stored(judged(docs, part), "filter-masks")
    found = stored(cells(masks(rows, labels)), "filter-cells")
    forget(rows)
    return orders(found)


def op11_filter_audit(spark, sf_dir: str) -> DataFrame:
    """audit of documents by source, with labels; nulls and repeats: as audit has them.  An empty table gives no rows."""
    return audit(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))


_SIGNED = SIGNS.replace("'", "''")
OP11_SQL = rf"""
WITH d AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
l AS (SELECT doc_id, max((quality IS NOT DISTINCT FROM 1)::INT) AS good, max((toxic IS NOT DISTINCT FROM 1)::INT) AS toxic FROM labels GROUP BY doc_id),
firsts AS (SELECT text, min(doc_id) AS least FROM d GROUP BY text),
f AS (SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic,
  (len(ws) < {LEAST_WORDS})::INT + 2 * (100 * len(list_distinct(ws)) < {LEAST_DIFFERENT} * len(ws))::INT + 4 * (100 * len(regexp_replace(text, '[^A-Z]', '', 'g')) > {MOST_CAPITALS} * len(text))::INT
  + 8 * regexp_matches(text, '{_SIGNED}')::INT + 16 * coalesce(doc_id > least, false)::INT AS mask FROM d LEFT JOIN l USING (doc_id) LEFT JOIN firsts USING (text)),
c AS (SELECT part, mask, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM f GROUP BY part, mask),
x AS (SELECT * FROM (VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)) AS v(name, bit)),
o AS (SELECT a.name || b.name || c.name || d.name || e.name AS filter_order, [a.bit, b.bit, c.bit, d.bit, e.bit] AS bits
  FROM x AS a, x AS b, x AS c, x AS d, x AS e WHERE a.bit + b.bit + c.bit + d.bit + e.bit = 31 AND a.bit | b.bit | c.bit | d.bit | e.bit = 31),
s AS (SELECT filter_order, k::INT AS step, bits[k] AS own, coalesce(list_sum(bits[1 : k - 1]), 0)::INT AS before FROM o, range(1, 6) AS r(k)),
t AS (SELECT part, filter_order, step, own, coalesce(sum(n) FILTER (mask & (own | before) = 0), 0)::BIGINT AS kept, coalesce(sum(n) FILTER (mask & own <> 0 AND mask & before = 0), 0)::BIGINT AS removed,
  coalesce(sum(n) FILTER (mask & own <> 0 AND mask & before <> 0), 0)::BIGINT AS redundant, coalesce(sum(n) FILTER (mask = own), 0)::BIGINT AS unique_fails,
  coalesce(sum(good) FILTER (mask & own <> 0 AND mask & before = 0), 0)::BIGINT AS good_lost, coalesce(sum(toxic) FILTER (mask & own <> 0 AND mask & before = 0), 0)::BIGINT AS toxic_lost
  FROM c, s GROUP BY part, filter_order, step, own)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, sum(removed) OVER (PARTITION BY part, own)::BIGINT AS shapley FROM t
"""
