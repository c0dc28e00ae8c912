"""Benchmark decontamination with a distributed positional inverted index.

1.  The index is a table in the shared folder.  A row of it is a run of documents (see
    runs): its different words, in pieces by bucket, and the posting list of each, the
    places in the run at which it stands.  It does not depend on a benchmark, and can be
    kept for the next one.
2.  The dictionary of all runs says how often each word of the benchmark stands in all
    documents.  A window's words are put in order by that: the rarest first.
3.  The rarest words of the windows meet the index's pieces by bucket.  That gives the
    windows that each run may hold; runs without any are done.
4.  In each other run, a window's lists are intersected: the places of the rarest word,
    moved back by its offset in the window, are candidate starts, and those stay whose
    moved-on places are in the list of the next word, and so on.  Words are compared by
    their bytes throughout.  Proximity matches intersect the same lists within a distance.

Neither the benchmark nor a posting list passes the driver.  A passage that a third of all
documents share is spread over as many runs as the documents are.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import runs as run_tables
from . import words
from .components import as_row, forget, from_row
from .substring import numbered

WINDOW = 10
#: Rows of documents with a hit that go to all tasks.
SENT_ROWS = 500_000


def _windows(window: int):
    """The windows of a run of benchmark texts that all documents have the words of; facts: how often they have them."""

    def windows(run: dict, facts: dict[str, np.ndarray]) -> pa.Table:
        held, names = facts["s"], run_tables.term_names(run["names"].as_py())
        code = run_tables.unpacked(run["codes"].as_py(), len(held))
        ends = np.cumsum(run["n_words"].values.to_numpy())
        rows: dict[str, list] = {"window": [], "anchor": [], "held": [], "item": []}
        for item, a, b in zip(run["doc_ids"].values.to_pylist(), [0, *ends[:-1].tolist()], ends.tolist(), strict=True):
            for i in range(a, max(a + 1, b - window + 1) if b > a else a):
                own = code[i : min(i + window, b)]
                if held[own].min() > 0:
                    rows["window"].append(" ".join(names[k] for k in own))
                    rows["anchor"].append(min((int(held[k]), names[k]) for k in own)[1])
                    rows["held"].append(held[own].tolist())
                    rows["item"].append(item)
        return pa.table(rows, schema=pa.schema([("window", pa.string()), ("anchor", pa.string()), ("held", pa.list_(pa.int64())), ("item", pa.int64())]))

    return windows


def _may_hold(left: pa.Table, right: pa.Table) -> pa.Table:
    """The windows whose anchor a run's piece names."""
    anchors = right["anchor"].combine_chunks()
    runs, rows = [], []
    for run, piece in zip(left["run"].to_pylist(), left["names"].to_pylist(), strict=True):
        at = np.flatnonzero(pc.is_in(anchors, value_set=pa.array(piece.split(" "), pa.string())).to_numpy(zero_copy_only=False))
        runs.append(np.full(len(at), run))
        rows.append(at)
    at = pa.array(np.concatenate(rows) if rows else np.zeros(0, np.int64))
    return pa.table({"of_run": pa.array(np.concatenate(runs) if runs else np.zeros(0, np.int64), pa.int64()), **{c: right[c].take(at) for c in ("no", "window", "held")}})


def _ragged(first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Indices first[i] .. first[i] + size[i] - 1 for all i, one after the other."""
    ends = np.cumsum(size)
    return np.repeat(first - (ends - size), size) + np.arange(int(ends[-1]) if len(ends) else 0)


class Postings:
    """The posting lists of a run: postings[first[t]:first[t+1]] are the places of term t; rows: the document of each place."""

    def __init__(self, steps: bytes, lengths: np.ndarray, n_words: np.ndarray):
        self.postings, self.length = run_tables.places(steps), lengths
        self.first = np.concatenate([[0], np.cumsum(lengths)])
        self.row = np.repeat(np.arange(len(n_words)), n_words)
        # One number for each posting, in order: term, then place.
        self.size = len(self.row) + 1
        self.sorted = np.repeat(np.arange(len(lengths)), lengths) * self.size + self.postings

    def next(self, term: np.ndarray, place: np.ndarray) -> np.ndarray:
        """The first place, as term and place in one number, of each term from a place on."""
        at = np.searchsorted(self.sorted, term * self.size + place)
        return np.append(self.sorted, np.iinfo(np.int64).max)[at]

    def _anchors(self, terms: np.ndarray, order: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(which window, place) of the rarest term of each window."""
        term = terms[np.arange(len(terms)), order[:, 0]]
        size = self.length[term]
        return np.repeat(np.arange(len(terms)), size), self.postings[_ragged(self.first[term], size)]

    def phrases(self, terms: np.ndarray, widths: np.ndarray, order: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(window, first word) of every exact occurrence.  order: each window's offsets, the rarest term's first."""
        own, place = self._anchors(terms, order)
        start = place - order[own, 0]
        fits = (start >= 0) & (start + widths[own] <= len(self.row))
        own, start = own[fits], start[fits]
        for rank in range(1, terms.shape[1]):
            offset = order[own, rank]
            inside = offset < widths[own]
            same = ~inside
            term, at = terms[own[inside], offset[inside]], start[inside] + offset[inside]
            same[inside] = self.next(term, at) == term * self.size + at
            own, start = own[same], start[same]
        same = self.row[start] == self.row[start + widths[own] - 1]  # within one document
        return own[same], start[same]

    def near(self, terms: np.ndarray, widths: np.ndarray, order: np.ndarray, rarest: int, within: int) -> tuple[np.ndarray, np.ndarray]:
        """(window, word) where the window's rarest terms all stand, in any order, at most so many words from the rarest."""
        own, at = self._anchors(terms, order)
        # Where the document of each place begins and ends bounds the distance.
        low = np.maximum(at - within, np.searchsorted(self.row, self.row[at]))
        high = np.minimum(at + within, np.searchsorted(self.row, self.row[at], "right") - 1)
        for rank in range(1, min(rarest, terms.shape[1])):
            offset = order[own, rank]
            inside = offset < widths[own]
            keep = ~inside
            term = terms[own[inside], offset[inside]]
            keep[inside] = self.next(term, low[inside]) <= term * self.size + high[inside]
            own, at, low, high = own[keep], at[keep], low[keep], high[keep]
        return own, at


def _found(window: int, proximity: tuple[int, int] | None):
    """The documents of a run with matches; the right table has the windows that it may hold."""

    def found(left: pa.Table, right: pa.Table) -> pa.Table:
        lengths = np.concatenate([np.frombuffer(x, "<i8") for x in left["counts"][0].as_py()])
        n_words = left["n_words"][0].values.to_numpy()
        index = Postings(left["codes"][0].as_py(), lengths, n_words)
        asked = [w.split(" ") for w in right["window"].to_pylist()]
        widths = np.array([len(w) for w in asked])
        flat = pa.array([x for w in asked for x in w], pa.string())
        number = pc.index_in(flat, value_set=pa.array(run_tables.term_names(left["names"][0].as_py()), pa.string())).fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
        inside = np.arange(window) < widths[:, None]
        terms, held = np.zeros((len(asked), window), np.int64), np.full((len(asked), window), np.iinfo(np.int64).max)
        terms[inside], held[inside] = number, right["held"].combine_chunks().flatten().to_numpy()
        # Only windows of which the run has every term; the rarest in all documents first, wherever the run is.
        whole = ~((terms < 0) & inside).any(1)
        terms, widths, held, no = terms[whole], widths[whole], held[whole], right["no"].to_numpy()[whole]
        order = np.argsort(held, axis=1, kind="stable")
        own, start = index.phrases(terms, widths, order)
        step = np.zeros(len(index.row) + 1, np.int64)
        np.add.at(step, start, 1)
        np.add.at(step, start + widths[own], -1)
        hit = words.row_sums(np.cumsum(step)[:-1] > 0, np.concatenate([[0], np.cumsum(n_words)]))
        near = index.near(terms, widths, order, *proximity) if proximity else (own[:0], start[:0])
        nos = [_by_row(index.row[at], no[which], len(n_words)) for which, at in ((own, start), near)]
        some = np.flatnonzero([bool(a or b) for a, b in zip(*nos, strict=True)])
        return pa.table({"doc": left["doc_ids"][0].values.take(pa.array(some)), "n_hit": pa.array(hit[some], pa.int64()), **{name: pa.array([x[i] for i in some.tolist()], pa.list_(pa.int64())) for name, x in zip(("windows", "near"), nos, strict=True)}})

    return found


def _by_row(row: np.ndarray, no: np.ndarray, rows: int) -> list[list[int]]:
    out: list[list[int]] = [[] for _ in range(rows)]
    if len(row):
        for r, w in np.unique(np.stack([row, no], 1), axis=0).tolist():
            out[r].append(w)
    return out


def build_index(docs: DataFrame) -> DataFrame:
    """The stored posting lists of docs (doc, a number of each row, and text); buckets: how many there are."""
    buckets = run_tables.bucket_count(docs)
    own = docs.select(F.col("doc").alias("doc_id"), "text", F.lit(False).alias("apart"))
    out = run_tables.kept(run_tables.encoded(own, words.alnum_table(), buckets, inverted=True), "postings")
    out.buckets = buckets
    return out


def search(index: DataFrame, items: DataFrame, window: int = WINDOW, proximity: tuple[int, int] | None = None) -> DataFrame:
    """(doc, n_hit, items, near_items) of the documents of an index in which a window of items (item_id, text) occurs, or its rarest terms near each other.

    A null or empty text has no window; a null id is the name "null"; rows with one id are
    one item.  proximity (terms, words): near_items are those of which so many of a
    window's terms, the rarest in all documents, stand within so many words of the rarest,
    in any order; without it there are none.
    """
    named = items.select(F.coalesce(F.col("item_id").cast("string"), F.lit("null")).alias("name"), "text")
    # One number for each name: of its rows, the least hash of name and text.
    asked = run_tables.kept(named.withColumn("doc_id", F.monotonically_increasing_id()), "items")
    runs = run_tables.kept(run_tables.encoded(asked.select("doc_id", "text", F.lit(False).alias("apart")), words.alnum_table(), index.buckets, side=1), "item-runs")
    counted = run_tables.dictionary(index.unionByName(runs))
    found = run_tables.with_facts(runs, counted.filter("t > 0"), ("s",), _windows(window), "window string, anchor string, held array<long>, item long", more=("names",))
    windows = found.groupBy("window").agg(F.first("anchor").alias("anchor"), F.first("held").alias("held"), F.collect_set("item").alias("rows"))
    windows = run_tables.kept(windows.withColumn("no", F.monotonically_increasing_id()), "windows")
    anchors = windows.select(F.pmod(F.crc32("anchor"), F.lit(index.buckets)).cast("int").alias("anchor_bucket"), "anchor", "no", "window", "held")
    may = run_tables.pieces_of(index).groupBy("bucket").cogroup(anchors.groupBy("anchor_bucket")).applyInArrow(_may_hold, "of_run long, no long, window string, held array<long>")
    may = run_tables.kept(may, "candidates")
    some = index.join(may.select(F.col("of_run").alias("run")).distinct(), "run", "left_semi").select("run", "doc_ids", "n_words", "codes", "names", "counts")
    hits = run_tables.kept(some.groupBy("run").cogroup(may.groupBy("of_run")).applyInArrow(_found(window, proximity), "doc long, n_hit long, windows array<long>, near array<long>"), "hits")
    names = windows.select("no", F.explode("rows").alias("doc_id")).join(asked.select("doc_id", "name"), "doc_id").select("no", "name").distinct()
    out = hits.select("doc", "n_hit")
    for column, name in (("windows", "items"), ("near", "near_items")):
        each = hits.select("doc", F.explode(column).alias("no")).join(names, "no").groupBy("doc").agg(F.array_sort(F.collect_set("name")).alias(name))
        out = out.join(each, "doc", "left").withColumn(name, F.coalesce(name, F.array().cast("array<string>")))
    out = run_tables.kept(out, "matches")
    for table in (asked, runs, counted, windows, may, hits):
        forget(table)
    return out


def matches(docs: DataFrame, items: DataFrame, window: int = WINDOW, proximity: tuple[int, int] | None = None) -> DataFrame:
    """row (the other columns of docs, as components.as_row has them), text, n_words, n_hit and items (and near_items) of each document.

    items: as search has them.  A null document text has no words.  Rows of docs are
    judged one by one, so that repeated rows give repeated results, and a long text whole.
    An empty table of documents gives no rows, of items no hits.
    """
    placed = numbered(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", as_row(docs, "text")))
    index = build_index(placed)
    counts = run_tables.kept(index.select(F.explode(F.arrays_zip("doc_ids", "n_words")).alias("x")).select(F.col("x.doc_ids").alias("doc"), F.col("x.n_words").cast("long").alias("n_words")), "word-counts")
    found = search(index, items, window, proximity)
    forget(index)
    none = F.array().cast("array<string>")
    joined = placed.join(counts, "doc").join(found, "doc", "left").withColumns({"n_hit": F.coalesce("n_hit", F.lit(0).cast("long")), "items": F.coalesce("items", none), "near_items": F.coalesce("near_items", none)})
    return joined.select("row", "text", "n_words", "n_hit", "items", *(["near_items"] if proximity else []))


def op9_decontaminate(spark, sf_dir: str) -> DataFrame:
    """matches of documents with benchmark; nulls, repeats and empties: as matches has them."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = matches(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    items = F.sha2(F.array_join("items", ","), 256).alias("items_sha256")
    return found.select("row.doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), items, (F.col("n_hit") > 0).alias("contaminated"))


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents in which no window of a benchmark text occurs; a null text has none and stays."""
    placed = numbered(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", as_row(docs, "text")))
    index = build_index(placed)
    found = search(index, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).select("doc")
    forget(index)
    few = found.count() <= SENT_ROWS
    return placed.join(F.broadcast(found) if few else found, "doc", "left_anti").select(*from_row(docs, {"text": F.col("text")}))
