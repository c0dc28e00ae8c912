"""Exact set-similarity join of lines, in DataFrame functions only.

A line is the set of its words.  Of two lines with Jaccard similarity of at least 4/5
the later one (by document and line number) is removed, whatever becomes of the other.

1.  Lines of one text, but for the kind of their blanks, are a class, known by the MD5 of
    its bytes; the first line stands for it and all others go.  Classes are pre-aggregated
    in each task, so a line that a third of all documents hold is a few rows.  Lines of
    one set of words and different texts are classes of their own, which the join finds.
    From here on a word is a 32-bit number.
2.  Words are put in order of rarity: by the magnitude of the number of classes that hold
    their bucket.  There is a bucket for some BUCKET_WORDS words of the classes, up to
    2**22; the magnitudes, a byte each, are one row that goes along in the plans.
3.  Two similar sets share a word among the first n - ceil(4n/5) + 1 of the larger and
    the first n - ceil(8n/9) + 1 of the smaller.  Classes are joined on such words with
    length and positional filters, and with the parities of the words in 64 bits, or 128
    for long lines (sets that differ in d words have parities that differ in at most d
    bits).  Sizes are in bands of a factor of two, and a word is joined band by band: the
    smaller set of a pair is also looked up in the next band if a set that is large enough
    for it can be there.
4.  Before that join, a class meets two hubs of each of a few of its words: the earliest
    and the most copied of the classes that are copied, or drawn by a hash, and have the
    word among their rarest.  That settles the many variants of one line without forming
    their pairs; what it leaves open, the join finds.
5.  Pairs are verified on the words of the lines themselves, read from the texts.

Two different words may have one number: a class's numbers count with their repeats, so
that shared words are never fewer than they were.  All pairs of classes are decided on
their words, by step 5.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import as_row, forget, from_row, stored
from .substring import numbered

#: The similarity is NUM / DEN or more.
NUM, DEN = 4, 5
#: Words of the classes for each bucket of the rarities, and the least and greatest number of buckets as powers of two.
BUCKET_WORDS, LEAST_BITS, MOST_BITS = 1500, 16, 22
#: Words of a class that are looked up among the hubs, and the part of the classes, one in so many, that may be hubs without being copied.
HUB_WORDS, HUB_PART = 2, 64
#: Sets of more words have parities in 128 bits.
WIDE = 48
#: Rows up to which lines' places go to all tasks (some 40 bytes each).
SENT_ROWS = 500_000

_BLANKS = "\t\x0b\f\r"


def _spaced(text):
    """A text with every blank but the line break made a space."""
    out = text
    for sign in _BLANKS:
        out = F.replace(out, F.lit(sign), F.lit(" "))
    return F.when(text.rlike(f"[{_BLANKS}]"), out).otherwise(text)


def _words(line):
    """The words of a line of a spaced text."""
    return F.array_remove(F.split(line, " "), "")


def _share(n, num: int, den: int):
    """The least whole number of at least n * num / den."""
    up = n * num + (den - 1)
    return ((up - F.pmod(up, F.lit(den))) / den).cast("int")


def _prefix(n, num: int, den: int):
    return (n - _share(n, num, den) + 1).cast("int")


class Places:
    """A line's place, document before number, in one long."""

    def __init__(self, docs: DataFrame):
        low, high = docs.agg(F.min("doc"), F.max("doc")).head()
        self.low = low or 0
        docs_bits = ((high or 0) - self.low).bit_length()
        self.bits = 32  # no text has more bytes
        if docs_bits + self.bits > 63:
            self.bits = (docs.agg(F.max(F.octet_length("text"))).head()[0] or 0).bit_length() + 1
        self.fits = docs_bits + self.bits < 64

    def of(self, doc, no):
        return F.shiftleft(doc - F.lit(self.low), self.bits).bitwiseOR(no.cast("long"))

    def doc(self, place):
        return F.shiftright(place, self.bits) + F.lit(self.low)

    def no(self, place):
        return place.bitwiseAND(F.lit((1 << self.bits) - 1)).cast("int")


def classes(docs: DataFrame, places: Places) -> DataFrame:
    """(place, n, ws, copies): the first line of each class, its different words as 32-bit numbers, and its lines."""
    lines = docs.select("doc", F.posexplode(F.split(_spaced(F.col("text")), "\n")).alias("no", "line")).filter(F.btrim("line") != "")
    # Two spaces in a row give an empty word, which goes by its number.
    hashes = F.array_remove(F.array_distinct(F.transform(F.split("line", " "), lambda w: F.xxhash64(w))), F.xxhash64(F.lit("")))
    numbers = F.transform(hashes, lambda h: F.shiftright(h, 32).cast("int"))
    sets = lines.select(F.unhex(F.md5("line")).alias("key"), places.of(F.col("doc"), F.col("no")).alias("place"), numbers.alias("ws"))
    keyed = sets.select("key", F.struct("place", F.size("ws").alias("n"), "ws").alias("c"))
    return keyed.groupBy("key").agg(F.min("c").alias("c"), F.count("*").alias("copies")).select("c.place", "c.n", "c.ws", "copies")


def _bucket(w, bits: int):
    return F.shiftrightunsigned(w, 32 - bits)


def bucket_bits(found: DataFrame) -> int:
    words = found.agg(F.sum(F.size("ws").cast("long"))).head()[0] or 0
    return min(MOST_BITS, max(LEAST_BITS, (words // BUCKET_WORDS).bit_length()))


def rarity(found: DataFrame, bits: int) -> DataFrame:
    """One row: the magnitude of the number of classes that hold each bucket's words."""
    counts = found.select(F.explode("ws").alias("w")).groupBy(_bucket(F.col("w"), bits).alias("id")).agg(F.count("*").alias("n"))
    every = found.sparkSession.range(1 << bits).select(F.col("id").cast("int").alias("id")).join(counts, "id", "left")
    magnitude = F.round(2 * F.log2(F.coalesce("n", F.lit(0)) + 1)).cast("tinyint")
    return every.agg(F.sort_array(F.collect_list(F.struct("id", magnitude.alias("m"))))["m"].alias("m"))


def described(found: DataFrame, magnitudes: DataFrame, bits: int) -> DataFrame:
    """(place, n, copies, bits, more, rare): classes with their parities and rarest words."""
    found, m = found.withColumn("m", magnitudes.scalar()), F.col("m")
    # Without nulls, longs are sorted as they are.
    by_rarity = F.sort_array(F.transform("ws", lambda w: F.coalesce(F.shiftleft(F.get(m, _bucket(w, bits)).cast("long"), 33) + w, F.lit(0).cast("long"))))
    # A word turns bit w mod 64 of one of two maps, by the next bit of w: the bits turned in either, less those of the second, are the first's.
    turned = lambda one: F.aggregate("ws", F.lit(0).cast("long"), lambda a, w: a.bitwiseXOR(F.call_function("shiftleft", one(w), w)))
    either = turned(lambda w: F.lit(1).cast("long"))
    second = turned(lambda w: F.shiftright(w, 6).bitwiseAND(F.lit(1)).cast("long"))
    more = F.when(F.col("n") > WIDE, second).otherwise(F.lit(0).cast("long"))
    # The low 32 bits are the word again.
    rare = F.transform(F.slice(by_rarity, 1, _prefix(F.col("n"), NUM, DEN)), lambda x: F.shiftright(F.shiftleft(x, 32), 32).cast("int"))
    return found.select("place", "n", F.col("copies"), either.alias("bits"), more.alias("more"), rare.alias("rare"))


_POS_BITS = 31


def _posted(of: DataFrame, words, *more: str) -> DataFrame:
    """A row for each class and each of some of its rarest words; size: the set's size and the word's place in it."""
    rows = of.select("place", "n", "bits", "more", *more, F.posexplode(words).alias("pos", "w"))
    return rows.select("w", "place", "bits", "more", F.shiftleft(F.col("n").cast("long"), _POS_BITS).bitwiseOR(F.col("pos").cast("long")).alias("size"), *more)


def _n(side: str):
    return F.shiftright(F.col(f"{side}.size"), _POS_BITS)


def _pos(side: str):
    return F.col(f"{side}.size").bitwiseAND(F.lit((1 << _POS_BITS) - 1))


def _band(n):
    """Sizes in steps of about a factor of two; greater sizes are in the same or a later one."""
    return F.floor(F.log2(n)).cast("long")


def _in_band(posted: DataFrame, band) -> DataFrame:
    """posted with a word and a band as its w."""
    return posted.withColumn("w", F.shiftleft(F.col("w").cast("long"), 6).bitwiseOR(band))


def _sizes(large, small):
    return (small <= large) & (small * DEN >= large * NUM)


def _near(a: str, b: str):
    """Parity filter.

    Sets of na and nb words that are similar enough differ in (na + nb) * (DEN - NUM) / (NUM + DEN)
    words at most.
    """
    both = lambda name: F.col(f"{a}.{name}").bitwiseXOR(F.col(f"{b}.{name}"))
    na, nb = _n(a), _n(b)
    differ = F.when(F.least(na, nb) <= WIDE, F.bit_count(both("bits"))).otherwise(F.bit_count(both("bits").bitwiseXOR(both("more"))) + F.bit_count(both("more")))
    return differ * (NUM + DEN) <= (na + nb) * (DEN - NUM)


def _room(a: str, b: str):
    """Positional filter: the words from the shared one on must be enough; similar sets share (na + nb) * NUM / (NUM + DEN) at least."""
    na, nb = _n(a), _n(b)
    return F.least(na - _pos(a), nb - _pos(b)) * (NUM + DEN) >= (na + nb) * NUM


def hub_pairs(found: DataFrame) -> DataFrame:
    """(later, earlier): classes with hubs of the last words of their prefixes, which edits of rare words leave in it."""
    own = F.size("rare") - F.least(F.size("rare"), F.lit(HUB_WORDS))
    posted = _posted(found, F.slice("rare", own + 1, F.lit(HUB_WORDS)))
    may_be = (F.col("copies") > 1) | (F.pmod(F.xxhash64("place"), F.lit(HUB_PART)) == 0)
    fields = ("place", "bits", "more", "size")
    hubs = _posted(found.filter(may_be), F.col("rare"), "copies")
    copied = F.max(F.struct("copies", F.bitwise_not("place").alias("before"), *fields)).alias("copied")
    hubs = hubs.groupBy("w").agg(F.min(F.struct(*fields)).alias("early"), copied)
    both = F.array_distinct(F.array("early", F.struct(*(F.col("copied").getField(x).alias(x) for x in fields))))
    hubs = hubs.select("w", F.explode(both).alias("hub")).select("w", "hub.*")
    met = posted.alias("a").join(hubs.alias("b"), (F.col("a.w") == F.col("b.w")) & (F.col("b.place") < F.col("a.place")) & _sizes(F.greatest(_n("a"), _n("b")), F.least(_n("a"), _n("b"))) & _near("a", "b"))
    return met.select(F.col("a.place").alias("later"), F.col("b.place").alias("earlier")).distinct()


def open_pairs(found: DataFrame, settled: DataFrame) -> DataFrame:
    """(later, earlier): all pairs of classes that may be similar and whose later one is not settled yet."""
    done = settled.select("place", F.lit(True).alias("done"))
    done = F.broadcast(done) if settled.count() <= SENT_ROWS else done
    marked = found.join(done, "place", "left").withColumn("done", F.coalesce("done", F.lit(False)))
    n = F.shiftright("size", _POS_BITS)
    larger = _in_band(_posted(marked, F.col("rare"), "done"), _band(n))
    # Of the smaller set, the first n - ceil(8n/9) + 1 words are enough.  Sets it is similar to have at most DEN / NUM of its words.
    posted = _posted(marked, F.slice("rare", 1, _prefix(F.col("n"), 2 * NUM, NUM + DEN)), "done")
    bands = F.array_distinct(F.array(_band(n), _band(F.floor(n * DEN / NUM))))
    smaller = _in_band(posted.select("*", F.explode(bands).alias("band")), F.col("band")).drop("band")
    a, b = F.col("a.place"), F.col("b.place")
    ordered = (_n("a") > _n("b")) | (a > b)
    is_open = F.when(a > b, ~F.col("a.done")).otherwise(~F.col("b.done"))
    met = larger.alias("a").join(smaller.alias("b"), (F.col("a.w") == F.col("b.w")) & _sizes(_n("a"), _n("b")) & _near("a", "b") & _room("a", "b") & (a != b) & ordered & is_open)
    return met.select(F.greatest(a, b).alias("later"), F.least(a, b).alias("earlier")).distinct()


def verified(pairs: DataFrame, docs: DataFrame, places: Places) -> DataFrame:
    """(place): the later classes of pairs (a stored table) that truly are similar, by the words of the lines."""
    wanted = pairs.select(F.explode(F.array("later", "earlier")).alias("place")).distinct().groupBy(places.doc(F.col("place")).alias("doc")).agg(F.collect_list(places.no(F.col("place"))).alias("nos"))
    # Only lines that a pair names leave their texts.  Few of them go to the texts; many are met by a shuffle of both.
    few = pairs.count() <= SENT_ROWS
    held = docs.join(F.broadcast(wanted) if few else wanted, "doc").select("doc", "nos", F.split(_spaced(F.col("text")), "\n").alias("lines"))
    named = held.select("doc", F.explode(F.transform("nos", lambda i: F.struct(i.alias("no"), F.get("lines", i).alias("line")))).alias("x"))
    text = stored(named.select(places.of(F.col("doc"), F.col("x.no")).alias("place"), F.array_distinct(_words("x.line")).alias("ws")), "line-words")
    both = pairs.join(text.select(F.col("place").alias("later"), F.col("ws").alias("a")), "later").join(text.select(F.col("place").alias("earlier"), F.col("ws").alias("b")), "earlier")
    # |A & B| / |A | B| >= NUM / DEN, in whole numbers
    true = both.filter(F.size(F.array_intersect("a", "b")) * (NUM + DEN) >= NUM * (F.size("a") + F.size("b")))
    out = stored(true.select(F.col("later").alias("place")).distinct(), "line-matches")
    forget(text)
    return out


def kept_lines(docs: DataFrame, places: Places) -> DataFrame:
    """(doc, nos): the numbers of the lines with a word that stay, for each of docs (doc, text)."""
    sets = stored(classes(docs, places), "line-classes", plain=True)
    firsts = stored(sets.select("place"), "line-firsts")
    bits = bucket_bits(sets)
    found = stored(described(sets, stored(rarity(sets, bits), "line-rarity"), bits), "line-prefixes", plain=True)
    forget(sets)
    pairs = stored(hub_pairs(found), "line-pairs")
    settled = verified(pairs, docs, places)
    more = stored(open_pairs(found, settled), "line-pairs")
    forget(found)
    gone = settled.unionByName(verified(more, docs, places))
    forget(pairs)
    forget(more)
    stay = firsts.join(gone, "place", "left_anti")
    return stay.groupBy(places.doc(F.col("place")).alias("doc")).agg(F.collect_list(places.no(F.col("place"))).alias("nos"))


def dedup(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text and others) without the removed lines, with n_lines and n_removed.

    Lines without words stay.  A text's work is in proportion to its lines.
    """
    docs, places = _placed(docs)
    kept = kept_lines(docs.select("doc", "text"), places)
    others = [c for c in docs.columns if c != "text"]
    split = docs.join(kept, "doc", "left").select(*others, "text", F.split("text", "\n").alias("lines"), F.coalesce("nos", F.array().cast("array<int>")).alias("nos"))
    missing = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), F.col("nos"))
    gone = F.filter(missing, lambda i: F.btrim(F.get("lines", i), F.lit(" " + _BLANKS)) != "")
    marked = split.select(*others, "text", "lines", gone.alias("gone"))
    # What lies between the removed lines.
    begin = lambda k: F.when(k > 0, F.get("gone", k - 1) + 1).otherwise(0)
    runs = F.transform(F.sequence(F.lit(0), F.size("gone")), lambda k: F.slice("lines", begin(k) + 1, F.coalesce(F.get("gone", k), F.size("lines")) - begin(k)))
    text = F.when(F.size("gone") == 0, F.col("text")).otherwise(F.array_join(F.flatten(runs), "\n"))
    return marked.select(*others, text.alias("text"), F.size("lines").cast("long").alias("n_lines"), F.size("gone").cast("long").alias("n_removed"))


def _placed(docs: DataFrame) -> tuple[DataFrame, Places]:
    """docs with numbers such that every line's place fits a long."""
    out = numbered(docs)
    places = Places(out)
    if not places.fits:
        out = numbered(docs, dense=True)
        places = Places(out)
    return out, places


def line_dedup(docs: DataFrame) -> DataFrame:
    """doc_id, n_lines, n_removed and text of each row.

    Null text: one empty line.  Rows that share an id (null is one) are documents of their
    own, as any others.  Other columns are left out.  An empty table gives no rows.
    """
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    return dedup(texts).select("doc_id", "n_lines", "n_removed", "text")


def op7_line_dedup(spark, sf_dir: str) -> DataFrame:
    """line_dedup of documents, which says how nulls, repeated rows and empty tables are taken; the text as its SHA-256."""
    found = line_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select("doc_id", "n_lines", "n_removed", F.sha2("text", 256).alias("kept_sha256"))


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows, without their removed lines; n_chars is that of the text left.  Nulls and repeats: as line_dedup has them."""
    new = dedup(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"), as_row(docs, "text")))
    return new.select(*from_row(docs, {"text": F.col("text"), "n_chars": F.length("text").cast("long")}))
