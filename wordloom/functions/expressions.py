"""Column expressions over words and vectors."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: A word: letters, digits and underscores, with single apostrophes or full stops inside.
WORD = r"[\p{L}\p{N}_]+(?:['’.][\p{L}\p{N}_]+)*"


def words_of(text: Column, lower: bool = False) -> Column:
    """The words of a text, in order."""
    return F.regexp_extract_all(F.lower(text) if lower else text, F.lit(WORD), F.lit(0))


def dot(a: Column, b: Column) -> Column:
    """Inner product of two arrays, in double precision; null if either is null."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two arrays; null if one is a zero vector."""
    length = norm(a) * norm(b)
    return F.when(length > 0, dot(a, b) / length)


def unit(a: Column) -> Column:
    """The vector of length 1 in the same direction, so that cosines are inner products.

    The length is an array of one number, as Spark would make it again for each of the vector's numbers.
    """
    return F.get(F.transform(F.array(norm(a)), lambda length: F.when(length > 0, F.transform(a, lambda x: x.cast("double") / length))), F.lit(0))


def fisher(r: Column) -> Column:
    """Variance-stabilising transform of a correlation; null at or beyond 1."""
    return F.when(F.abs(r) < 1, F.atanh(r))


def hash_number(*parts: Column) -> Column:
    """A number from 0 to 2**32 - 1 that follows from the parts' text; any engine with MD5 can make it."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", *(p.cast("string") for p in parts))), 1, 8), 16, 10).cast("long")
