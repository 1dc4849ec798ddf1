"""Expressions over array<float> vectors; sums are in double."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def normalise(a: Column) -> Column:
    """Unit length; a zero vector stays zero."""
    return F.when(norm(a) > 0, F.transform(a, lambda x: x.cast("double") / norm(a))).otherwise(F.transform(a, lambda x: x.cast("double")))


def sign_words(a: Column) -> Column:
    """Bit i of the words, least first, is set where element i is above zero."""
    word = lambda w: F.aggregate(
        F.transform(F.slice(a, w * 64 + 1, F.lit(64)), lambda x, i: F.when(x > 0, F.call_function("shiftleft", F.lit(1).cast("bigint"), i)).otherwise(F.lit(0).cast("bigint"))),
        F.lit(0).cast("bigint"),
        lambda s, x: s.bitwiseOR(x),
    )
    return F.when(F.size(a) == 0, F.array().cast("array<bigint>")).otherwise(F.transform(F.sequence(F.lit(0), F.floor((F.size(a) - 1) / 64).cast("int")), word))


def hamming(a: Column, b: Column) -> Column:
    """Bits that differ between two arrays of words."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x)


def hamming_score(a: Column, b: Column) -> Column:
    """1 for equal signs; padding bits of the last word count as equal."""
    return 1 - 2 * hamming(a, b) / (64 * F.size(a))


def mean_pool(hidden: Column, mask: Column) -> Column:
    """Mean over the tokens whose mask is 1 of array<array<float>>; zero if there is none."""
    kept = F.filter(F.arrays_zip(hidden.alias("h"), mask.alias("m")), lambda x: x["m"] == 1)
    zero = F.transform(F.get(hidden, 0), lambda x: F.lit(0.0))
    total = F.aggregate(kept, zero, lambda s, x: F.zip_with(s, x["h"], lambda p, q: p + q.cast("double")))
    return F.transform(total, lambda x: x / F.greatest(F.size(kept), F.lit(1)))
