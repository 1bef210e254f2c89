"""Array expressions that turn text matching into equality joins."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

NO_TEXTS = "cast(array() as array<string>)"


def substrings(s: Column, min_len: int = 1) -> Column:
    """Every distinct substring of at least ``min_len`` characters of a short name."""
    starts = F.sequence(F.lit(1), F.length(s) - min_len + 1)

    def from_start(i: Column) -> Column:
        return F.transform(
            F.sequence(F.lit(min_len), F.length(s) - i + 1), lambda n: F.substring(s, i, n)
        )

    return F.when(
        F.length(s) >= min_len, F.array_distinct(F.flatten(F.transform(starts, from_start)))
    ).otherwise(F.expr(NO_TEXTS))


def suffixes(s: Column, min_len: int) -> Column:
    return F.when(
        F.length(s) >= min_len,
        F.transform(F.sequence(F.lit(min_len), F.length(s)), lambda n: F.right(s, n)),
    ).otherwise(F.expr(NO_TEXTS))


def prefixes(s: Column, min_len: int = 1) -> Column:
    return F.when(
        F.length(s) >= min_len,
        F.transform(F.sequence(F.lit(min_len), F.length(s)), lambda n: F.left(s, n)),
    ).otherwise(F.expr(NO_TEXTS))


def subsets(tokens: Column) -> Column:
    """Every non-empty subset of a sorted token array, each as a sorted array."""
    grown = F.aggregate(
        tokens,
        F.expr("array(cast(array() as array<string>))"),
        lambda done, t: F.concat(done, F.transform(done, lambda s: F.concat(s, F.array(t)))),
    )
    return F.filter(grown, lambda s: F.size(s) > 0)
