"""Ordered scans over long sequences: previous row, carried value, running sum, gap runs.

A window over a whole entity would put a hot entity into one task. Each scan here cuts
an entity's sequence into ordered buckets (an hour, a thousand positions), works inside
the buckets, and carries one small summary row per bucket across them. Only the bucket
summaries of an entity meet in one window.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from calendra.functions.lineage import cut


def rejoin(df: DataFrame, found: DataFrame, keys: Sequence[str], *cols: str) -> DataFrame:
    """Adds columns of one summary row a key and bucket; null keys and buckets meet as well."""
    by = [*keys, "_b"]
    found = found.select(*[F.col(k).alias(f"_j{i}") for i, k in enumerate(by)], *cols)
    same = reduce(and_, [F.col(k).eqNullSafe(F.col(f"_j{i}")) for i, k in enumerate(by)])
    return df.join(found, same).drop(*[f"_j{i}" for i in range(len(by))])


def _ordered(keys: Sequence[str], *order: str):
    return W.partitionBy(*keys).orderBy(*order)


def previous_row(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], cols: Sequence[str],
    bucket: Column, out: str = "prev",
) -> DataFrame:
    """Adds struct ``out`` with ``cols`` of the row before in the key's order."""
    keys, order = list(keys), list(order)
    df = df.withColumn("_b", bucket)
    payload = F.struct(*cols)
    carried = (
        df.groupBy(*keys, "_b")
        .agg(F.max_by(payload, F.struct(*order)).alias("_last"))
        .withColumn("_carried", F.lag("_last").over(_ordered(keys, "_b")))
        .drop("_last")
    )
    inside = F.lag(payload).over(_ordered([*keys, "_b"], *order))
    return (
        rejoin(df, carried, keys, "_carried")
        .withColumn(out, F.coalesce(inside, F.col("_carried")))
        .drop("_b", "_carried")
    )


def carry_last(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], value: str,
    bucket: Column, out: str,
) -> DataFrame:
    """Adds ``out``: the last non-null ``value`` at or before the row in the key's order."""
    keys, order = list(keys), list(order)
    df = df.withColumn("_b", bucket)
    position = F.when(F.col(value).isNotNull(), F.struct(*order))
    before = _ordered(keys, "_b").rowsBetween(W.unboundedPreceding, -1)
    carried = (
        df.groupBy(*keys, "_b")
        .agg(F.max_by(F.col(value), position).alias("_last"))
        .withColumn("_carried", F.last("_last", ignorenulls=True).over(before))
        .drop("_last")
    )
    upto = _ordered([*keys, "_b"], *order).rowsBetween(W.unboundedPreceding, 0)
    inside = F.last(value, ignorenulls=True).over(upto)
    return (
        rejoin(df, carried, keys, "_carried")
        .withColumn(out, F.coalesce(inside, F.col("_carried")))
        .drop("_b", "_carried")
    )


def running_sum(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], values: dict[str, str],
    bucket: Column,
) -> DataFrame:
    """Adds running sums; ``values`` maps source column to output column."""
    keys, order = list(keys), list(order)
    df = df.withColumn("_b", bucket)
    before = _ordered(keys, "_b").rowsBetween(W.unboundedPreceding, -1)
    totals = df.groupBy(*keys, "_b").agg(*[F.sum(v).alias(f"_t_{o}") for v, o in values.items()])
    offsets = totals.select(
        *keys, "_b",
        *[F.coalesce(F.sum(f"_t_{o}").over(before), F.lit(0)).alias(f"_o_{o}") for o in values.values()],
    )
    upto = _ordered([*keys, "_b"], *order).rowsBetween(W.unboundedPreceding, 0)
    out = rejoin(df, offsets, keys, *[f"_o_{o}" for o in values.values()])
    for v, o in values.items():
        out = out.withColumn(o, F.sum(v).over(upto) + F.col(f"_o_{o}"))
    return out.drop("_b", *[f"_o_{o}" for o in values.values()])


def gap_runs(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], axis: str, gap: Column | float,
    bucket: Column | None, out: str = "run",
) -> DataFrame:
    """Numbers the runs of a key: a new run starts when ``axis`` jumps by more than ``gap``.

    A bucket's summary is its first and last position and the starts inside it, so one pass
    over the summaries tells where its first row starts a run and how many came before.
    Without a bucket a key is scanned as a whole, which suits keys that are a page or less.
    """
    keys, order = list(keys), list(order)
    limit = gap if isinstance(gap, Column) else F.lit(gap)
    if bucket is None:
        whole = _ordered(keys, *order)
        starts = F.coalesce((F.col(axis) - F.lag(axis).over(whole) > limit).cast("int"), F.lit(0))
        upto = whole.rowsBetween(W.unboundedPreceding, 0)
        return df.withColumn("_start", starts).withColumn(out, F.sum("_start").over(upto) + 1).drop("_start")
    inside = _ordered([*keys, "_b"], *order)
    at = F.struct(*order)
    stepped = df.withColumn("_b", bucket).withColumn("_gap", limit).withColumn(
        "_start", (F.col(axis) - F.lag(axis).over(inside) > F.col("_gap")).cast("int")
    )
    by_key = _ordered(keys, "_b")
    before = by_key.rowsBetween(W.unboundedPreceding, -1)
    borders = (
        stepped.groupBy(*keys, "_b")
        .agg(
            F.min_by(axis, at).alias("_first"), F.min_by("_gap", at).alias("_limit"), F.max_by(axis, at).alias("_last"),
            F.coalesce(F.sum("_start"), F.lit(0)).alias("_inner"),
        )
        .withColumn("_prev", F.lag("_last").over(by_key))
        .withColumn("_opens", (F.col("_prev").isNull() | (F.col("_first") - F.col("_prev") > F.col("_limit"))).cast("int"))
        .withColumn("_before", F.coalesce(F.sum(F.col("_inner") + F.col("_opens")).over(before), F.lit(0)) + F.col("_opens"))
    )
    upto = inside.rowsBetween(W.unboundedPreceding, 0)
    return (
        rejoin(stepped, borders, keys, "_before")
        .withColumn(out, F.col("_before") + F.coalesce(F.sum("_start").over(upto), F.lit(0)))
        .drop("_b", "_gap", "_start", "_before")
    )


def numbered(df: DataFrame, keys: Sequence[str], order: Sequence[str], out: str = "number") -> DataFrame:
    """Adds the place of each row (1, 2, ...) in its key's order, without a window over a key.

    Rows are sorted by ranges of keys and order and written once; a key's rows in one range
    are numbered by their place in the range, after those of the ranges before. Of a key only
    one row a range meets in a window.
    """
    place = F.monotonically_increasing_id()
    ordered = cut(
        df.repartitionByRange(*keys, *order).sortWithinPartitions(*keys, *order)
        .withColumn("_place", place).withColumn("_b", F.shiftright("_place", 33))
    )
    before = _ordered(keys, "_b").rowsBetween(W.unboundedPreceding, -1)
    first = ordered.groupBy(*keys, "_b").agg(F.min("_place").alias("_first"), F.count("*").alias("_n")).select(
        *keys, "_b", "_first", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before")
    )
    return rejoin(ordered, first, keys, "_first", "_before").withColumn(
        out, F.col("_place") - F.col("_first") + 1 + F.col("_before")
    ).drop("_b", "_place", "_first", "_before")
