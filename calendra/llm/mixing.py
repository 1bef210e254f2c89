"""Mixing sources to target weights by hash-threshold histograms.

Every document has a 60-bit hash of its key. A source's budget becomes a threshold: the
documents with a smaller hash are taken once more than the others. To find it, sizes are
summed by source and hash bucket (12 bits), the bucket in which the budget ends is located
from the running sums, and only this bucket's documents are summed again by the next 12
bits, until the bucket holds one hash. Documents are then filtered by comparing hashes;
no rows are sorted, and a larger budget always takes a superset of a smaller one's.

Targets: the total budget is ``share`` times all sizes, dealt by the sources' weights (by
code point of the source, null last, weights repeating); no target exceeds ``most`` times its
source's size, and the excess is dealt again among the others.

Cases: a null source is a source; a null text has size 0 and is taken like any other of its
hash; a null key hashes like an empty one; rows of equal key move together, the boundary
going to the side nearer to the budget; a source of size 0 takes nothing; an empty table
gives an empty one; columns of the input that are written anew are replaced.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from calendra.llm.common import cut, without

BITS = 12
LEVELS = 5
#: With more sources than this, their thresholds are joined instead of broadcast.
BROADCAST_SOURCES = 10_000
ADDED = ("source_size", "target", "copies", "taken")


def key_hash(key: Column) -> Column:
    """60 bits of the MD5 of the key's text."""
    digest = F.md5(F.coalesce(key.cast("string"), F.lit("")).cast("binary"))
    return F.conv(F.substring(digest, 1, BITS * LEVELS // 4), 16, 10).cast("bigint")


def targets(sized: DataFrame, weights: Sequence[int], share: float, most: float) -> DataFrame:
    """source, source_size and target of every source: one small row each."""
    by_code = W.orderBy(F.col("source").asc_nulls_last())
    everywhere = W.partitionBy()
    upto = W.orderBy("ratio", F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), ((F.row_number().over(by_code) - 1) % len(weights) + 1).cast("int"))
    levels = (
        sized.groupBy("source").agg(F.sum("size").alias("source_size"))
        .withColumn("weight", weight)
        .withColumn("cap", F.lit(most) * F.col("source_size"))
        .withColumn("total", F.lit(share) * F.sum("source_size").over(everywhere))
        .withColumn("ratio", F.col("cap") / F.col("weight"))
        .withColumn("capped", F.sum("cap").over(upto.rowsBetween(W.unboundedPreceding, -1)))
        .withColumn("open", F.sum("weight").over(upto.rowsBetween(0, W.unboundedFollowing)))
        .withColumn("level", (F.col("total") - F.coalesce("capped", F.lit(0.0))) / F.col("open"))
        .withColumn("level", F.max(F.when(F.col("ratio") > F.col("level"), F.col("level"))).over(everywhere))
    )
    dealt = F.least(F.col("cap"), F.coalesce(F.col("level") * F.col("weight"), F.col("cap")))
    return levels.select("source", "source_size", dealt.alias("target"))


def thresholds(sized: DataFrame, sources: DataFrame) -> DataFrame:
    """Adds ``full`` (copies of every document) and ``below`` (hashes under it: one more).

    ``sized`` has source, size and hash, and is read once a level.
    """
    budget = sources.withColumn("full", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0))
    budget = budget.withColumn("rest", F.col("target") - F.col("full") * F.col("source_size"))
    state = budget.select(F.col("source").alias("of"), "rest", F.lit(0).cast("bigint").alias("prefix"), F.lit(0).cast("bigint").alias("before"))
    for level in range(1, LEVELS + 1):
        shift = BITS * (LEVELS - level)
        inside = F.shiftright("hash", shift + BITS) == F.col("prefix")
        sums = (
            sized.join(state, F.col("source").eqNullSafe(F.col("of")) & inside)
            .groupBy("of", "rest", "before", F.shiftright("hash", shift).alias("prefix"))
            .agg(F.sum("size").alias("n"))
        )
        upto = W.partitionBy("of").orderBy("prefix").rowsBetween(W.unboundedPreceding, -1)
        state = (
            sums.withColumn("before", F.col("before") + F.coalesce(F.sum("n").over(upto), F.lit(0)))
            .filter((F.col("before") <= F.col("rest")) & (F.col("rest") < F.col("before") + F.col("n")))
        )
    nearer = F.when(F.col("before") + F.col("n") / 2 <= F.col("rest"), F.col("prefix") + 1).otherwise(F.col("prefix"))
    edges = state.select("of", nearer.alias("below"))
    return budget.join(edges, F.col("source").eqNullSafe(F.col("of")), "left").select(
        "source", "source_size", "target", F.col("full").cast("bigint").alias("full"), F.coalesce("below", F.lit(0)).alias("below"),
    )


def mix(
    docs: DataFrame, sized: DataFrame, *, weights: Sequence[int] = (3, 1, 2), share: float = 1.5, most: float = 2.0,
) -> DataFrame:
    """Adds ``source_size``, ``target`` and ``copies`` to ``docs`` (doc_id, source, ...).

    ``sized`` is the same table as doc_id, source and size; it is read several times, so
    cut it from a costly plan first. ``copies`` is 0 to ``most`` for each document.
    """
    docs = without(docs, *ADDED)
    hashed = sized.select("source", "size", key_hash(F.col("doc_id")).alias("hash"))
    edges = cut(thresholds(hashed, targets(sized, weights, share, most)).withColumnRenamed("source", "of"))
    if edges.count() <= BROADCAST_SOURCES:
        edges = F.broadcast(edges)
    more = (key_hash(F.col("doc_id")) < F.col("below")).cast("bigint")
    return (
        docs.join(edges, F.col("source").eqNullSafe(F.col("of")), "left")
        .withColumn("copies", F.when(F.col("source_size") > 0, F.col("full") + more).otherwise(0).cast("bigint"))
        .drop("of", "full", "below")
    )


#: The query's result by sorting, in SQL.
ORACLE = r"""
WITH d AS (
  SELECT doc_id, source,
         CASE WHEN text IS NULL THEN 0 ELSE len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) END::BIGINT AS size,
         ('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 15))::BIGINT AS h
  FROM documents),
s AS (
  SELECT source, sum(size)::BIGINT AS source_size,
         [3, 1, 2][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT] AS weight
  FROM d GROUP BY source),
c AS (
  SELECT *, 2e0 * source_size AS cap, 1.5e0 * sum(source_size) OVER () AS total, 2e0 * source_size / weight AS ratio FROM s),
l AS (
  SELECT *, (total - coalesce(sum(cap) OVER (ORDER BY ratio, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
            / sum(weight) OVER (ORDER BY ratio, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM c),
t AS (
  SELECT source, source_size,
         least(cap, coalesce(max(level) FILTER (WHERE ratio > level) OVER () * weight, cap)) AS target FROM l),
r AS (
  SELECT d.*, t.source_size, t.target,
         CASE WHEN t.source_size > 0 THEN floor(t.target / t.source_size) ELSE 0 END AS copies,
         sum(size) OVER (PARTITION BY d.source ORDER BY h RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto,
         sum(size) OVER (PARTITION BY d.source, h) AS own
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
       (size * (copies + CASE WHEN upto - own / 2e0 <= target - copies * source_size THEN 1 ELSE 0 END))::BIGINT AS taken
FROM r
"""
