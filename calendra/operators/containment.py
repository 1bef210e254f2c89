"""Which names stand inside which others, through one rare piece of each.

Every name that may contain others lists its pieces of a fixed length, one row for each
place. A name that is looked for asks for one of its pieces only, the one that stands in the
fewest names, and the rows it meets are compared in full. Names shorter than a piece ask for
all pieces that have them, found among the distinct pieces.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from calendra.functions.grams import substrings

PIECE = 4


def pieces(name: Column, size: int = PIECE) -> Column:
    """The distinct substrings of ``size`` characters; a shorter name is its own piece."""
    starts = F.sequence(F.lit(1), F.greatest(F.length(name) - size + 1, F.lit(1)))
    return F.array_distinct(F.transform(starts, lambda i: F.substring(name, i, F.lit(size))))


def postings(holders: DataFrame, name: str, size: int = PIECE) -> DataFrame:
    """The rows of ``holders`` once for each piece: at most as many as the name's length."""
    return holders.where(F.col(name) != "").withColumn("_piece", F.explode(pieces(F.col(name), size)))


def anchors(needles: DataFrame, name: str, counts: DataFrame, size: int = PIECE) -> DataFrame:
    """``name`` and a piece that every name holding it has; shorter names have several rows.

    ``counts`` has the distinct pieces of the holders and their number. Needles that stand nowhere
    are left out as far as the pieces tell.
    """
    asked = needles.select(name).where(F.col(name) != "").distinct()
    own = asked.where(F.length(name) >= size).withColumn("_of", pieces(F.col(name), size))
    rarest = (
        own.select(name, F.size("_of").alias("_wanted"), F.explode("_of").alias("_piece"))
        .join(counts.select("_piece", "_n"), "_piece")
        .groupBy(name, "_wanted").agg(F.count("*").alias("found"), F.min(F.struct("_n", "_piece")).alias("least"))
        .where("found = _wanted").select(name, F.col("least._piece").alias("_piece"))
    )
    inner = counts.select("_piece", F.explode(substrings(F.col("_piece"), 1)).alias("_s")).where(F.length("_s") < size)
    short = asked.where(F.length(name) < size).join(inner, F.col(name) == F.col("_s")).select(name, "_piece")
    return rarest.unionByName(short)


def holding_pairs(holders: DataFrame, needles: DataFrame, holder: str = "holder", needle: str = "needle") -> DataFrame:
    """All pairs of distinct names in which ``holder`` contains ``needle`` (or equals it)."""
    listed = postings(holders.select(holder).distinct(), holder)
    counts = listed.groupBy("_piece").agg(F.count("*").alias("_n"))
    met = listed.join(anchors(needles, needle, counts), "_piece").where(F.contains(holder, needle))
    return met.select(holder, needle).distinct()


def lowest_holder(needles: DataFrame, holders: DataFrame, needle: str, holder: str, payload: str) -> DataFrame:
    """``needle`` and the lowest ``payload`` of the names that contain it.

    Names of up to a piece's length take the lowest payload of the piece, so that a short
    name inside very many others meets one row a piece.
    """
    listed = postings(holders.where(F.col(payload).isNotNull()).groupBy(holder).agg(F.min(payload).alias(payload)), holder)
    counts = listed.groupBy("_piece").agg(F.count("*").alias("_n"), F.min(payload).alias(payload))
    asked = anchors(needles, needle, counts)
    short = F.length(needle) <= PIECE
    by_piece = asked.where(short).join(counts.select("_piece", payload), "_piece").select(needle, payload)
    by_name = asked.where(~short).join(listed, "_piece").where(F.contains(holder, needle)).select(needle, payload)
    return by_piece.unionByName(by_name).groupBy(needle).agg(F.min(payload).alias(payload))
