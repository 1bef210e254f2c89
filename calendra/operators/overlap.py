"""Best row of another table by common tokens, without comparing all pairs.

Tokens are split by the number of names that have them. A pair of names with a rare common
token is found in that token's short posting list. What pairs have in common otherwise are
frequent tokens only: of these, each name holds its most frequent ones, names of equal held
tokens are one row, and the rows of the other side are kept as one best key for each subset
of held tokens. So a token in all names costs one row a name, never a row a pair.

The limits choose between two exact ways and change no result: a frequent token that a name
does not hold (it has many) is looked up in its posting list like a rare one.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from calendra.functions.grams import subsets

#: Names with a token from which it is frequent.
FREQUENT_FROM = 64
#: Frequent tokens that a name holds.
HELD = 10


def token_counts(named: DataFrame, frequent_from: int = FREQUENT_FROM) -> DataFrame:
    """The tokens that stand in ``frequent_from`` rows or more, and their number."""
    tokens = named.select(F.explode("tokens").alias("t"))
    return tokens.groupBy("t").agg(F.count("*").alias("df")).where(F.col("df") >= frequent_from)


def split_tokens(named: DataFrame, frequent: DataFrame, held: int = HELD) -> DataFrame:
    """Adds ``held`` (most frequent tokens, sorted) and ``rest`` (all others) to rows with a unique n."""
    known = named.select("n", F.explode("tokens").alias("t")).join(frequent, "t").groupBy("n").agg(
        F.slice(F.sort_array(F.collect_list(F.struct("df", "t")), asc=False), 1, held).alias("top")
    )
    tops = F.array_sort(F.coalesce(F.transform("top", lambda x: x["t"]), F.array().cast("array<string>")))
    return (
        named.join(known, "n", "left").withColumn("held", tops).drop("top")
        .withColumn("rest", F.array_except("tokens", "held"))
    )


def listed_pairs(left: DataFrame, right: DataFrame) -> DataFrame:
    """Pairs (l_…, r_…) that share a token which one of them does not hold."""

    def by_token(df: DataFrame, side: str, tokens: str) -> DataFrame:
        return df.select(*[F.col(c).alias(f"{side}_{c}") for c in df.columns if c not in ("held", "rest")], F.explode(tokens).alias("t"))

    out = by_token(left, "l", "rest").join(by_token(right, "r", "tokens"), "t").unionByName(
        by_token(left, "l", "held").join(by_token(right, "r", "rest"), "t")
    )
    return out.drop("t").distinct()


def held_best(left: DataFrame, right: DataFrame, score: Callable[[Column], Column], min_common: int, type_points: int) -> DataFrame:
    """n, score and key by the subsets of held tokens: one row a subset meets one row."""

    def subset_rows(df: DataFrame, *keep: str) -> DataFrame:
        return df.withColumn("s", F.explode(subsets(F.col("held")))).where(F.size("s") >= min_common).select("s", *keep)

    some = F.size("held") > 0
    groups = left.where(some).select("held", "first").distinct()
    asked = subset_rows(groups, "held", "first")
    kept = subset_rows(right.where(some).groupBy("held", "first").agg(F.min("key").alias("key")), "first", "key")
    plain = kept.groupBy("s").agg(F.min("key").alias("key"))
    met = asked.join(plain, "s").select("held", "first", score(F.col("s")).alias("score"), "key")
    if type_points:
        typed = kept.groupBy("s", "first").agg(F.min("key").alias("key"))
        met = met.unionByName(
            asked.join(typed, ["s", "first"]).select("held", "first", (score(F.col("s")) + type_points).alias("score"), "key")
        )
    best = met.groupBy("held", "first").agg(_highest().alias("b"))
    return left.join(best, ["held", "first"]).select("n", F.col("b.score").alias("score"), (-F.col("b.neg")).alias("key"))


def _highest() -> Column:
    return F.max(F.struct(F.col("score"), (-F.col("key")).alias("neg")))


def overlap_best(
    left: DataFrame, right: DataFrame, score: Callable[[Column], Column], min_common: int = 1, type_points: int = 0, *,
    held: int = HELD, frequent_from: int = FREQUENT_FROM,
) -> DataFrame:
    """Best right row per left name by common tokens: columns n, score, key.

    Both sides have a unique n, tokens (distinct) and first; right has a numeric key, of which
    the lowest wins ties. ``score`` maps the common tokens to points and must grow with them;
    rows of the same ``first`` get ``type_points`` more. Pairs that contain each other have
    a score of their own and take no part where they would beat it, which needs more than
    ``held`` common tokens or a listed one.
    """
    frequent = token_counts(right, frequent_from)
    lefts, rights = split_tokens(left, frequent, held), split_tokens(right, frequent, held)
    common = F.array_intersect("l_tokens", "r_tokens")
    same = F.when(F.col("l_first") == F.col("r_first"), type_points).otherwise(0)
    apart = ~(F.contains("l_n", F.col("r_n")) | F.contains("r_n", F.col("l_n")))
    listed = listed_pairs(lefts, rights).where(apart).withColumn("common", common).where(F.size("common") >= min_common).select(
        F.col("l_n").alias("n"), (score(F.col("common")) + same).alias("score"), F.col("r_key").alias("key"),
    )
    met = listed.unionByName(held_best(lefts, rights, score, min_common, type_points))
    return met.groupBy("n").agg(_highest().alias("b")).select(
        "n", F.col("b.score").alias("score"), (-F.col("b.neg")).alias("key")
    )
