"""Document fingerprints: SpotSigs.

A signature is an anchor, a common word of a language, with the next ``2`` content words (words
that are no anchors) after it. The fingerprint is the set of the signatures' hashes (40
bits). Likeness of two texts is the Jaccard coefficient of their sets. ``near_pairs`` finds
all pairs above a threshold: sets are partitioned by their length so that partners lie in
the same or the next partition, a set's rarest hashes are its keys, and candidates are
compared only if their lengths allow the threshold.

Only DataFrame functions are used: anchors are bound to the content word that follows
them by one regular expression, and another reads the chains.

Cases: a null text is an empty one; an empty text has an empty fingerprint, and two empty
fingerprints are equal (likeness 1); the text's start counts as an anchor, so a text with a
word has a signature, and a text without words is its own signature; repeated keys are
ordered by text; a null key comes first; the only document is its own next one; an empty
table gives an empty table; input columns that are written anew are replaced.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from calendra.llm.common import without

#: Common words of English, French, German and Spanish.
ANCHORS = tuple(sorted(set(
    "a an and are as at be by for from in is it of on or that the this to was which with "
    "au aux avec ce dans de des du elle en est et il la le les ne par pas pour que qui se sur un une "
    "als auch auf das dem den der die ein eine einer er für im ist mit nicht sich sie und von zu "
    "al con como del el es las los no para por su una y".split()
)))
_ANY = "|".join(ANCHORS)
#: An anchor, bound to the word behind it by a bar; no group repeats, which would recurse.
_BIND = rf"(?<= )({_ANY}) "
#: The last anchor before a content word, this word, and the next one with its anchors.
_CHAIN = r"(?=[ |]([^ |]+\|[^ |]+(?= )(?: (?:[^ ]*\|)?[^ |]+(?= ))?))"
THRESHOLD = 0.75
MAX_BUCKETS = 4096


def fingerprint(text: Column) -> Column:
    """array<bigint>: the sorted set of a text's signature hashes."""
    words = F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", " ")
    bound = F.regexp_replace(F.concat(F.lit(" "), F.ltrim(words), F.lit(" ")), _BIND, r"$1|")
    chains = F.regexp_extract_all(F.regexp_replace(bound, r"^ (?=[^ |]+ )", " ^|"), F.lit(_CHAIN), F.lit(1))
    whole = F.when(F.size(chains) > 0, chains).when(F.length(text) > 0, F.array(text)).otherwise(F.array().cast("array<string>"))
    hashes = F.transform(whole, lambda s: F.shiftrightunsigned(F.xxhash64(F.regexp_replace(s, r" [^ ]+\|", " ")), 24))
    return F.coalesce(F.array_sort(F.array_distinct(hashes)), F.array().cast("array<bigint>"))


def likeness(left: Column, right: Column, least: float = 0.0) -> Column:
    """Jaccard of two sets; 0 without a look inside if their lengths exclude ``least``."""
    smaller, larger = F.least(F.size(left), F.size(right)), F.greatest(F.size(left), F.size(right))
    common = F.size(F.array_intersect(left, right))
    return (
        F.when(larger == 0, 1.0).when((smaller == 0) | (smaller < larger * least), 0.0)
        .otherwise(common / (smaller + larger - common))
    )


def as_text(hashes: Column) -> Column:
    return F.array_join(F.transform(hashes, lambda h: F.lower(F.hex(h))), ",")


def with_next(docs: DataFrame, value: str = "text", out: str = "next_text", key: str = "doc_id") -> DataFrame:
    """Adds the ``value`` of the row with the next key; after the last comes the first.

    The keys are cut into ranges of about equal numbers of rows. A row's next one lies in
    its range or is the first row of the next, so one row a range meets in one task.
    """
    docs = without(docs, out)
    wanted = min(MAX_BUCKETS, 8 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    shares = [i / wanted for i in range(1, wanted)]
    cuts = docs.agg(F.percentile_approx(key, shares, 100 * wanted)).first()[0] or []
    edges = F.array(*[F.lit(c) for c in sorted(set(cuts))]).cast("array<bigint>")
    bucket = F.when(F.col(key).isNull(), -1).otherwise(F.size(F.filter(edges, lambda c: c <= F.col(key))))
    docs = docs.withColumn("_bucket", bucket)
    row = F.struct(F.col(key).alias("k"), F.col(value).alias("v"))
    firsts = docs.groupBy("_bucket").agg(F.min(row).alias("_row"))
    order = W.orderBy("_bucket")
    head = F.first("_row").over(order.rowsBetween(W.unboundedPreceding, W.unboundedFollowing))
    after = firsts.select(F.col("_bucket").alias("_of"), F.coalesce(F.lead("_row").over(order), head)["v"].alias("_after"))
    inside = F.lead(F.struct(F.col(value).alias("v"))).over(W.partitionBy("_bucket").orderBy(key, value))
    linked = docs.withColumn("_inside", inside)
    last = (F.col("_bucket") == F.col("_of")) & F.col("_inside").isNull()
    return (
        linked.join(after, last, "left")
        .withColumn(out, F.when(F.col("_inside").isNull(), F.col("_after")).otherwise(F.col("_inside.v")))
        .drop("_bucket", "_of", "_inside", "_after")
    )


def edited(text: Column, other: Column) -> Column:
    """The text with its last half (rounded down) replaced by the other's first half as long."""
    n = F.length(text)
    half = F.floor(n / 2).cast("int")
    return F.concat(F.substring(text, F.lit(1), n - half), F.substring(other, F.lit(1), half))


def near_pairs(docs: DataFrame, threshold: float = THRESHOLD, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(a, b, likeness) of every pair of different fingerprints with this likeness or more.

    ``a`` and ``b`` are the smallest keys of their fingerprints; rows of equal fingerprints
    are one. Null and empty texts have no pairs.
    """
    sets = (
        docs.select(key, fingerprint(F.coalesce(F.col(text), F.lit(""))).alias("hashes"))
        .filter(F.size("hashes") > 0).groupBy("hashes").agg(F.min(key).alias("id"))
        .withColumn("n", F.size("hashes"))
    )
    # lengths of partners differ by the factor 1 / threshold at most: the same part or the next
    part = F.floor(F.log(F.col("n")) / math.log(1 / threshold) + 1e-9).cast("int")
    members = sets.withColumn("part", part).select("id", "n", "part", F.explode("hashes").alias("hash"))
    counts = members.groupBy("hash").agg(F.count("*").alias("times")).filter("times > 1")
    ranked = members.join(counts, "hash", "left").withColumn(
        "place", F.row_number().over(W.partitionBy("id").orderBy(F.coalesce("times", F.lit(1)), "hash"))
    )
    keys = ranked.filter((F.col("place") <= F.col("n") - F.ceil(F.col("n") * threshold) + 1) & F.col("times").isNotNull())
    left = keys.select("hash", F.col("id").alias("a"), F.col("n").alias("n_a"), F.explode(F.array("part", F.col("part") + 1)).alias("part"))
    right = keys.select("hash", F.col("id").alias("b"), F.col("n").alias("n_b"), "part")
    pairs = (
        left.join(right, ["hash", "part"])
        .filter((F.col("n_a") < F.col("n_b")) | ((F.col("n_a") == F.col("n_b")) & (F.col("a") < F.col("b"))))
        .filter(F.col("n_a") >= F.col("n_b") * threshold).select("a", "b").distinct()
    )
    return (
        pairs.join(sets.select(F.col("id").alias("a"), F.col("hashes").alias("x")), "a")
        .join(sets.select(F.col("id").alias("b"), F.col("hashes").alias("y")), "b")
        .select("a", "b", likeness(F.col("x"), F.col("y"), threshold).alias("likeness"))
        .filter(F.col("likeness") >= threshold)
    )
