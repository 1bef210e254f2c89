"""Distributions of rounded measures: exact quantiles, percentile ranks, breaks and bands.

All rules here share one intermediate, the *distribution frame*: per group one row for
each distinct value with its count ``n``, the number of values strictly ``below`` it and
the group ``total``. Building it never sorts raw rows and never gathers a group in one
task: rows are combined map-side into (group, value) counts, running counts are taken
inside segments of at most ``SEGMENT`` distinct values, and the segments of a group are
chained by their totals. Measures are rounded before they are ranked, so the number of
segments is bounded by the range of the measure and not by the number of rows.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from calendra.functions.numbers import round_to

SEGMENT = 1000


def distribution(
    df: DataFrame,
    groups: Sequence[str],
    value: str,
    digits: int = 2,
    lookups: DataFrame | None = None,
) -> DataFrame:
    """Distribution frame of ``value`` per group.

    ``lookups`` adds values that are to be ranked but do not count themselves; it must
    carry the group columns and ``value``.
    """
    groups = list(groups)
    rows = df.where(F.col(value).isNotNull()).select(
        *groups, F.col(value).alias("value"), F.lit(1).alias("one")
    )
    if lookups is not None:
        rows = rows.unionByName(
            lookups.where(F.col(value).isNotNull()).select(
                *groups, F.col(value).alias("value"), F.lit(0).alias("one")
            )
        )
    hist = rows.groupBy(*groups, "value").agg(F.sum("one").alias("n"))
    hist = hist.withColumn("seg", F.floor(F.col("value") / (SEGMENT / 10.0**digits)))
    return running_counts(hist, groups)


def running_counts(hist: DataFrame, groups: Sequence[str]) -> DataFrame:
    """Chain (group, seg, value, n) counts into ``below`` and ``total``."""
    groups = list(groups)
    chained = W.partitionBy(*groups).orderBy("seg")
    whole = W.partitionBy(*groups)
    offsets = (
        hist.groupBy(*groups, "seg")
        .agg(F.sum("n").alias("seg_n"))
        .select(
            *groups,
            "seg",
            (F.sum("seg_n").over(chained) - F.col("seg_n")).alias("seg_below"),
            F.sum("seg_n").over(whole).alias("total"),
        )
    )
    inside = W.partitionBy(*groups, "seg").orderBy("value")
    by = [*groups, "seg"]
    offsets = offsets.withColumnsRenamed({k: f"_j_{k}" for k in by})
    same = reduce(and_, [F.col(k).eqNullSafe(F.col(f"_j_{k}")) for k in by])
    return (
        hist.join(offsets, same)
        .withColumn(
            "below", F.col("seg_below") + F.sum("n").over(inside) - F.col("n")
        )
        .select(*groups, "value", "n", "below", "total")
    )


# --- index rules; each gives a zero-based position in the sorted values -------------


def floor_index(p: float) -> Column:
    return F.floor(F.lit(p) * (F.col("total") - 1))


def half_even_index(p: float) -> Column:
    return F.bround(F.lit(p) * (F.col("total") - 1))


def half_even_split(i: int, k: int) -> Column:
    return F.bround(F.lit(i) * (F.col("total") - 1) / F.lit(k))


def break_index(i: int, k: int) -> Column:
    return F.least(F.floor(F.col("total") * F.lit(i) / F.lit(k)), F.col("total") - 1)


def at_index(index: Column) -> Column:
    """Aggregate: the value at a position of the sorted group."""
    hit = (F.col("below") <= index) & (index < F.col("below") + F.col("n"))
    return F.max(F.when(hit, F.col("value")))


def median_agg() -> Column:
    low = at_index(F.floor((F.col("total") - 1) / 2))
    high = at_index(F.floor(F.col("total") / 2))
    return (low + high) / F.lit(2.0)


def mean_agg() -> Column:
    exact = F.sum(F.col("value").cast("decimal(18,2)") * F.col("n"))
    return exact.cast("double") / F.sum("n")


def summary(dist: DataFrame, groups: Sequence[str], digits: int = 2) -> DataFrame:
    """n, mean, median, p10 and p90 of each group of a distribution frame."""
    return dist.groupBy(*groups).agg(
        F.sum("n").alias("n"),
        round_to(mean_agg(), digits).alias("mean"),
        round_to(median_agg(), digits).alias("median"),
        at_index(floor_index(0.10)).alias("p10"),
        at_index(floor_index(0.90)).alias("p90"),
    )


def quantile_edges(dist: DataFrame, groups: Sequence[str], k: int) -> DataFrame:
    """k-1 interior edges as an array, each at least one above the edge before it."""
    picks = F.array(*[at_index(half_even_split(i, k)).cast("bigint") for i in range(1, k)])
    bumped = F.aggregate(
        F.col("raw"),
        F.expr("cast(array() as array<bigint>)"),
        lambda done, edge: F.concat(
            done,
            F.array(
                F.when(F.size(done) == 0, edge).otherwise(
                    F.greatest(edge, F.try_element_at(done, F.lit(-1)) + 1)
                )
            ),
        ),
    )
    raw = dist.groupBy(*groups).agg(picks.alias("raw"), F.sum("n").alias("total"))
    return raw.select(*groups, bumped.alias("edges"), "total")


def choropleth_breaks(dist: DataFrame, groups: Sequence[str], classes: int) -> DataFrame:
    picks = [at_index(break_index(i, classes)) for i in range(1, classes)]
    return dist.groupBy(*groups).agg(F.array(*picks).alias("breaks"))


def break_class(value: Column, breaks: Column) -> Column:
    """Number of breaks at or below the value; null for null."""
    return F.when(value.isNotNull(), F.size(F.filter(breaks, lambda b: value >= b)))


def percentile_rank(
    records: DataFrame,
    reference: DataFrame,
    groups: Sequence[str],
    value: str,
    out: str,
    digits: int = 2,
    lower_is_better: bool = False,
    lookups: DataFrame | None = None,
) -> DataFrame:
    """Share of the reference strictly below (or above) each record's value, one decimal.

    The records' values enter the distribution with weight zero, so any value can be
    looked up by equality; an empty reference ranks as 0. ``lookups`` is a cheaper table
    with the same values, where the records themselves are a long plan.
    """
    groups = list(groups)
    wanted = records if lookups is None else lookups
    dist = distribution(reference, groups, value, digits, lookups=wanted)
    beaten = (
        F.col("total") - F.col("below") - F.col("n") if lower_is_better else F.col("below")
    )
    share = F.when(F.col("total") == 0, F.lit(0.0)).otherwise(
        round_to(F.lit(100.0) * beaten / F.col("total"), 1)
    )
    ranks = dist.select(*groups, F.col("value").alias(value), share.alias(out))
    return records.join(ranks, [*groups, value], "left")


def unpivot_measures(df: DataFrame, keys: Sequence[str], measures: Sequence[str]) -> DataFrame:
    """Long form (keys, measure, value) without null values."""
    return df.unpivot(list(keys), list(measures), "measure", "value").where(
        F.col("value").isNotNull()
    )


def area_medians(
    units: DataFrame, keys: Sequence[str], levels: Sequence[str], measures: Sequence[str]
) -> DataFrame:
    """Median and count per measure for the whole country and for each level's areas.

    Raw units are counted once at the finest grain; coarser levels are summed from those
    counts. Blank areas are left out at their level.
    """
    groups = [*keys, "level", "area", "measure"]
    return (
        area_frame(units, keys, levels, measures)
        .groupBy(*groups)
        .agg(round_to(median_agg(), 2).alias("median"), F.sum("n").alias("n"))
    )


def area_frame(
    units: DataFrame, keys: Sequence[str], levels: Sequence[str], measures: Sequence[str], lookups: DataFrame | None = None,
) -> DataFrame:
    """One distribution frame of all measures for the whole country and each level's areas.

    Its groups are keys, ``level``, ``area`` and ``measure``, so one frame answers summaries,
    medians and ranks alike. Units are counted once at the finest grain and coarser levels
    are summed from these counts. ``lookups`` (keys and measures) adds values that are ranked
    in the whole country without counting. Null and blank areas are left out at their level.
    """
    keys, levels = list(keys), list(levels)
    fine = unpivot_measures(units, [*keys, *levels], measures).groupBy(*keys, *levels, "measure", "value").agg(F.count(F.lit(1)).alias("n"))
    places = F.array(
        F.struct(F.lit("country").alias("level"), F.lit("*").alias("area")),
        *[F.struct(F.lit(name).alias("level"), F.trim(F.col(name)).alias("area")) for name in levels],
    )
    columns = [*keys, "level", "area", "measure", "value", "n"]
    rows = fine.withColumn("place", F.explode(places)).select(*keys, "place.level", "place.area", "measure", "value", "n").where("area <> ''")
    if lookups is not None:
        asked = unpivot_measures(lookups, keys, measures).withColumns({"level": F.lit("country"), "area": F.lit("*"), "n": F.lit(0).cast("bigint")})
        rows = rows.select(*columns).unionByName(asked.select(*columns))
    groups = [*keys, "level", "area", "measure"]
    hist = rows.groupBy(*groups, "value").agg(F.sum("n").alias("n")).withColumn("seg", F.floor(F.col("value") / (SEGMENT / 100.0)))
    return running_counts(hist, groups)


def medians_by_key(medians: DataFrame, keys: Sequence[str], measures: Sequence[str]) -> DataFrame:
    """keys and ``areas``: a map from level and area to its medians, one small row a key.

    The map is bounded by the number of areas, so records need one join for all levels.
    """
    wide = medians.groupBy(*keys, "level", "area").agg(
        F.struct(*[F.max(F.when(F.col("measure") == m, F.col("median"))).alias(m) for m in measures]).alias("medians")
    )
    entry = F.struct(F.concat_ws("|", "level", "area"), "medians")
    return wide.groupBy(*keys).agg(F.map_from_entries(F.collect_list(entry)).alias("areas"))


def median_of(level: str, area: Column, measure: str) -> Column:
    """A median out of ``areas``; null where there is none."""
    return F.try_element_at("areas", F.concat_ws("|", F.lit(level), F.trim(area)))[measure]


def ranks_by_value(frame: DataFrame, keys: Sequence[str]) -> DataFrame:
    """keys, measure, value, and the shares of the country strictly ``below`` and ``above`` it, one decimal."""
    whole = frame.where("level = 'country'")

    def share(beaten: Column) -> Column:
        return F.when(F.col("total") == 0, F.lit(0.0)).otherwise(round_to(F.lit(100.0) * beaten / F.col("total"), 1))

    above = F.col("total") - F.col("below") - F.col("n")
    return whole.select(*keys, "measure", "value", share(F.col("below")).alias("below"), share(above).alias("above"), "total")


# --- classes and messages over already computed numbers -----------------------------

# Target share, dead bands and rank bands.
TARGET_PCT = 65.0
POINT_BAND = 0.05
COST_BAND = 0.5
PERCENT_BAND = 2.0
RANK_BANDS = (100, 250, 500, 1000, 2000)
HOOK_TOP = "Tra i migliori in Italia (meglio del %.0f%%)"
HOOK_BELOW = "A -%.1f punti percentuali dall'obiettivo nazionale del 65%%"
HOOK_MET = "Obiettivo 65%% raggiunto · %+.1f punti percentuali"


def pct_vs_median(value: Column, median: Column, label: str) -> Column:
    """Signed whole-percent text against a median; null without a positive median."""
    pct = F.lit(100.0) * (value - median) / median
    whole = F.floor(F.abs(pct) + 0.5).cast("string")
    return F.when(
        (median > 0) & value.isNotNull(),
        F.when(F.abs(pct) < PERCENT_BAND, F.lit(f"in linea con {label}"))
        .when(pct > 0, F.concat(F.lit("+"), whole, F.lit(f"% vs {label}")))
        .otherwise(F.concat(F.lit("−"), whole, F.lit(f"% vs {label}"))),
    )


def tone(delta: Column, lower_is_better: bool, band: float) -> Column:
    better = delta < 0 if lower_is_better else delta > 0
    return (
        F.when(delta.isNull(), F.lit(""))
        .when(F.abs(delta) < band, F.lit("in-line"))
        .when(better, F.lit("good"))
        .otherwise(F.lit("bad"))
    )


def rank_band(pctile: Column, n: Column) -> Column:
    """National band of a percentile: best bands, then worst bands, then halves."""
    best = F.greatest(F.lit(1), F.floor(n * (1 - pctile / 100) + 0.5))
    worst = F.greatest(F.lit(1), n - best + 1)
    band = F.when(pctile.isNull() | (n <= 0), F.lit("none"))
    for limit in RANK_BANDS:
        band = band.when(best <= limit, F.lit(f"top-{limit}"))
    for limit in RANK_BANDS:
        band = band.when(worst <= limit, F.lit(f"last-{limit}"))
    return band.when(pctile >= 50, F.lit("upper-half")).otherwise(F.lit("lower-half"))


def headline(rd: Column, pctile: Column) -> Column:
    """Struct (key, text): top percentile first, then below or above the target."""
    gap = round_to(rd - F.lit(TARGET_PCT), 1)

    def hook(key: str, text: str, number: Column) -> Column:
        return F.struct(F.lit(key).alias("key"), F.format_string(text, number).alias("text"))

    return (
        F.when(pctile >= 90, hook("top_pctile", HOOK_TOP, pctile))
        .when(rd < TARGET_PCT, hook("below_target", HOOK_BELOW, F.abs(gap)))
        .otherwise(hook("target_met", HOOK_MET, gap))
    )


def year_series(units: DataFrame, key: str, value: str) -> DataFrame:
    """Per key a map year → value and the delta last − first fixed year, if both exist."""
    pairs = F.array_sort(F.collect_list(F.struct(F.col("year").cast("string"), F.col(value))))
    return units.where(F.col(value).isNotNull()).groupBy(key).agg(
        F.map_from_entries(pairs).alias("series")
    )


def series_delta(series: Column, first: int, last: int, digits: int = 2) -> Column:
    return round_to(series[str(last)] - series[str(first)], digits)


def trend(units: DataFrame, key: str, value: str) -> DataFrame:
    """Year series relabelled by years ago, with direction and padded bounds.

    A key has one row per year, so its window partition stays small.
    """
    by_key = W.partitionBy(key)
    newest = by_key.orderBy(F.col("year").desc())
    span = by_key.orderBy("year").rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    first, last = F.first(value).over(span), F.last(value).over(span)
    low, high = F.min(value).over(by_key), F.max(value).over(by_key)
    pad = F.greatest((high - low) * F.lit(0.35), F.lit(0.9))
    ago = F.row_number().over(newest) - 1
    return units.where(F.col(value).isNotNull()).select(
        key,
        "year",
        F.col(value).alias("value"),
        F.when(ago == 0, F.lit("ultimo"))
        .when(ago == 1, F.lit("−1 anno"))
        .otherwise(F.concat(F.lit("−"), ago, F.lit(" anni")))
        .alias("label"),
        F.when(last > first + POINT_BAND, F.lit("up"))
        .when(last < first - POINT_BAND, F.lit("down"))
        .otherwise(F.lit(""))
        .alias("direction"),
        (low - pad).alias("low"),
        (high + pad).alias("high"),
    )


# --- mix shares ---------------------------------------------------------------------


def mix_items(shares: DataFrame, key: str) -> DataFrame:
    """Ranked mix parts per key plus the residual ``altro`` when at least 0.5.

    Input is long (key, part, share); the number of parts is a small fixed vocabulary.
    """
    known = shares.where(F.col("share").isNotNull())
    rest = (
        known.groupBy(key)
        .agg(F.greatest(F.lit(0.0), F.lit(100.0) - F.sum("share")).alias("share"))
        .where(F.col("share") >= 0.5)
        .select(key, F.lit("altro").alias("part"), "share", F.lit(1).alias("residual"))
    )
    order = W.partitionBy(key).orderBy("residual", F.col("share").desc(), "part")
    return (
        known.select(key, "part", "share", F.lit(0).alias("residual"))
        .unionByName(rest)
        .withColumn("pos", F.row_number().over(order))
        .drop("residual")
    )


def top_part(shares: DataFrame, key: str) -> DataFrame:
    """Largest part per key and its tenths, clamped to 1..10."""
    best = F.max(F.struct(F.col("share"), F.col("part")))
    return (
        shares.where(F.col("share").isNotNull())
        .groupBy(key)
        .agg(best.alias("best"))
        .select(
            key,
            F.col("best.part").alias("part"),
            F.col("best.share").alias("share"),
            F.greatest(
                F.lit(1), F.least(F.lit(10), F.floor(F.col("best.share") / 10 + 0.5))
            ).cast("int").alias("tenths"),
        )
    )


def ranked(df: DataFrame, groups: Sequence[str], value: str, key: str, higher_better: bool = True) -> DataFrame:
    """Rank of areas on a measure with the number ranked; ties follow the key.

    Meant for area-level tables (one row per province), not for base rows.
    """
    order = F.col(value).desc() if higher_better else F.col(value).asc()
    w = W.partitionBy(*groups)
    return df.where(F.col(value).isNotNull()).select(
        "*",
        F.row_number().over(w.orderBy(order, key)).alias("rank"),
        F.count(F.lit(1)).over(w).alias("ranked"),
    )
