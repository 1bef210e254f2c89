"""Boundaries and weighted roll-ups through the geographic hierarchy."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from calendra.functions.numbers import round_to
from calendra.functions.text import index_letter
from calendra.operators.scans import previous_row, running_sum

# Macro-area of each region slug, and the sphere radius in metres.
MACRO_AREAS = {
    "piemonte": "nord", "valle-d-aosta": "nord", "liguria": "nord", "lombardia": "nord",
    "trentino-alto-adige": "nord", "veneto": "nord", "friuli-venezia-giulia": "nord",
    "emilia-romagna": "nord",
    "toscana": "centro", "umbria": "centro", "marche": "centro", "lazio": "centro",
    "abruzzo": "sud", "molise": "sud", "campania": "sud", "puglia": "sud",
    "basilicata": "sud", "calabria": "sud", "sicilia": "sud", "sardegna": "sud",
}
RADIUS_M = 6378137.0


def composite_code(region_code: Column, local_code: Column) -> Column:
    return F.concat(region_code.cast("string"), local_code.cast("string"))


def attach_measures(boundaries: DataFrame, records: DataFrame, code: str) -> DataFrame:
    """Boundary rows with their record as JSON without null fields; name alone if unmatched."""
    fields = [c for c in records.columns if c != code]
    return boundaries.join(records, code, "left").select(
        code, F.to_json(F.struct("name", *fields)).alias("properties")
    )


def weighted_mean(value: str, weight: str, digits: int = 2) -> Column:
    """Aggregate: mean weighted by people, skipping null values and weights not above 0.

    Sums are exact decimals, so the result does not depend on the order of the rows.
    """
    counted = F.col(value).isNotNull() & (F.col(weight) > 0)
    num = F.sum(F.when(counted, F.col(value).cast("decimal(18,4)") * F.col(weight)))
    den = F.sum(F.when(counted, F.col(weight)))
    return round_to(num.cast("double") / F.nullif(den, F.lit(0)), digits)


def area_measures(measures: Sequence[str], weight: str = "pop", rd: str = "rd_pct") -> list[Column]:
    return [
        F.nullif(F.sum(F.coalesce(F.col(weight), F.lit(0))), F.lit(0)).alias("pop"),
        F.count(F.lit(1)).alias("municipalities"),
        F.count(rd).alias("with_rd"),
        *[weighted_mean(m, weight).alias(m) for m in measures],
    ]


def roll_up(base: DataFrame, levels: Sequence[str], measures: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """All levels of the hierarchy from base rows in one pass of grouping sets.

    ``levels`` runs from coarse to fine. ``level`` numbers the result: 0 is everything.
    """
    levels, by = list(levels), list(by)
    sets = [[*by, *levels[:i]] for i in range(len(levels), -1, -1)]
    depth = F.lit(0)
    for name in levels:
        depth = depth + (1 - F.grouping(name).cast("int"))
    return base.groupingSets(sets, *by, *levels).agg(
        depth.alias("level"), *area_measures(measures)
    )


def with_macro(regions: DataFrame, slug: str, mapping: dict[str, str]) -> DataFrame:
    """Macro-area per region from a small fixed mapping; unknown regions are null."""
    lookup = F.create_map(*[F.lit(x) for pair in mapping.items() for x in pair])
    return regions.withColumn("macro", F.try_element_at(lookup, F.col(slug)))


def unknown_regions(regions: DataFrame, slug: str, mapping: dict[str, str]) -> DataFrame:
    return with_macro(regions, slug, mapping).where("macro IS NULL").drop("macro")


def decode_arcs(
    arcs: DataFrame, scale: tuple[float, float], translate: tuple[float, float], bucket: int = 4096
) -> DataFrame:
    """Delta-coded arc points to coordinates: running sums, then scale and translate."""
    summed = running_sum(
        arcs, ["arc_id"], ["pos"], {"dx": "x", "dy": "y"}, F.floor(F.col("pos") / bucket)
    )
    return summed.select(
        "arc_id", "pos",
        (F.lit(translate[0]) + F.lit(scale[0]) * F.col("x")).alias("lon"),
        (F.lit(translate[1]) + F.lit(scale[1]) * F.col("y")).alias("lat"),
    )


def assemble_rings(rings: DataFrame, points: DataFrame, bucket: int = 4096) -> DataFrame:
    """Ring points from signed arc lists (feature_id, ring, ring_pos, arc_id).

    A negative arc id is the complement of an arc walked backwards. A joint point shared
    with the arc before is dropped. Points are ordered by (ring_pos, point_pos), so no
    ring is numbered in one task.
    """
    backwards = F.col("arc_id") < 0
    refs = rings.withColumn("backwards", backwards).withColumn(
        "arc", F.when(backwards, F.bitwise_not("arc_id")).otherwise(F.col("arc_id"))
    )
    point = F.struct("lon", "lat")
    ends = points.groupBy(F.col("arc_id").alias("arc")).agg(
        F.min_by(point, F.col("pos")).alias("head"),
        F.max_by(point, F.col("pos")).alias("tail"),
        F.min("pos").alias("lo"),
        F.max("pos").alias("hi"),
    )
    oriented = refs.join(ends, "arc").select(
        "feature_id", "ring", "ring_pos", "arc", "backwards",
        F.when(F.col("backwards"), F.col("tail")).otherwise(F.col("head")).alias("first"),
        F.when(F.col("backwards"), F.col("head")).otherwise(F.col("tail")).alias("last"),
        F.when(F.col("backwards"), F.col("hi")).otherwise(F.col("lo")).alias("first_pos"),
    )
    chained = previous_row(
        oriented, ["feature_id", "ring"], ["ring_pos"], ["last"], F.floor(F.col("ring_pos") / bucket)
    ).withColumn("joint", F.coalesce(F.col("prev.last") == F.col("first"), F.lit(False)))
    return (
        chained.join(points.withColumnRenamed("arc_id", "arc"), "arc")
        .where(~(F.col("joint") & (F.col("pos") == F.col("first_pos"))))
        .select(
            "feature_id", "ring", "ring_pos",
            F.when(F.col("backwards"), -F.col("pos")).otherwise(F.col("pos")).alias("point_pos"),
            "lon", "lat",
        )
    )


def ring_edges(points: DataFrame, keys: Sequence[str], order: Sequence[str], bucket: Column) -> DataFrame:
    """Consecutive point pairs of each ring; ``prev`` holds the point before."""
    return previous_row(points, keys, order, ["lon", "lat"], bucket).where("prev IS NOT NULL")


def ring_areas(points: DataFrame, keys: Sequence[str], order: Sequence[str], bucket: Column) -> DataFrame:
    """Spherical area of each closed ring in km²; rings under three points have none."""
    lat1, lat2 = F.radians("prev.lat"), F.radians("lat")
    piece = (F.radians("lon") - F.radians("prev.lon")) * (2.0 + F.sin(lat1) + F.sin(lat2))
    km2 = F.abs(F.sum(piece) * (RADIUS_M * RADIUS_M) / 2.0) / 1e6
    edges = ring_edges(points, keys, order, bucket)
    return edges.groupBy(*keys).agg(F.when(F.count(F.lit(1)) >= 2, km2).otherwise(0.0).alias("km2"))


def feature_areas(rings: DataFrame, feature: str, is_hole: str) -> DataFrame:
    """Outer rings minus holes, rounded to 0.1 km²."""
    signed = F.when(F.col(is_hole), -F.col("km2")).otherwise(F.col("km2"))
    return rings.groupBy(feature).agg(round_to(F.sum(signed), 1).alias("km2"))


def density(pop: Column, km2: Column, known: Column | None = None) -> Column:
    fresh = F.when((pop > 0) & (km2 > 0), round_to(pop / km2, 1))
    return fresh if known is None else F.coalesce(known, fresh)


def label_points(
    points: DataFrame, feature: str, ring: str, order: Sequence[str], bucket: Column
) -> DataFrame:
    """Centroid of each feature's largest outer ring."""
    x1, y1, x2, y2 = F.col("prev.lon"), F.col("prev.lat"), F.col("lon"), F.col("lat")
    cross = x1 * y2 - x2 * y1
    sums = (
        ring_edges(points, [feature, ring], order, bucket)
        .groupBy(feature, ring)
        .agg(
            F.sum(cross).alias("a"),
            F.sum((x1 + x2) * cross).alias("cx"),
            F.sum((y1 + y2) * cross).alias("cy"),
        )
        .where(F.abs("a") > 1e-8)
    )
    centre = F.struct(
        (F.col("cx") / (3 * F.col("a"))).alias("lon"), (F.col("cy") / (3 * F.col("a"))).alias("lat")
    )
    # Among equal rings the first wins.
    size = F.struct(F.abs("a"), -F.col(ring))
    return sums.groupBy(feature).agg(F.max_by(centre, size).alias("p")).select(feature, "p.lon", "p.lat")


def outline_arcs(uses: DataFrame, group: str, arc: str) -> DataFrame:
    """Arcs used once inside a group: its outer border without shared inner lines."""
    undirected = F.when(F.col(arc) < 0, F.bitwise_not(arc)).otherwise(F.col(arc))
    return (
        uses.groupBy(group, undirected.alias(arc))
        .agg(F.count(F.lit(1)).alias("n"))
        .where("n = 1")
        .drop("n")
    )


def regions_of(regions: DataFrame, macro: str) -> DataFrame:
    return regions.where(F.col("macro") == macro)


def provinces_or_region(asked: DataFrame, provinces: DataFrame, regions: DataFrame) -> DataFrame:
    """Provinces of each asked region; the region itself where it has none.

    Unknown regions give no row, which is the deep link check.
    """
    known = asked.join(regions, "region", "left_semi").select("region").distinct()
    inside = known.join(provinces, "region").select("region", F.col("province").alias("area"), F.lit("province").alias("kind"))
    alone = known.join(provinces, "region", "left_anti").select(
        "region", F.col("region").alias("area"), F.lit("region").alias("kind")
    )
    return inside.unionByName(alone)


def hierarchy_counts(directory: DataFrame, unnamed: str = "Altro") -> DataFrame:
    """Municipalities, provinces and calendars per region and per province.

    Members are first combined to one row per (region, province).
    """

    def named(c: str) -> Column:
        return F.coalesce(F.nullif(F.trim(F.col(c)), F.lit("")), F.lit(unnamed))

    per_province = directory.groupBy(named("region").alias("region"), named("province").alias("province")).agg(
        F.count(F.lit(1)).alias("municipalities"), F.count_if("has_calendar").alias("with_calendar")
    )
    return (
        per_province.rollup("region", "province")
        .agg(
            (2 - F.grouping("region").cast("int") - F.grouping("province").cast("int")).alias("level"),
            F.sum("municipalities").alias("municipalities"),
            F.count(F.lit(1)).alias("provinces"),
            F.sum("with_calendar").alias("with_calendar"),
        )
    )


def alphabetic_index(names: DataFrame, name: str) -> DataFrame:
    """Rows in index order with their letter and the size of the letter's group."""
    lettered = names.withColumn("letter", index_letter(F.col(name)))
    sizes = lettered.groupBy("letter").agg(F.count(F.lit(1)).alias("letter_size"))
    return lettered.join(sizes, "letter").orderBy("letter", name)
