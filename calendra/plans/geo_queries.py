"""Geography queries: roll-ups of units, and boundaries derived from events and orders."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from calendra.functions.numbers import round_to
from calendra.operators import geo as G
from calendra.plans import views as V
from calendra.plans.registry import query
from calendra.plans.views import UNIT, r

MEASURES = ("rd_pct", "kg_ru", "kg_ind", "cost")


def wm(v: str) -> str:
    ok = f"{v} IS NOT NULL AND pop > 0"
    return r(
        f"CAST(sum(CAST({v} AS DECIMAL(18,4)) * pop) FILTER ({ok}) AS DOUBLE) / nullif(sum(pop) FILTER ({ok}), 0)", 2
    )


AGG = f"""CAST(sum(pop) AS BIGINT) AS pop, count(*) AS municipalities, count(rd_pct) AS with_rd,
  {', '.join(f"{wm(m)} AS {m}" for m in MEASURES)}"""


@query(
    "k01_boundary_join",
    f"""WITH {UNIT}
    SELECT code, '{{"name":"' || name || '"' || coalesce(',"rd":' || rd, '') || coalesce(',"n":' || n, '') || '}}' AS properties FROM (
      SELECT n_nationkey || '-' || n_regionkey AS code, n_name AS name, n, rd FROM nation LEFT JOIN
        (SELECT province, count(*) AS n, CAST(floor(avg(rd_pct)) AS BIGINT) AS rd FROM unit GROUP BY 1)
      ON province = n_name AND n_nationkey % 5 <> 0)""",
)
def k01(spark: SparkSession, sf: str) -> DataFrame:
    nation = V.table(spark, sf, "nation")
    code = G.composite_code(F.concat("n_nationkey", F.lit("-")), F.col("n_regionkey"))
    boundaries = nation.select(code.alias("code"), F.col("n_name").alias("name"))
    # records of every fifth nation carry a code that no boundary has
    other = F.when(F.col("n_nationkey") % 5 == 0, 90).otherwise(0) + F.col("n_regionkey")
    codes = nation.select(
        G.composite_code(F.concat("n_nationkey", F.lit("-")), other).alias("code"), F.col("n_name").alias("province")
    )
    records = (
        V.unit(spark, sf)
        .groupBy("province")
        .agg(F.floor(F.avg("rd_pct")).alias("rd"), F.count(F.lit(1)).alias("n"))
        .join(codes, "province")
        .select("code", "rd", "n")
    )
    return G.attach_measures(boundaries, records, "code")


@query(
    "k02_weighted_mean",
    f"""SELECT l_suppkey AS supplier, {r("CAST(sum(CAST(l_discount AS DECIMAL(18,4)) * CAST(l_quantity AS BIGINT)) AS DOUBLE) / nullif(sum(CAST(l_quantity AS BIGINT)), 0)", 2)} AS discount
    FROM lineitem GROUP BY 1""",
)
def k02(spark: SparkSession, sf: str) -> DataFrame:
    rows = V.table(spark, sf, "lineitem").select(
        F.col("l_suppkey").alias("supplier"), "l_discount", F.col("l_quantity").cast("bigint").alias("w")
    )
    return rows.groupBy("supplier").agg(G.weighted_mean("l_discount", "w").alias("discount"))


@query("k03_area_aggregate", f"WITH {UNIT} SELECT year, province, {AGG} FROM unit GROUP BY 1, 2")
def k03(spark: SparkSession, sf: str) -> DataFrame:
    return V.unit(spark, sf).groupBy("year", "province").agg(*G.area_measures(MEASURES))


@query(
    "k04_multi_level_rollup",
    f"""WITH {UNIT}
    SELECT year, macro, region, province, CAST(3 - grouping(macro) - grouping(region) - grouping(province) AS INTEGER) AS level, {AGG}
    FROM unit GROUP BY GROUPING SETS ((year, macro, region, province), (year, macro, region), (year, macro), (year))""",
)
def k04(spark: SparkSession, sf: str) -> DataFrame:
    return G.roll_up(V.unit(spark, sf), ["macro", "region", "province"], MEASURES, ["year"])


# The sample regions' macro-areas; one region is left unknown on purpose.
SAMPLE_MACRO = {"africa": "sud", "america": "nord", "asia": "centro", "europe": "nord"}


@query(
    "k05_macro_mapping",
    """SELECT r_name AS region, CASE lower(r_name) WHEN 'africa' THEN 'sud' WHEN 'america' THEN 'nord' WHEN 'asia' THEN 'centro'
      WHEN 'europe' THEN 'nord' END AS macro, count(n_name) AS provinces FROM region LEFT JOIN nation ON n_regionkey = r_regionkey GROUP BY 1, 2""",
)
def k05(spark: SparkSession, sf: str) -> DataFrame:
    regions = V.table(spark, sf, "region").withColumn("slug", F.lower("r_name"))
    nation = V.table(spark, sf, "nation")
    mapped = G.with_macro(regions, "slug", SAMPLE_MACRO)
    return (
        mapped.join(nation, F.col("n_regionkey") == F.col("r_regionkey"), "left")
        .groupBy(F.col("r_name").alias("region"), "macro")
        .agg(F.count("n_name").alias("provinces"))
    )


@query(
    "k05_unknown_regions",
    "SELECT r_regionkey, r_name, lower(r_name) AS slug FROM region WHERE lower(r_name) NOT IN ('africa', 'america', 'asia', 'europe')",
)
def k05_unknown(spark: SparkSession, sf: str) -> DataFrame:
    regions = V.table(spark, sf, "region").withColumn("slug", F.lower("r_name"))
    return G.unknown_regions(regions, "slug", SAMPLE_MACRO)


# Arcs: one per user, one delta per event.
ARCS = """arcs AS (SELECT user_id AS arc_id, event_id AS pos,
  CAST(regexp_extract(props, '(\\d+)', 1) AS INTEGER) - 50 AS dx, length(event_type) - 5 AS dy FROM events),
pts AS (SELECT arc_id, pos, 7e0 + 0.001e0 * sum(dx) OVER w AS lon, 45e0 + 0.002e0 * sum(dy) OVER w AS lat
  FROM arcs WINDOW w AS (PARTITION BY arc_id ORDER BY pos))"""
SCALE, TRANSLATE = (0.001, 0.002), (7.0, 45.0)


def arcs(spark: SparkSession, sf: str) -> DataFrame:
    return V.table(spark, sf, "events").select(
        F.col("user_id").alias("arc_id"),
        F.col("event_id").alias("pos"),
        (F.regexp_extract("props", r"(\d+)", 1).cast("int") - 50).alias("dx"),
        (F.length("event_type") - 5).alias("dy"),
    )


def points(spark: SparkSession, sf: str) -> DataFrame:
    return G.decode_arcs(arcs(spark, sf), SCALE, TRANSLATE, bucket=1024)


@query("k06_decode_arcs", f"WITH {ARCS} SELECT arc_id, pos, lon, lat FROM pts")
def k06(spark: SparkSession, sf: str) -> DataFrame:
    return points(spark, sf)


# A ring walks an arc, the same arc back, and the next arc of the feature.
RINGS = """ids AS (SELECT DISTINCT user_id AS a FROM events),
rings AS (SELECT a % 10 AS feature_id, 0 AS ring, a * 2 AS ring_pos, a AS arc_id FROM ids
  UNION ALL SELECT a % 10, 0, a * 2 + 1, -a - 1 FROM ids)"""


def rings(spark: SparkSession, sf: str) -> DataFrame:
    ids = V.table(spark, sf, "events").select(F.col("user_id").alias("a")).distinct()
    a = F.col("a")
    walk = F.array(
        F.struct((a * 2).alias("ring_pos"), a.alias("arc_id")),
        F.struct((a * 2 + 1).alias("ring_pos"), F.bitwise_not(a).alias("arc_id")),
    )
    return ids.select((a % 10).alias("feature_id"), F.lit(0).alias("ring"), F.explode(walk).alias("w")).select(
        "feature_id", "ring", "w.*"
    )


@query(
    "k07_assemble_rings",
    f"""WITH {ARCS}, {RINGS},
    o AS (SELECT feature_id, ring, ring_pos, lon, lat, CASE WHEN rings.arc_id < 0 THEN -pos ELSE pos END AS point_pos,
      row_number() OVER (PARTITION BY feature_id, ring, ring_pos ORDER BY CASE WHEN rings.arc_id < 0 THEN -pos ELSE pos END) AS rn
      FROM rings JOIN pts ON pts.arc_id = CASE WHEN rings.arc_id < 0 THEN -rings.arc_id - 1 ELSE rings.arc_id END),
    l AS (SELECT *, lag((lon, lat)) OVER (PARTITION BY feature_id, ring ORDER BY ring_pos, point_pos) AS p FROM o)
    SELECT feature_id, ring, ring_pos, point_pos, lon, lat FROM l WHERE NOT (rn = 1 AND p IS NOT NULL AND p = (lon, lat))""",
)
def k07(spark: SparkSession, sf: str) -> DataFrame:
    return G.assemble_rings(rings(spark, sf), points(spark, sf), bucket=64)


@query(
    "k08_round_coordinates",
    """SELECT vec_id, CAST(i AS INTEGER) AS i, floor(CAST(embedding[i + 1] AS DOUBLE) * 1e4 + 0.5e0) / 1e4 AS x
    FROM embeddings, (SELECT unnest(range(len(embedding))) AS i, vec_id AS v FROM embeddings) u WHERE v = vec_id""",
)
def k08(spark: SparkSession, sf: str) -> DataFrame:
    rounded = F.transform("embedding", lambda x: round_to(x.cast("double"), 4))
    return V.table(spark, sf, "embeddings").select("vec_id", F.posexplode(rounded).alias("i", "x"))


# Closed rings: a feature per nation, a ring per segment, one point per customer.
SHAPES = """p0 AS (SELECT c_nationkey AS feature, ascii(c_mktsegment) % 3 AS ring, c_custkey AS pos,
  CAST(floor(c_acctbal) AS DOUBLE) / 1000 AS lon, CAST(c_custkey % 89 AS DOUBLE) AS lat FROM customer),
shp AS (SELECT * FROM p0 UNION ALL
  SELECT feature, ring, max(pos) + 1, arg_min(lon, pos), arg_min(lat, pos) FROM p0 GROUP BY 1, 2),
edg AS (SELECT *, lag(lon) OVER w AS x1, lag(lat) OVER w AS y1 FROM shp WINDOW w AS (PARTITION BY feature, ring ORDER BY pos)),
area AS (SELECT feature, ring, CASE WHEN count(x1) >= 2 THEN
  abs(sum((radians(lon) - radians(x1)) * (2e0 + sin(radians(y1)) + sin(radians(lat)))) * (6378137e0 * 6378137e0) / 2e0) / 1e6 ELSE 0e0 END AS km2
  FROM edg WHERE x1 IS NOT NULL GROUP BY 1, 2)"""


def shapes(spark: SparkSession, sf: str) -> DataFrame:
    p = V.table(spark, sf, "customer").select(
        F.col("c_nationkey").alias("feature"),
        (F.ascii("c_mktsegment") % 3).alias("ring"),
        F.col("c_custkey").alias("pos"),
        (F.floor("c_acctbal").cast("double") / 1000).alias("lon"),
        (F.col("c_custkey") % 89).cast("double").alias("lat"),
    )
    closing = p.groupBy("feature", "ring").agg(
        (F.max("pos") + 1).alias("pos"), F.min_by("lon", "pos").alias("lon"), F.min_by("lat", "pos").alias("lat")
    )
    return p.unionByName(closing)


def ring_bucket():
    return F.floor(F.col("pos") / 1024)


@query("k09_ring_area", f"WITH {SHAPES} SELECT feature, CAST(ring AS INTEGER) AS ring, {r('km2', 1)} AS km2 FROM area")
def k09(spark: SparkSession, sf: str) -> DataFrame:
    areas = G.ring_areas(shapes(spark, sf), ["feature", "ring"], ["pos"], ring_bucket())
    return areas.withColumn("km2", round_to("km2", 1))


@query(
    "k10_density",
    f"""WITH {SHAPES}, a AS (SELECT feature, {r("sum(CASE WHEN ring = 2 THEN -km2 ELSE km2 END)", 1)} AS km2 FROM area GROUP BY 1),
    p AS (SELECT c_nationkey, count(*) * 1000 AS pop FROM customer GROUP BY 1)
    SELECT feature, km2, CASE WHEN km2 > 0 THEN {r("pop / km2", 1)} END AS density FROM a JOIN p ON c_nationkey = feature""",
)
def k10(spark: SparkSession, sf: str) -> DataFrame:
    rings_km2 = G.ring_areas(shapes(spark, sf), ["feature", "ring"], ["pos"], ring_bucket())
    km2 = G.feature_areas(rings_km2.withColumn("hole", F.col("ring") == 2), "feature", "hole")
    pop = V.table(spark, sf, "customer").groupBy(F.col("c_nationkey").alias("feature")).agg(
        (F.count(F.lit(1)) * 1000).alias("pop")
    )
    return km2.join(pop, "feature").select(
        "feature", "km2", G.density(F.col("pop"), F.col("km2")).alias("density")
    )


@query(
    "k11_label_points",
    f"""WITH {SHAPES},
    s AS (SELECT feature, ring, sum(x1 * lat - lon * y1) AS a, sum((x1 + lon) * (x1 * lat - lon * y1)) AS cx, sum((y1 + lat) * (x1 * lat - lon * y1)) AS cy
      FROM edg WHERE x1 IS NOT NULL GROUP BY 1, 2),
    k AS (SELECT *, row_number() OVER (PARTITION BY feature ORDER BY abs(a) DESC, ring) AS rn FROM s WHERE abs(a) > 1e-8)
    SELECT feature, {r("cx / (3 * a)", 3)} AS lon, {r("cy / (3 * a)", 3)} AS lat FROM k WHERE rn = 1""",
)
def k11(spark: SparkSession, sf: str) -> DataFrame:
    labels = G.label_points(shapes(spark, sf), "feature", "ring", ["pos"], ring_bucket())
    return labels.select("feature", round_to("lon", 3).alias("lon"), round_to("lat", 3).alias("lat"))


@query(
    "k12_outline_arcs",
    """SELECT l_suppkey AS macro, l_partkey AS arc FROM lineitem GROUP BY 1, 2 HAVING count(*) = 1""",
)
def k12(spark: SparkSession, sf: str) -> DataFrame:
    key = F.col("l_partkey")
    uses = V.table(spark, sf, "lineitem").select(
        F.col("l_suppkey").alias("macro"),
        F.when(F.col("l_linenumber") % 2 == 0, F.bitwise_not(key)).otherwise(key).alias("arc"),
    )
    return G.outline_arcs(uses, "macro", "arc")


@query(
    "k13_drill_down",
    """WITH asked AS (SELECT r_name AS region FROM region UNION ALL SELECT 'ATLANTIS'),
    prov AS (SELECT r_name AS region, n_name AS province FROM nation JOIN region ON n_regionkey = r_regionkey WHERE r_name <> 'ASIA')
    SELECT region, province AS area, 'province' AS kind FROM asked JOIN prov USING (region)
    UNION ALL SELECT region, region, 'region' FROM asked SEMI JOIN region ON r_name = asked.region WHERE region NOT IN (SELECT region FROM prov)""",
)
def k13(spark: SparkSession, sf: str) -> DataFrame:
    geo = V.geography(spark, sf)
    regions = V.table(spark, sf, "region").select(F.col("r_name").alias("region"))
    name = F.explode(F.array("region", F.when(F.col("region") == "ASIA", F.lit("ATLANTIS"))))
    asked = regions.select(name.alias("region")).where("region IS NOT NULL")
    return G.provinces_or_region(asked, geo.where("region <> 'ASIA'").select("region", "province"), regions)


@query(
    "k13_macro_regions",
    f"""WITH {V.GEO}
    SELECT region, count(*) AS customers FROM customer JOIN geo ON c_nationkey = n_nationkey WHERE macro = 'east' GROUP BY 1""",
)
def k13_macro(spark: SparkSession, sf: str) -> DataFrame:
    """Customers of the regions of one macro-area."""
    placed = V.table(spark, sf, "customer").join(F.broadcast(V.geography(spark, sf)), F.col("c_nationkey") == F.col("n_nationkey"))
    return G.regions_of(placed, "east").groupBy("region").agg(F.count(F.lit(1)).alias("customers"))


@query(
    "k14_hierarchy_counts",
    """WITH d AS (SELECT CASE WHEN r_name = 'ASIA' THEN 'Altro' ELSE r_name END AS region, n_name AS province, c_acctbal > 0 AS has_calendar
      FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)
    SELECT region, province, CAST(2 - grouping(region) - grouping(province) AS INTEGER) AS level, count(*) AS municipalities,
      count(DISTINCT (region, province)) AS provinces, count(*) FILTER (has_calendar) AS with_calendar FROM d GROUP BY ROLLUP (region, province)""",
)
def k14(spark: SparkSession, sf: str) -> DataFrame:
    directory = V.table(spark, sf, "customer").join(
        F.broadcast(V.geography(spark, sf)), F.col("c_nationkey") == F.col("n_nationkey")
    ).select(
        F.when(F.col("region") == "ASIA", F.lit(" ")).otherwise(F.col("region")).alias("region"),
        "province",
        (F.col("c_acctbal") > 0).alias("has_calendar"),
    )
    return G.hierarchy_counts(directory)


@query(
    "k15_alphabetic_index",
    """SELECT p_partkey, p_name, upper(left(p_name, 1)) AS letter, count(*) OVER (PARTITION BY upper(left(p_name, 1))) AS letter_size FROM part""",
)
def k15(spark: SparkSession, sf: str) -> DataFrame:
    return G.alphabetic_index(V.table(spark, sf, "part").select("p_partkey", "p_name"), "p_name")
