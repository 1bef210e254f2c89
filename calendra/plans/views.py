"""Adapter views: the given tables seen as calendars, municipal units, streets and votes.

Every view is a lazy DataFrame over parquet, and each has a SQL twin (upper-case
constant) for the oracle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from calendra.functions.numbers import round_to

LATEST_YEAR = 2000
YEARS = tuple(range(1995, 2002))


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    # The tables hold times without zone; UTC keeps every conversion of them neutral.
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark.read.parquet(f"{sf.rstrip('/')}/{name}.parquet")


def r(expr: str, digits: int) -> str:
    """SQL twin of ``round_to``."""
    scale = f"{10**digits}e0"
    return f"(floor(({expr}) * {scale} + 0.5e0) / {scale})"


def macro_area(region_key: Column) -> Column:
    return (
        F.when(region_key.isin(0, 4), F.lit("south"))
        .when(region_key.isin(1), F.lit("west"))
        .otherwise(F.lit("east"))
    )


def geography(spark: SparkSession, sf: str) -> DataFrame:
    """Nation with region and macro-area: a fixed 25-row dimension."""
    nation = table(spark, sf, "nation")
    region = table(spark, sf, "region")
    return nation.join(region, nation.n_regionkey == region.r_regionkey).select(
        "n_nationkey",
        F.col("n_name").alias("province"),
        F.col("r_name").alias("region"),
        macro_area(F.col("r_regionkey")).alias("macro"),
    )


GEO = """geo AS (
  SELECT n_nationkey, n_name AS province, r_name AS region,
         CASE WHEN r_regionkey IN (0, 4) THEN 'south' WHEN r_regionkey = 1 THEN 'west'
              ELSE 'east' END AS macro
  FROM nation JOIN region ON n_regionkey = r_regionkey)"""


def unit(spark: SparkSession, sf: str) -> DataFrame:
    """One row per customer and year with its yearly measures.

    lineitem is reduced to one row per order before the join, and orders to one row
    per (customer, year) before the dimensions are attached, so the raw tables are
    each shuffled once and a hot customer is combined map-side.
    """
    kept = F.col("l_returnflag").isin("A", "N")
    per_order = (
        table(spark, sf, "lineitem")
        .groupBy("l_orderkey")
        .agg(
            F.sum("l_quantity").alias("ru"),
            F.sum(F.when(kept, F.col("l_quantity")).otherwise(0.0)).alias("rd"),
        )
    )
    orders = table(spark, sf, "orders").select(
        "o_orderkey", F.col("o_custkey").alias("id"), F.year("o_orderdate").alias("year")
    )
    yearly = (
        orders.join(per_order, F.col("o_orderkey") == F.col("l_orderkey"), "left")
        .groupBy("id", "year")
        .agg(
            F.sum("ru").alias("ru"),
            F.sum("rd").alias("rd"),
        )
    )
    # From orders alone: a window over the joined rows would keep year filters above it.
    people = orders.groupBy("id").agg((F.count(F.lit(1)) * 1000).alias("pop"))
    customer = table(spark, sf, "customer").select(
        F.col("c_custkey").alias("id"),
        F.col("c_name").alias("name"),
        "c_nationkey",
        F.when(F.col("c_acctbal") >= 0, F.col("c_acctbal")).alias("cost"),
    )
    return (
        yearly.where(F.col("ru").isNotNull())
        .join(people, "id")
        .join(customer, "id")
        .join(F.broadcast(geography(spark, sf)), F.col("c_nationkey") == F.col("n_nationkey"))
        .select(
            "id",
            "name",
            "province",
            "region",
            "macro",
            "year",
            "pop",
            "ru",
            "rd",
            round_to(F.lit(100.0) * F.col("rd") / F.col("ru"), 2).alias("rd_pct"),
            round_to(F.lit(1000.0) * F.col("ru") / F.col("pop"), 1).alias("kg_ru"),
            round_to(F.lit(1000.0) * (F.col("ru") - F.col("rd")) / F.col("pop"), 1).alias("kg_ind"),
            "cost",
        )
    )


UNIT = f"""{GEO},
oq AS (
  SELECT l_orderkey, sum(l_quantity) AS ru,
         sum(CASE WHEN l_returnflag IN ('A', 'N') THEN l_quantity ELSE 0 END) AS rd
  FROM lineitem GROUP BY 1),
cy AS (
  SELECT o_custkey AS id, CAST(year(o_orderdate) AS INTEGER) AS year, count(*) AS n,
         sum(ru) AS ru, sum(rd) AS rd
  FROM orders LEFT JOIN oq ON o_orderkey = l_orderkey GROUP BY 1, 2),
cp AS (SELECT *, CAST(1000 * sum(n) OVER (PARTITION BY id) AS BIGINT) AS pop FROM cy),
unit AS (
  SELECT id, c_name AS name, province, region, macro, year, pop, ru, rd,
         {r('100e0 * rd / ru', 2)} AS rd_pct,
         {r('1000e0 * ru / pop', 1)} AS kg_ru,
         {r('1000e0 * (ru - rd) / pop', 1)} AS kg_ind,
         CASE WHEN c_acctbal >= 0 THEN c_acctbal END AS cost
  FROM cp JOIN customer ON id = c_custkey JOIN geo ON c_nationkey = n_nationkey
  WHERE ru IS NOT NULL)"""


def latest(units: DataFrame) -> DataFrame:
    return units.where(F.col("year") == LATEST_YEAR)


def cal(spark: SparkSession, sf: str) -> DataFrame:
    """Calendar entries from orders: customer, civil date, bin 1..5 by priority."""
    return (
        table(spark, sf, "orders")
        .select(
            F.col("o_custkey").alias("calendar_id"),
            F.to_date("o_orderdate").alias("date"),
            F.left("o_orderpriority", F.lit(1)).cast("int").alias("bin"),
        )
        .distinct()
    )


CAL = """cal AS (
  SELECT DISTINCT o_custkey AS calendar_id, CAST(o_orderdate AS DATE) AS date,
         CAST(left(o_orderpriority, 1) AS INTEGER) AS bin
  FROM orders)"""


def cal_n(spark: SparkSession, sf: str) -> DataFrame:
    """Calendars per nation (all bins) and per nation and priority (one bin)."""
    o = (
        table(spark, sf, "orders")
        .join(
            table(spark, sf, "customer").select("c_custkey", "c_nationkey"),
            F.col("o_custkey") == F.col("c_custkey"),
        )
        .select(
            F.concat(F.lit("n"), F.col("c_nationkey")).alias("nation_id"),
            F.to_date("o_orderdate").alias("date"),
            F.left("o_orderpriority", F.lit(1)).cast("int").alias("bin"),
        )
    )
    both = F.array(
        F.col("nation_id"), F.concat(F.col("nation_id"), F.lit("-p"), F.col("bin"))
    )
    return o.select(F.explode(both).alias("calendar_id"), "date", "bin").distinct()


CAL_N = """caln0 AS (
  SELECT 'n' || c_nationkey AS nation_id, CAST(o_orderdate AS DATE) AS date,
         CAST(left(o_orderpriority, 1) AS INTEGER) AS bin
  FROM orders JOIN customer ON o_custkey = c_custkey),
cal_n AS (
  SELECT DISTINCT nation_id AS calendar_id, date, bin FROM caln0
  UNION SELECT DISTINCT nation_id || '-p' || bin, date, bin FROM caln0)"""


def vote(spark: SparkSession, sf: str) -> DataFrame:
    """One row per cast vote: customer group, supplier code."""
    orders = table(spark, sf, "orders").select("o_orderkey", "o_custkey")
    return (
        table(spark, sf, "lineitem")
        .select("l_orderkey", "l_suppkey")
        .join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
        .select(F.col("o_custkey").alias("grp"), F.col("l_suppkey").alias("code"))
    )


VOTE = """vote AS (
  SELECT o_custkey AS grp, l_suppkey AS code
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"""


def street(spark: SparkSession, sf: str) -> DataFrame:
    """Streets of a municipality: part names, code by brand, calendar by size."""
    return table(spark, sf, "part").select(
        F.col("p_partkey").alias("street_id"),
        F.col("p_type").alias("comune"),
        F.col("p_name").alias("street"),
        F.col("p_brand").alias("code"),
        F.col("p_size").alias("calendar_id"),
    )


STREET = """street AS (
  SELECT p_partkey AS street_id, p_type AS comune, p_name AS street, p_brand AS code,
         p_size AS calendar_id FROM part)"""
