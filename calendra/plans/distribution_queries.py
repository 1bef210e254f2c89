"""Queries of the distribution family over the unit view."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from calendra.functions.lineage import cut
from calendra.functions.numbers import round_to
from calendra.operators import distribution as D
from calendra.operators import kpi as K
from calendra.plans import views as V
from calendra.plans.registry import query
from calendra.plans.views import UNIT, r

ARR = "list_sort(list({v}))"


def nth(v: str, index: str) -> str:
    """SQL: element of the sorted list at a zero-based index."""
    return f"list_sort(list({v}))[CAST({index} AS BIGINT) + 1]"


@query(
    "f01_distribution_summary",
    f"""WITH {UNIT}
    SELECT year, region, count(*) AS n,
      {r("CAST(sum(CAST(rd_pct AS DECIMAL(18,2))) AS DOUBLE) / count(*)", 2)} AS mean,
      {r("median(rd_pct)", 2)} AS median,
      {nth("rd_pct", "floor(0.1e0 * (count(*) - 1))")} AS p10,
      {nth("rd_pct", "floor(0.9e0 * (count(*) - 1))")} AS p90
    FROM unit GROUP BY 1, 2""",
)
def f01(spark: SparkSession, sf: str) -> DataFrame:
    keys = ["year", "region"]
    return D.summary(D.distribution(V.unit(spark, sf), keys, "rd_pct"), keys)


@query(
    "f02_quantile_edges",
    f"""WITH {UNIT},
    e AS (SELECT year, count(*) AS n, {', '.join(
        nth("pop", f"round_even({i} * (count(*) - 1) / 4e0, 0)") + f" AS e{i}" for i in (1, 2, 3))}
      FROM unit GROUP BY 1),
    b2 AS (SELECT *, CASE WHEN e2 <= e1 THEN e1 + 1 ELSE e2 END AS f2 FROM e)
    SELECT year, e1 AS edge1, f2 AS edge2, CASE WHEN e3 <= f2 THEN f2 + 1 ELSE e3 END AS edge3
    FROM b2""",
)
def f02(spark: SparkSession, sf: str) -> DataFrame:
    dist = D.distribution(V.unit(spark, sf), ["year"], "pop", digits=-3)
    return D.quantile_edges(dist, ["year"], 4).select(
        "year", *[F.col("edges")[i].alias(f"edge{i + 1}") for i in range(3)]
    )


@query(
    "f03_nearest_rank_percentile",
    f"""WITH {UNIT}
    SELECT year, {', '.join(
        nth("kg_ru", f"round_even({p / 100} * (count(*) - 1), 0)") + f" AS p{p}" for p in (25, 50, 75))}
    FROM unit GROUP BY 1""",
)
def f03(spark: SparkSession, sf: str) -> DataFrame:
    dist = D.distribution(V.unit(spark, sf), ["year"], "kg_ru", digits=1)
    return dist.groupBy("year").agg(
        *[D.at_index(D.half_even_index(p / 100)).alias(f"p{p}") for p in (25, 50, 75)]
    )


# Area-level measures: population-weighted share per province, one row per area.
AREA = f"""{UNIT},
area AS (
  SELECT year, macro, region, province, sum(pop) AS pop, count(*) AS n,
    {r("sum(CAST(rd_pct AS DECIMAL(18,2)) * pop)::DOUBLE / sum(pop)", 2)} AS rd,
    {r("sum(CAST(kg_ru AS DECIMAL(18,2)) * pop)::DOUBLE / sum(pop)", 2)} AS kg
  FROM unit GROUP BY 1, 2, 3, 4)"""


def area(spark: SparkSession, sf: str) -> DataFrame:
    def weighted(v: str):
        total = F.sum(F.col(v).cast("decimal(18,2)") * F.col("pop"))
        return round_to(total.cast("double") / F.sum("pop"), 2)

    return (
        V.unit(spark, sf)
        .groupBy("year", "macro", "region", "province")
        .agg(
            weighted("rd_pct").alias("rd"),
            weighted("kg_ru").alias("kg"),
            F.count(F.lit(1)).alias("n"),
            F.sum("pop").alias("pop"),
        )
    )


@query(
    "f04_choropleth_classes",
    f"""WITH {AREA},
    l AS (SELECT year, list_sort(list(rd)) AS v, count(*) AS n FROM area GROUP BY 1),
    b AS (SELECT year, {', '.join(
        f"v[least(floor(n * {i} / 5e0), n - 1)::BIGINT + 1] AS b{i}" for i in (1, 2, 3, 4))} FROM l)
    SELECT year, province, rd,
      CAST({' + '.join(f"(rd >= b{i})::INTEGER" for i in (1, 2, 3, 4))} AS INTEGER) AS class
    FROM area JOIN b USING (year)""",
)
def f04(spark: SparkSession, sf: str) -> DataFrame:
    areas = area(spark, sf)
    breaks = D.choropleth_breaks(D.distribution(areas, ["year"], "rd"), ["year"], 5)
    return areas.join(breaks, "year").select(
        "year", "province", "rd", D.break_class(F.col("rd"), F.col("breaks")).alias("class")
    )


@query(
    "f05_legend_endpoints",
    f"""WITH {AREA}
    SELECT year, min(rd) AS lo, max(rd) AS hi, min(kg) AS kg_lo, max(kg) AS kg_hi
    FROM area GROUP BY 1""",
)
def f05(spark: SparkSession, sf: str) -> DataFrame:
    return area(spark, sf).groupBy("year").agg(
        F.min("rd").alias("lo"), F.max("rd").alias("hi"),
        F.min("kg").alias("kg_lo"), F.max("kg").alias("kg_hi"),
    )


@query(
    "f06_percentile_rank",
    f"""WITH {UNIT},
    h AS (SELECT rd_pct AS v, count(*) AS c FROM unit WHERE year = 1999 GROUP BY 1),
    q AS (SELECT DISTINCT rd_pct AS v FROM unit WHERE year = 2000),
    s AS (SELECT q.v, (SELECT coalesce(sum(c), 0) FROM h WHERE h.v < q.v) AS below,
            (SELECT sum(c) FROM h) AS total FROM q)
    SELECT id, rd_pct, {r("100e0 * below / total", 1)} AS pctile
    FROM unit JOIN s ON rd_pct = v WHERE year = 2000""",
)
def f06(spark: SparkSession, sf: str) -> DataFrame:
    units = V.unit(spark, sf).select("id", "year", "rd_pct")
    year = F.col("year")
    return D.percentile_rank(
        units.where(year == 2000).select("id", "rd_pct"),
        units.where(year == 1999).select("id", "rd_pct"),
        [], "rd_pct", "pctile",
    ).select("id", "rd_pct", "pctile")


@query(
    "f07_better_than_share",
    f"""WITH {UNIT}
    SELECT id, year, kg_ind,
      {r("100e0 * (rank() OVER (PARTITION BY year ORDER BY kg_ind DESC) - 1) / count(*) OVER (PARTITION BY year)", 1)} AS better_pctile
    FROM unit""",
)
def f07(spark: SparkSession, sf: str) -> DataFrame:
    units = V.unit(spark, sf).select("id", "year", "kg_ind")
    return D.percentile_rank(
        units, units, ["year"], "kg_ind", "better_pctile", digits=1, lower_is_better=True
    ).select("id", "year", "kg_ind", "better_pctile")


@query(
    "f08_target_share",
    f"""WITH {UNIT}
    SELECT year, count(*) AS n, {r("100e0 * count(*) FILTER (rd_pct >= 65) / count(*)", 1)} AS share_ok
    FROM unit GROUP BY 1""",
)
def f08(spark: SparkSession, sf: str) -> DataFrame:
    reached = F.count_if(F.col("rd_pct") >= D.TARGET_PCT)
    n = F.count(F.lit(1))
    return V.unit(spark, sf).groupBy("year").agg(
        n.alias("n"), round_to(F.lit(100.0) * reached / n, 1).alias("share_ok")
    )


MEASURES = ("rd_pct", "kg_ru", "kg_ind", "cost")
LONG = " UNION ALL ".join(
    f"SELECT year, id, province, region, '{m}' AS measure, {m} AS value FROM unit WHERE {m} IS NOT NULL"
    for m in MEASURES
)
MEDIANS = f"""{UNIT}, long AS ({LONG}),
med AS (
  SELECT year, 'country' AS level, '*' AS area, measure, {r("median(value)", 2)} AS median, count(*) AS n
  FROM long GROUP BY year, measure
  UNION ALL SELECT year, 'region', region, measure, {r("median(value)", 2)}, count(*)
  FROM long GROUP BY year, region, measure
  UNION ALL SELECT year, 'province', province, measure, {r("median(value)", 2)}, count(*)
  FROM long GROUP BY year, province, measure)"""


def medians(spark: SparkSession, sf: str) -> DataFrame:
    return D.area_medians(V.unit(spark, sf), ["year"], ["region", "province"], MEASURES)


@query("f09_area_baselines", f"WITH {MEDIANS} SELECT * FROM med")
def f09(spark: SparkSession, sf: str) -> DataFrame:
    return medians(spark, sf)


DELTA_DIGITS = {"rd_pct": 2, "kg_ru": 1, "kg_ind": 1, "cost": 1}


def peer_deltas(spark: SparkSession, sf: str) -> DataFrame:
    """Each unit's measures minus the medians of its country, region and province.

    The medians are one row per area, so the join side is bounded by geography. The units
    are read by the medians and by the result, so the join behind them is run once and cut.
    """
    units = cut(V.latest(V.unit(spark, sf)))
    medians = D.area_medians(units, ["year"], ["region", "province"], MEASURES)
    out = units.join(D.medians_by_key(medians, ["year"], MEASURES), "year", "left")
    area_of = {"country": F.lit("*"), "region": F.col("region"), "province": F.col("province")}
    deltas = [
        round_to(F.col(m) - D.median_of(level, area, m), digits).alias(f"{m}_vs_{level}")
        for m, digits in DELTA_DIGITS.items()
        for level, area in area_of.items()
    ]
    return out.select("id", "name", "province", "region", *MEASURES, *deltas)


PEER_SQL = f"""WITH {MEDIANS},
w AS (SELECT level, area, {', '.join(f"max(median) FILTER (measure = '{m}') AS {m}_m" for m in MEASURES)}
      FROM med WHERE year = 2000 GROUP BY 1, 2)
SELECT id, name, province, u.region, {', '.join(f"u.{m}" for m in MEASURES)},
  {', '.join(
      r(f"u.{m} - {a}.{m}_m", d) + f" AS {m}_vs_{lv}"
      for m, d in DELTA_DIGITS.items()
      for a, lv in (("c", "country"), ("g", "region"), ("p", "province")))}
FROM unit u LEFT JOIN w c ON c.level = 'country'
LEFT JOIN w g ON g.level = 'region' AND g.area = u.region
LEFT JOIN w p ON p.level = 'province' AND p.area = u.province
WHERE year = 2000"""

query("f10_peer_deltas", PEER_SQL)(peer_deltas)


def with_country_median(spark: SparkSession, sf: str, measures: tuple[str, ...]) -> DataFrame:
    """Latest units with the country and region median of each measure attached.

    The units are read by the medians and by the result, so the join behind them is cut.
    """
    units = cut(V.latest(V.unit(spark, sf)))
    areas = D.medians_by_key(D.area_medians(units, ["year"], ["region"], measures), ["year"], measures)
    return units.join(areas, "year", "left").withColumns({
        **{f"{m}_it": D.median_of("country", F.lit("*"), m) for m in measures},
        **{f"{m}_reg": D.median_of("region", F.col("region"), m) for m in measures},
    }).drop("areas")


WIDE = f"""{MEDIANS},
um AS (SELECT u.*, {', '.join(
    f"(SELECT median FROM med WHERE year = 2000 AND level = 'country' AND measure = '{m}') AS {m}_it"
    for m in MEASURES)},
  {', '.join(f"{m}g.median AS {m}_reg" for m in MEASURES)}
  FROM unit u {' '.join(
    f"LEFT JOIN med {m}g ON {m}g.year = 2000 AND {m}g.level = 'region' AND {m}g.area = u.region AND {m}g.measure = '{m}'"
    for m in MEASURES)}
  WHERE u.year = 2000)"""


def pct_sql(v: str, m: str, label: str) -> str:
    pct = f"(100e0 * ({v} - {m}) / {m})"
    whole = f"CAST(CAST(floor(abs({pct}) + 0.5e0) AS BIGINT) AS VARCHAR)"
    return (
        f"CASE WHEN {m} > 0 AND {v} IS NOT NULL THEN CASE WHEN abs({pct}) < 2 THEN 'in linea con {label}' "
        f"WHEN {pct} > 0 THEN '+' || {whole} || '% vs {label}' "
        f"ELSE '−' || {whole} || '% vs {label}' END END"
    )


@query(
    "f11_percent_vs_median",
    f"""WITH {WIDE}
    SELECT id, kg_ind, {pct_sql("kg_ind", "kg_ind_it", "Italia")} AS vs_country,
      {pct_sql("kg_ind", "kg_ind_reg", "regione")} AS vs_region FROM um""",
)
def f11(spark: SparkSession, sf: str) -> DataFrame:
    v = F.col("kg_ind")
    return with_country_median(spark, sf, ("kg_ind",)).select(
        "id", "kg_ind",
        D.pct_vs_median(v, F.col("kg_ind_it"), "Italia").alias("vs_country"),
        D.pct_vs_median(v, F.col("kg_ind_reg"), "regione").alias("vs_region"),
    )


@query(
    "f12_two_series_comparison",
    f"""WITH {WIDE},
    s AS (SELECT id, region, 'total' AS kind, kg_ru AS value, kg_ru_it AS m_it, kg_ru_reg AS m_reg FROM um
      UNION ALL SELECT id, region, 'ind', kg_ind, kg_ind_it, kg_ind_reg FROM um)
    SELECT id, region, kind, value, m_it, m_reg, {pct_sql("value", "m_it", "Italia")} AS hint
    FROM s WHERE value IS NOT NULL AND m_it IS NOT NULL""",
)
def f12(spark: SparkSession, sf: str) -> DataFrame:
    base = with_country_median(spark, sf, ("kg_ru", "kg_ind"))
    two = base.select(
        "id", "region",
        F.expr(
            "stack(2, 'total', kg_ru, kg_ru_it, kg_ru_reg, 'ind', kg_ind, kg_ind_it, kg_ind_reg)"
            " AS (kind, value, m_it, m_reg)"
        ),
    )
    return two.where("value IS NOT NULL AND m_it IS NOT NULL").withColumn(
        "hint", D.pct_vs_median(F.col("value"), F.col("m_it"), "Italia")
    )


def tone_sql(d: str, lower: bool, band: float) -> str:
    op = "<" if lower else ">"
    return (
        f"CASE WHEN {d} IS NULL THEN '' WHEN abs({d}) < {band}e0 THEN 'in-line' "
        f"WHEN {d} {op} 0 THEN 'good' ELSE 'bad' END"
    )


@query(
    "f13_delta_tone",
    f"""WITH {WIDE}
    SELECT id, {tone_sql("(rd_pct - rd_pct_it)", False, 0.05)} AS rd_tone,
      {tone_sql("(cost - cost_it)", True, 0.5)} AS cost_tone,
      {tone_sql("(kg_ind - kg_ind_it)", True, 0.05)} AS ind_tone FROM um""",
)
def f13(spark: SparkSession, sf: str) -> DataFrame:
    base = with_country_median(spark, sf, ("rd_pct", "kg_ind", "cost"))

    def delta(m: str):
        return F.col(m) - F.col(f"{m}_it")

    return base.select(
        "id",
        D.tone(delta("rd_pct"), False, D.POINT_BAND).alias("rd_tone"),
        D.tone(delta("cost"), True, D.COST_BAND).alias("cost_tone"),
        D.tone(delta("kg_ind"), True, D.POINT_BAND).alias("ind_tone"),
    )


PCTILE = f"""{UNIT},
pc AS (SELECT *, count(*) OVER (PARTITION BY year) AS total,
  {r("100e0 * (rank() OVER (PARTITION BY year ORDER BY rd_pct) - 1) / count(*) OVER (PARTITION BY year)", 1)} AS pctile
  FROM unit)"""


def with_pctile(spark: SparkSession, sf: str) -> DataFrame:
    units = V.unit(spark, sf).select("id", "year", "rd_pct")
    total = units.groupBy("year").agg(F.count(F.lit(1)).alias("total"))
    return D.percentile_rank(units, units, ["year"], "rd_pct", "pctile").join(total, "year")


@query(
    "f14_rank_band",
    f"""WITH {PCTILE},
    b AS (SELECT *, greatest(1, CAST(floor(total * (1 - pctile / 100e0) + 0.5e0) AS BIGINT)) AS best FROM pc),
    c AS (SELECT *, greatest(1, total - best + 1) AS worst FROM b)
    SELECT id, year, pctile, CASE
      {' '.join(f"WHEN best <= {k} THEN 'top-{k}'" for k in D.RANK_BANDS)}
      {' '.join(f"WHEN worst <= {k} THEN 'last-{k}'" for k in D.RANK_BANDS)}
      WHEN pctile >= 50 THEN 'upper-half' ELSE 'lower-half' END AS band FROM c""",
)
def f14(spark: SparkSession, sf: str) -> DataFrame:
    return with_pctile(spark, sf).select(
        "id", "year", "pctile", D.rank_band(F.col("pctile"), F.col("total")).alias("band")
    )


@query(
    "f15_headline_hook",
    f"""WITH {PCTILE}, g AS (SELECT *, {r("rd_pct - 65e0", 1)} AS gap FROM pc)
    SELECT id, year, CASE WHEN pctile >= 90 THEN 'top_pctile' WHEN rd_pct < 65 THEN 'below_target'
        ELSE 'target_met' END AS hook_key,
      CASE WHEN pctile >= 90 THEN printf('Tra i migliori in Italia (meglio del %.0f%%)', floor(pctile + 0.5e0))
        WHEN rd_pct < 65 THEN printf('A -%.1f punti percentuali dall''obiettivo nazionale del 65%%', abs(gap))
        ELSE printf('Obiettivo 65%% raggiunto · %+.1f punti percentuali', gap) END AS hook_text FROM g""",
)
def f15(spark: SparkSession, sf: str) -> DataFrame:
    hook = D.headline(F.col("rd_pct"), F.col("pctile"))
    return with_pctile(spark, sf).select(
        "id", "year", hook["key"].alias("hook_key"), hook["text"].alias("hook_text")
    )


@query(
    "f16_year_series",
    f"""WITH {UNIT},
    s AS (SELECT id, string_agg(year || ':' || printf('%.2f', rd_pct), ',' ORDER BY year) AS series,
      max(rd_pct) FILTER (year = 1998) AS a, max(rd_pct) FILTER (year = 2000) AS b FROM unit GROUP BY 1)
    SELECT id, series, {r("b - a", 2)} AS delta_pp FROM s""",
)
def f16(spark: SparkSession, sf: str) -> DataFrame:
    series = D.year_series(V.unit(spark, sf), "id", "rd_pct")
    text = F.transform(
        F.map_entries("series"), lambda e: F.format_string("%s:%.2f", e["key"], e["value"])
    )
    return series.select(
        "id",
        F.array_join(text, ",").alias("series"),
        D.series_delta(F.col("series"), 1998, 2000).alias("delta_pp"),
    )


@query(
    "f17_trend",
    f"""WITH {UNIT},
    t AS (SELECT id, year, rd_pct AS value,
      row_number() OVER (PARTITION BY id ORDER BY year DESC) - 1 AS ago,
      arg_min(rd_pct, year) OVER (PARTITION BY id) AS f, arg_max(rd_pct, year) OVER (PARTITION BY id) AS l,
      min(rd_pct) OVER (PARTITION BY id) AS mn, max(rd_pct) OVER (PARTITION BY id) AS mx FROM unit)
    SELECT id, year, value,
      CASE ago WHEN 0 THEN 'ultimo' WHEN 1 THEN '−1 anno' ELSE '−' || ago || ' anni' END AS label,
      CASE WHEN l > f + 0.05e0 THEN 'up' WHEN l < f - 0.05e0 THEN 'down' ELSE '' END AS direction,
      mn - greatest((mx - mn) * 0.35e0, 0.9e0) AS low, mx + greatest((mx - mn) * 0.35e0, 0.9e0) AS high FROM t""",
)
def f17(spark: SparkSession, sf: str) -> DataFrame:
    return D.trend(V.unit(spark, sf), "id", "rd_pct")


MIX = f"""mixt AS (SELECT l_suppkey AS supplier, sum(l_quantity) AS total FROM lineitem GROUP BY 1),
mix AS (SELECT l_suppkey AS supplier, l_returnflag AS part, {r("100e0 * sum(l_quantity) / any_value(total)", 2)} AS share
  FROM lineitem JOIN mixt ON l_suppkey = supplier WHERE l_returnflag <> 'R' GROUP BY 1, 2)"""


def flag_quantities(spark: SparkSession, sf: str) -> DataFrame:
    """Yearly rows of suppliers: kept quantity as separate waste, its flags as parts; every ninth has no rate."""
    kept = F.when(F.col("l_returnflag") != "R", F.col("l_quantity"))
    sums = V.table(spark, sf, "lineitem").groupBy(F.col("l_suppkey").alias("supplier")).agg(
        F.sum("l_quantity").alias("ru_t"), F.sum(kept).alias("kept_t"),
        *[F.sum(F.when(F.col("l_returnflag") == flag, F.col("l_quantity"))).alias(flag.lower()) for flag in ("A", "N")],
    )
    return sums.withColumn("rd_t", F.col("ru_t")).withColumn("rd_pct", F.when(F.col("supplier") % 9 != 0, F.lit(100.0) * F.col("kept_t") / F.col("ru_t")))


def mix(spark: SparkSession, sf: str) -> DataFrame:
    """Shares of a supplier's quantity by flag; flag R is left for the residual."""
    rows = flag_quantities(spark, sf).withColumn("rd_pct", F.coalesce("rd_pct", F.lit(0.0)))
    wide = K.waste(rows, ("a", "n"))
    return D.unpivot_measures(wide, ["supplier"], ["mix_a", "mix_n"]).select(
        "supplier", F.upper(F.substring("measure", 5, 1)).alias("part"), F.col("value").alias("share")
    )


@query("f18_mix_shares", f"WITH {MIX} SELECT supplier, part, share FROM mix")
def f18(spark: SparkSession, sf: str) -> DataFrame:
    return mix(spark, sf)


@query(
    "f18_waste_rows",
    f"""WITH s AS (SELECT l_suppkey AS supplier, sum(l_quantity) AS t, sum(l_quantity) FILTER (l_returnflag <> 'R') AS k,
      sum(l_quantity) FILTER (l_returnflag = 'A') AS a, sum(l_quantity) FILTER (l_returnflag = 'N') AS n FROM lineitem GROUP BY 1)
    SELECT supplier, {r("100e0 * k / t", 2)} AS rd_pct, {r("100e0 * a / t", 2)} AS mix_a, {r("100e0 * n / t", 2)} AS mix_n
    FROM s WHERE supplier % 9 <> 0 AND k IS NOT NULL""",
)
def f18_waste(spark: SparkSession, sf: str) -> DataFrame:
    """Rows without a rate are left out, as a municipality without separate collection."""
    return K.waste(flag_quantities(spark, sf), ("a", "n")).select("supplier", "rd_pct", "mix_a", "mix_n")


@query(
    "f19_mix_items",
    f"""WITH {MIX},
    rest AS (SELECT supplier, 'altro' AS part, greatest(0e0, 100e0 - sum(share ORDER BY part)) AS share FROM mix GROUP BY 1),
    x AS (SELECT *, 0 AS residual FROM mix UNION ALL SELECT *, 1 FROM rest WHERE share >= 0.5e0)
    SELECT supplier, part, {r("share", 2)} AS share,
      CAST(row_number() OVER (PARTITION BY supplier ORDER BY residual, share DESC, part) AS INTEGER) AS pos FROM x""",
)
def f19(spark: SparkSession, sf: str) -> DataFrame:
    return D.mix_items(mix(spark, sf), "supplier").withColumn("share", round_to("share", 2))


@query(
    "f20_top_part",
    f"""WITH {MIX}, t AS (
      SELECT supplier, arg_max(part, (share, part)) AS part, max(share) AS share FROM mix GROUP BY 1)
    SELECT *, CAST(greatest(1, least(10, floor(share / 10e0 + 0.5e0))) AS INTEGER) AS tenths FROM t""",
)
def f20(spark: SparkSession, sf: str) -> DataFrame:
    return D.top_part(mix(spark, sf), "supplier")


@query(
    "f21_area_rank",
    f"""WITH {AREA}
    SELECT year, province, rd, CAST(row_number() OVER (PARTITION BY year ORDER BY rd DESC, province) AS INTEGER) AS rank,
      count(*) OVER (PARTITION BY year) AS ranked FROM area""",
)
def f21(spark: SparkSession, sf: str) -> DataFrame:
    return D.ranked(area(spark, sf).select("year", "province", "rd"), ["year"], "rd", "province")
