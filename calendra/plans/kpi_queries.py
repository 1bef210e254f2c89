"""Waste measure queries: yearly rows with own, head and member lines derived from units."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from calendra.functions.lineage import cut
from calendra.functions.numbers import per_head_kg
from calendra.functions.text import slug_unicode
from calendra.operators import distribution as D
from calendra.operators import kpi as K
from calendra.plans import views as V
from calendra.plans.registry import query
from calendra.plans.views import LATEST_YEAR, UNIT, r


def yearly_rows(spark: SparkSession, sf: str, every_year: bool = False) -> DataFrame:
    """Every seventh unit shares data within its province; every third of those has data.

    The head with the highest key wins, and a province without any head is reported.
    """
    u = V.unit(spark, sf) if every_year else V.latest(V.unit(spark, sf))
    label = F.concat(F.lit("Consorzio "), F.col("province"))
    shared = F.col("id") % 7 == 0
    is_head = F.col("id") % 21 == 0
    member = shared & ~is_head

    def owned(c):
        return F.when(~member, c)

    return u.select(
        "id", "name", "region", "province", "pop", "year", "cost",
        F.when(is_head, F.concat(F.lit("Aggregazione: "), label))
        .when(shared, F.concat(F.lit("Vedi aggregazione: "), label))
        .when(F.col("id") % 97 == 0, F.lit("n.d."))
        .otherwise(F.lit("Comune"))
        .alias("dato"),
        owned(F.col("rd_pct")).alias("rd_pct"),
        owned(F.col("ru")).alias("ru_t"),
        owned(F.col("rd")).alias("rd_t"),
        owned(F.col("ru") - F.col("rd")).alias("ind_t"),
    )


ROWS = f"""{UNIT},
kr0 AS (SELECT *, (id % 7 = 0) AS shared, (id % 21 = 0) AS is_head FROM unit WHERE year = 2000),
kr AS (SELECT id, name, region, province, pop, year, cost,
  CASE WHEN is_head THEN 'head' WHEN shared THEN 'member' WHEN id % 97 = 0 THEN 'skip' ELSE 'own' END AS kind,
  CASE WHEN shared THEN 'Consorzio ' || province WHEN id % 97 = 0 THEN 'n.d.' END AS gname,
  CASE WHEN is_head OR NOT shared THEN rd_pct END AS rd_pct, CASE WHEN is_head OR NOT shared THEN ru END AS ru_t,
  CASE WHEN is_head OR NOT shared THEN rd END AS rd_t, CASE WHEN is_head OR NOT shared THEN ru - rd END AS ind_t
  FROM kr0)"""


@query("j01_row_class", f"WITH {ROWS.replace(' WHERE year = 2000', '')} SELECT year, id, kind, gname AS group_name FROM kr")
def j01(spark: SparkSession, sf: str) -> DataFrame:
    c = K.row_class(F.col("dato"))
    return yearly_rows(spark, sf, every_year=True).select(
        "year", "id", c["kind"].alias("kind"), c["name"].alias("group_name")
    )


@query(
    "j02_identity",
    f"""WITH {UNIT} SELECT id || '/' || year AS id, name, region, province, pop FROM unit WHERE id % 10 <> 3""",
)
def j02(spark: SparkSession, sf: str) -> DataFrame:
    """Rows of all years; those with a blank name are the ones that identity drops."""
    u = V.unit(spark, sf)
    raw = u.select(
        F.concat(F.lit("\t"), F.concat_ws("/", "id", "year"), F.lit(" ")).alias("id"),
        F.when(F.col("id") % 10 == 3, F.lit(" ")).otherwise(F.concat(F.lit(" "), "name")).alias("name"),
        "region", "province", "pop",
    )
    return K.identity(raw)


@query(
    "j03_per_capita",
    f"""WITH {UNIT} SELECT id, year, {r("1000e0 * ru / pop", 1)} AS kg_ru,
      {r("1000e0 * CASE WHEN id % 9 <> 0 THEN rd END / pop", 1)} AS kg_rd FROM unit""",
)
def j03(spark: SparkSession, sf: str) -> DataFrame:
    return V.unit(spark, sf).select(
        "id", "year",
        per_head_kg("ru", "pop").alias("kg_ru"),
        per_head_kg(F.when(F.col("id") % 9 != 0, F.col("rd")), "pop").alias("kg_rd"),
    )


METRICS = f"""{ROWS},
gh AS (SELECT gname, arg_max(rd_pct, id) AS rd_pct, arg_max(ru_t, id) AS ru_t, arg_max(rd_t, id) AS rd_t, arg_max(ind_t, id) AS ind_t FROM kr WHERE kind = 'head' GROUP BY 1),
gs AS (SELECT gname, count(*) AS group_n, CAST(sum(pop) AS BIGINT) AS group_pop FROM kr WHERE kind IN ('head', 'member') GROUP BY 1),
met AS (
  SELECT id, name, region, province, year, cost, pop, rd_pct, {r("1000e0 * ru_t / pop", 1)} AS kg_ru, {r("1000e0 * ind_t / pop", 1)} AS kg_ind,
    {r("1000e0 * rd_t / pop", 1)} AS kg_rd, NULL AS group_name, NULL::BIGINT AS group_n, NULL::BIGINT AS group_pop FROM kr WHERE kind = 'own'
  UNION ALL
  SELECT id, name, region, province, year, cost, pop, gh.rd_pct, {r("1000e0 * gh.ru_t / group_pop", 1)}, {r("1000e0 * gh.ind_t / group_pop", 1)},
    {r("1000e0 * gh.rd_t / group_pop", 1)}, gname, group_n, group_pop
  FROM kr JOIN gh USING (gname) JOIN gs USING (gname) WHERE kind IN ('head', 'member'))"""


@query(
    "j04_shared_metrics",
    f"""WITH {METRICS} SELECT id, pop, rd_pct, kg_ru, kg_ind, kg_rd, group_name,
      CAST(group_n AS DOUBLE) AS group_n, CAST(group_pop AS DOUBLE) AS group_pop FROM met""",
)
def j04(spark: SparkSession, sf: str) -> DataFrame:
    return K.shared_metrics(cut(yearly_rows(spark, sf))).withColumns(
        {c: F.col(c).cast("double") for c in ("group_n", "group_pop")}
    )


# The same over all years: heads, members and people of each year.
METRICS_BY_YEAR = (
    METRICS.replace(" FROM unit WHERE year = 2000)", " FROM unit)")
    .replace("gh AS (SELECT gname,", "gh AS (SELECT year, gname,").replace("gs AS (SELECT gname,", "gs AS (SELECT year, gname,")
    .replace("WHERE kind = 'head' GROUP BY 1)", "WHERE kind = 'head' GROUP BY 1, 2)")
    .replace("WHERE kind IN ('head', 'member') GROUP BY 1)", "WHERE kind IN ('head', 'member') GROUP BY 1, 2)")
    .replace("JOIN gh USING (gname) JOIN gs USING (gname)", "JOIN gh USING (year, gname) JOIN gs USING (year, gname)")
)


@query(
    "j04_shared_metrics_by_year",
    f"""WITH {METRICS_BY_YEAR} SELECT year, id, pop, rd_pct, kg_ru, kg_ind, kg_rd, group_name,
      CAST(group_n AS DOUBLE) AS group_n, CAST(group_pop AS DOUBLE) AS group_pop FROM met""",
)
def j04_years(spark: SparkSession, sf: str) -> DataFrame:
    return K.shared_metrics(yearly_rows(spark, sf, every_year=True), ["year"]).withColumns(
        {c: F.col(c).cast("double") for c in ("group_n", "group_pop")}
    )


@query(
    "j04_group_warnings",
    f"""WITH {ROWS} SELECT upper(replace(gname, ' ', '')) AS key, gname AS any_label, 'no head row' AS reason FROM kr
    WHERE kind IN ('head', 'member') GROUP BY gname HAVING count(*) FILTER (kind = 'head') = 0""",
)
def j04_warnings(spark: SparkSession, sf: str) -> DataFrame:
    return K.group_warnings(K.group_facts(yearly_rows(spark, sf)))


def metrics(spark: SparkSession, sf: str) -> DataFrame:
    """Metrics of every year; the rows behind them are read by several branches and cut."""
    rows = cut(yearly_rows(spark, sf, every_year=True))
    places = rows.select("id", "name", "region", "province", "year")
    costs = V.table(spark, sf, "customer").where("c_acctbal >= 0").select(
        F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("cost")
    )
    return K.attach_costs(K.shared_metrics(rows, ["year"]).join(places, ["year", "id"]), costs)


@query("j05_attach_costs", f"WITH {METRICS_BY_YEAR} SELECT year, id, rd_pct, cost FROM met")
def j05(spark: SparkSession, sf: str) -> DataFrame:
    return metrics(spark, sf).select("year", "id", "rd_pct", "cost")


UNITS = f"""{METRICS_BY_YEAR},
mk AS (SELECT *, CASE WHEN group_n >= 2 THEN 'g:' || upper(replace(group_name, ' ', '')) ELSE 'm:' || id END AS unit_key FROM met),
su AS (SELECT year, unit_key, arg_min(id, id) AS id, arg_min(region, id) AS region, arg_min(province, id) AS province,
  arg_min(CASE WHEN group_n >= 2 THEN group_pop ELSE pop END, id) AS pop, arg_min(rd_pct, id) AS rd_pct,
  max(cost) FILTER (mk.id = first_id) AS cost, arg_min(kg_ru, id) AS kg_ru, arg_min(kg_ind, id) AS kg_ind, arg_min(kg_rd, id) AS kg_rd
  FROM (SELECT *, min(id) OVER (PARTITION BY year, unit_key) AS first_id FROM mk) mk GROUP BY 1, 2)"""


@query("j06_statistical_units", f"WITH {UNITS} SELECT year, unit_key, id, pop, rd_pct, cost FROM su")
def j06(spark: SparkSession, sf: str) -> DataFrame:
    return K.statistical_units(metrics(spark, sf), ["year"]).select("year", "unit_key", "id", "pop", "rd_pct", "cost")


def pop_label_sql(x: str) -> str:
    unit = f"(CASE WHEN {x} < 500 THEN 1e0 WHEN {x} < 1000 THEN 50e0 WHEN {x} < 10000 THEN 100e0 ELSE 1000e0 END)"
    return f"replace(format('{{:,}}', CAST(round_even({x} / {unit}, 0) * {unit} AS BIGINT)), ',', '.')"


CLUSTERS = f"""{UNITS},
ed0 AS (SELECT year, {', '.join(
    f"list_sort(list(pop))[CAST(round_even({i} * (count(*) - 1) / 4e0, 0) AS BIGINT) + 1] AS e{i}" for i in (1, 2, 3))} FROM su GROUP BY 1),
ed AS (SELECT year, e1, greatest(e2, e1 + 1) AS e2, greatest(e3, greatest(e2, e1 + 1) + 1) AS e3 FROM ed0),
bands AS (
  SELECT year, 'p0' AS cluster, CAST(1 AS INTEGER) AS ordinal, CAST(0 AS BIGINT) AS lo, e1 AS hi, 'fino a ~' || {pop_label_sql("e1")} || ' ab.' AS label FROM ed
  UNION ALL SELECT year, 'p1', 2, e1 + 1, e2, '~' || {pop_label_sql("e1")} || '-' || {pop_label_sql("e2")} || ' ab.' FROM ed
  UNION ALL SELECT year, 'p2', 3, e2 + 1, e3, '~' || {pop_label_sql("e2")} || '-' || {pop_label_sql("e3")} || ' ab.' FROM ed
  UNION ALL SELECT year, 'p3', 4, e3 + 1, NULL, 'oltre ~' || {pop_label_sql("e3")} || ' ab.' FROM ed),
clu AS (SELECT b.*, {r("median(rd_pct)", 2)} AS rd_median, count(rd_pct) AS rd_n, {r("median(cost)", 2)} AS cost_median, count(cost) AS cost_n
  FROM bands b LEFT JOIN su ON su.year = b.year AND pop >= lo AND (hi IS NULL OR pop <= hi) GROUP BY ALL)"""


@query(
    "j07_population_clusters",
    f"WITH {CLUSTERS} SELECT * REPLACE (CAST(hi AS DOUBLE) AS hi) FROM clu",
)
def j07(spark: SparkSession, sf: str) -> DataFrame:
    return K.population_clusters(K.statistical_units(cut(metrics(spark, sf)), ["year"]), ["year"]).withColumn(
        "hi", F.col("hi").cast("double")
    )


ASSIGNED = f"""{CLUSTERS},
asg AS (SELECT m.*, cluster, {r("m.rd_pct - rd_median", 2)} AS rd_vs_peers, {r("m.cost - cost_median", 1)} AS cost_vs_peers, rd_n >= 30 AS peer_shown
  FROM met m JOIN clu c ON m.year = c.year AND (CASE WHEN m.group_n >= 2 THEN m.group_pop ELSE m.pop END) >= lo
    AND (hi IS NULL OR (CASE WHEN m.group_n >= 2 THEN m.group_pop ELSE m.pop END) <= hi))"""


@query(
    "j08_assign_clusters",
    f"WITH {ASSIGNED} SELECT year, id, cluster, rd_vs_peers, cost_vs_peers, peer_shown FROM asg",
)
def j08(spark: SparkSession, sf: str) -> DataFrame:
    m = cut(metrics(spark, sf))
    return K.assign_clusters(m, K.statistical_units(m, ["year"]), ["year"]).select(
        "year", "id", "cluster", "rd_vs_peers", "cost_vs_peers", "peer_shown"
    )


IDS = """nm AS (SELECT p_partkey AS id, p_name AS name, p_brand AS province, replace(p_name, ' ', '-') AS base,
  lower(replace(p_brand, '#', '')) AS prov FROM part),
known AS (SELECT id, base AS public_id FROM nm WHERE id % 40 = 0),
pend AS (SELECT *, count(*) OVER (PARTITION BY base) AS c FROM nm WHERE id % 40 <> 0),
cand AS (SELECT *, CASE WHEN c > 1 THEN base || '-' || prov ELSE base END AS cid FROM pend),
own AS (SELECT *, min(id) OVER (PARTITION BY cid) AS owner FROM cand)"""


@query(
    "j09_assign_ids",
    f"""WITH {IDS}
    SELECT id, CASE WHEN owner <> id OR cid IN (SELECT public_id FROM known) THEN cid || '-' || right(CAST(id AS VARCHAR), 4) ELSE cid END AS public_id,
      array_to_string(list_transform(string_split(name, ' '), lambda w: upper(w[1]) || w[2:]), ' ') AS display, false AS has_calendar FROM own
    UNION ALL SELECT id, public_id, name, true FROM known JOIN nm USING (id)""",
)
def j09(spark: SparkSession, sf: str) -> DataFrame:
    names = V.table(spark, sf, "part").select(
        F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), F.col("p_brand").alias("province")
    )
    known = names.where("id % 40 = 0").select("id", slug_unicode(F.col("name")).alias("public_id"))
    return K.assign_ids(names, known)


@query(
    "j10_directory",
    """SELECT c_custkey AS id, c_name AS name, EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND year(o_orderdate) = 2001) AS has_calendar
    FROM customer""",
)
def j10(spark: SparkSession, sf: str) -> DataFrame:
    records = V.table(spark, sf, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"))
    calendars = V.table(spark, sf, "orders").where(F.year("o_orderdate") == 2001).select(
        F.col("o_custkey").alias("id")
    )
    return K.directory(records, calendars)


@query(
    "j10_with_calendar_only",
    """SELECT c_custkey AS id, c_name AS name FROM customer SEMI JOIN
    (SELECT o_custkey FROM orders WHERE year(o_orderdate) = 2001) ON o_custkey = c_custkey""",
)
def j10_subset(spark: SparkSession, sf: str) -> DataFrame:
    records = V.table(spark, sf, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"))
    calendars = V.table(spark, sf, "orders").where(F.year("o_orderdate") == 2001).select(
        F.col("o_custkey").alias("id")
    )
    return K.with_calendar_only(records, calendars)


def boroughs(met: DataFrame) -> DataFrame:
    """Public ids of municipalities named after one of 400 boroughs; every fortieth is known."""
    borough = F.concat(F.lit("Borgo "), F.col("id") % 400)
    names = met.groupBy("id").agg(F.max("province").alias("province")).withColumn("name", borough)
    known = names.where("id % 40 = 0").select("id", F.concat(F.lit("noto-"), "id").alias("public_id"))
    return K.assign_ids(names, known).select("id", "public_id")


def frame_of(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    met = cut(metrics(spark, sf))
    edges, frame = K.yearly_frame(met, K.statistical_units(met, ["year"]), ["year"])
    return met, edges, frame


BASES = f"""{CLUSTERS},
cu AS (SELECT su.*, cluster FROM su LEFT JOIN bands b ON su.year = b.year AND pop >= lo AND (hi IS NULL OR pop <= hi) AND rd_pct IS NOT NULL),
lg AS ({' UNION ALL '.join(f"SELECT year, region, province, cluster, '{m}' AS measure, {m} AS value FROM cu WHERE {m} IS NOT NULL" for m in K.YEARLY_MEASURES)}),
ar AS (SELECT year, 'country' AS level, '*' AS area, measure, value FROM lg
  {' '.join(f"UNION ALL SELECT year, '{lv}', {lv}, measure, value FROM lg WHERE {lv} IS NOT NULL" for lv in K.LEVELS)}),
base AS (SELECT year, level, area, measure, count(*) AS n, {r("CAST(sum(CAST(value AS DECIMAL(18,2))) AS DOUBLE) / count(*)", 2)} AS mean,
  {r("median(value)", 2)} AS median, list_sort(list(value))[CAST(floor(0.1e0 * (count(*) - 1)) AS BIGINT) + 1] AS p10,
  list_sort(list(value))[CAST(floor(0.9e0 * (count(*) - 1)) AS BIGINT) + 1] AS p90,
  CASE WHEN measure = 'rd_pct' THEN {r("100e0 * count(*) FILTER (value >= 65) / count(*)", 1)} END AS share_ok FROM ar GROUP BY 1, 2, 3, 4)"""


@query("j11_baselines", f"WITH {BASES} SELECT * FROM base")
def j11_baselines(spark: SparkSession, sf: str) -> DataFrame:
    return K.baselines(frame_of(spark, sf)[2], ["year"])


def rank_sql(v: str, op: str) -> str:
    return f"""(SELECT {r(f"100e0 * count(*) FILTER (s.{v} {op} a.{v}) / count(s.{v})", 1)} FROM su s WHERE s.year = a.year)"""


def vs_sql(m: str, alias: str, digits: int) -> str:
    return r(f"k.{m} - {alias}.{m}", digits)


BUILD = f"""{BASES},
wd AS (SELECT year, level, area, {', '.join(f"max(median) FILTER (measure = '{m}') AS {m}, max(n) FILTER (measure = '{m}') AS {m}_n" for m in K.YEARLY_MEASURES)}
  FROM base GROUP BY 1, 2, 3),
mc AS (SELECT m.*, cluster FROM met m LEFT JOIN bands b ON m.year = b.year AND (CASE WHEN m.group_n >= 2 THEN m.group_pop ELSE m.pop END) >= lo
  AND (hi IS NULL OR (CASE WHEN m.group_n >= 2 THEN m.group_pop ELSE m.pop END) <= hi)),
rk AS (SELECT a.*, {rank_sql('rd_pct', '<')} AS rd_pctile, {rank_sql('kg_ru', '<')} AS kg_pctile, {rank_sql('kg_ind', '>')} AS ind_better_pctile,
  (SELECT count(s.rd_pct) FROM su s WHERE s.year = a.year) AS total, {r("rd_pct - 65e0", 1)} AS gap FROM mc a),
rb AS (SELECT *, greatest(1, CAST(floor(total * (1 - rd_pctile / 100e0) + 0.5e0) AS BIGINT)) AS best FROM rk),
sr AS (SELECT id, string_agg(year || ':' || printf('%.2f', rd_pct), ',' ORDER BY year) AS series,
  {r("max(rd_pct) FILTER (year = 2000) - max(rd_pct) FILTER (year = 1998)", 2)} AS delta_pp FROM met GROUP BY 1),
bo AS (SELECT DISTINCT id, 'borgo-' || id % 400 AS bs, replace(replace(lower(province), ' ', '-'), '_', '') AS pv FROM met),
pe AS (SELECT *, CASE WHEN count(*) OVER (PARTITION BY bs) > 1 THEN bs || '-' || pv ELSE bs END AS cid FROM bo WHERE id % 40 <> 0),
pu AS (SELECT id, CASE WHEN min(id) OVER (PARTITION BY cid) <> id THEN cid || '-' || right(CAST(id AS VARCHAR), 4) ELSE cid END AS public_id FROM pe
  UNION ALL SELECT id, 'noto-' || id FROM bo WHERE id % 40 = 0)"""


@query(
    "j11_yearly_build",
    f"""WITH {BUILD}
    SELECT k.id, public_id, name, k.province, k.region, k.year, k.pop, {', '.join(f'k.{m}' for m in K.YEARLY_MEASURES)}, rd_pctile, kg_pctile, ind_better_pctile,
      CASE {' '.join(f"WHEN best <= {b} THEN 'top-{b}'" for b in D.RANK_BANDS)}
        {' '.join(f"WHEN greatest(1, total - best + 1) <= {b} THEN 'last-{b}'" for b in D.RANK_BANDS)}
        WHEN rd_pctile >= 50 THEN 'upper-half' ELSE 'lower-half' END AS rank_band,
      {r("k.rd_pct - 65e0", 2)} AS gap_target,
      {', '.join(f"{vs_sql(m, a, d)} AS {m}_vs_{lv}" for m, d in K.YEARLY_MEASURES.items() for a, lv in (('c', 'country'), ('g', 'region'), ('p', 'province')))},
      k.cluster, {vs_sql('rd_pct', 'q', 2)} AS rd_vs_peers, {vs_sql('cost', 'q', 1)} AS cost_vs_peers, coalesce(q.rd_pct_n >= 30, false) AS peer_shown,
      CASE WHEN rd_pctile >= 90 THEN 'top_pctile' WHEN k.rd_pct < 65 THEN 'below_target' ELSE 'target_met' END AS hook_key,
      CASE WHEN rd_pctile >= 90 THEN printf('Tra i migliori in Italia (meglio del %.0f%%)', floor(rd_pctile + 0.5e0))
        WHEN k.rd_pct < 65 THEN printf('A -%.1f punti percentuali dall''obiettivo nazionale del 65%%', abs(gap))
        ELSE printf('Obiettivo 65%% raggiunto · %+.1f punti percentuali', gap) END AS hook_text, series, delta_pp
    FROM rb k LEFT JOIN wd c ON c.year = k.year AND c.level = 'country' LEFT JOIN wd g ON g.year = k.year AND g.level = 'region' AND g.area = k.region
      LEFT JOIN wd p ON p.year = k.year AND p.level = 'province' AND p.area = k.province
      LEFT JOIN wd q ON q.year = k.year AND q.level = 'cluster' AND q.area = k.cluster JOIN sr ON sr.id = k.id JOIN pu ON pu.id = k.id""",
)
def j11(spark: SparkSession, sf: str) -> DataFrame:
    met, edges, frame = frame_of(spark, sf)
    return K.yearly_records(met, edges, cut(frame), boroughs(met), "year", 1998, 2000)
