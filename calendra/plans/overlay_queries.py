"""Overlay, composite and index queries over customer calendars, votes and supplier rules."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from calendra.functions.lineage import cut
from calendra.operators import matching as M
from calendra.operators import overlay as O
from calendra.operators import recurrence as E
from calendra.plans import views as V
from calendra.plans.matching_queries import CNT, SPEC, counts, specs
from calendra.plans.recurrence_queries import DATES, YEAR, clause_sql, clause_text
from calendra.plans.registry import query
from calendra.plans.views import CAL, CAL_N, STREET


@query(
    "h01_replace_category",
    f"""WITH {CAL}, ov AS (SELECT DISTINCT user_id AS calendar_id, CAST(ts AS DATE) AS date FROM events WHERE event_type = 'error')
    SELECT * FROM cal WHERE bin <> 3 OR calendar_id NOT IN (SELECT calendar_id FROM ov)
    UNION SELECT calendar_id, date, CAST(3 AS INTEGER) FROM ov""",
)
def h01(spark: SparkSession, sf: str) -> DataFrame:
    overlay = V.table(spark, sf, "events").where("event_type = 'error'").select(
        F.col("user_id").alias("calendar_id"), F.to_date("ts").alias("date")
    )
    return O.replace_category(V.cal(spark, sf), overlay, 3)


# Overlay driver: customers' votes for suppliers, suppliers' clause dates.
SELECTED = f"""{CNT}, {SPEC}, {DATES}, u AS (SELECT cnt.*, spec FROM cnt JOIN spec USING (code)),
h AS (SELECT grp, max(n) AS top, arg_max(spec, (n, -code)) AS ls, count(*) FILTER (spec >= 7 AND n >= 2) AS sp FROM u GROUP BY 1),
c AS (SELECT u.* FROM u JOIN h USING (grp) WHERE CASE WHEN ls <= 1 AND sp > 0 THEN spec >= 7 AND n >= 2 WHEN top >= 2 THEN n >= greatest(2, floor(0.5e0 * top)) ELSE true END),
o AS (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY spec DESC, n DESC, code) AS rn FROM c),
f AS (SELECT * FROM o WHERE rn = 1),
s AS (SELECT o.grp, arg_min(o.code, o.rn) AS code FROM o JOIN f ON o.grp = f.grp WHERE o.rn > 1 AND o.n >= greatest(2, floor(0.8e0 * f.n))
  AND abs(o.spec - f.spec) <= 2 AND NOT (o.spec <= 1 AND f.spec <= 1) GROUP BY 1),
sel AS (SELECT grp, code, 1 AS rank FROM f UNION ALL SELECT grp, code, 2 FROM s),
dated AS (SELECT s_suppkey AS code, date FROM supplier JOIN days ON {clause_sql('s_suppkey')}),
cov AS (SELECT grp, count(*) FILTER (code % 3 = 0) AS matched, count(*) AS total FROM vote GROUP BY 1 HAVING count(*) FILTER (code % 3 = 0) >= 1),
dd AS (SELECT grp, date, min(rank) AS rank FROM sel JOIN dated USING (code) GROUP BY 1, 2),
dn AS (SELECT grp, count(*) AS da, count(*) FILTER (rank = 1) AS df FROM dd GROUP BY 1),
cn AS (SELECT grp, max(rank) AS codes FROM sel GROUP BY 1),
pl0 AS (SELECT grp, matched, total, codes AS c0, coalesce(da, 0) AS da, coalesce(df, 0) AS df, coalesce(da, 0) > 120 AND codes > 1 AS retry FROM cov LEFT JOIN cn USING (grp) LEFT JOIN dn USING (grp)),
pl AS (SELECT grp, matched, total, CAST(CASE WHEN retry THEN 1 ELSE coalesce(c0, 0) END AS INTEGER) AS codes, CASE WHEN retry THEN df ELSE da END AS days,
  CASE WHEN matched < 2 OR c0 IS NULL THEN 'few matches' WHEN da < 4 THEN 'few days' WHEN (CASE WHEN retry THEN df ELSE da END) > 120 THEN 'too dense' ELSE 'merged' END AS status FROM pl0)"""


def driver(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    k = F.col("k")
    rules = V.table(spark, sf, "supplier").select(F.col("s_suppkey").alias("k")).select(
        k.alias("code"), clause_text(k).alias("rule")
    )
    dated = E.expand_clauses(rules, "rule", F.lit(YEAR)).select("code", "date")
    selected = cut(M.select_codes(cut(counts(spark, sf)), specs(spark, sf)))
    coverage = M.coverage(V.vote(spark, sf).withColumn("matched", F.col("code") % 3 == 0), 1)
    return O.overlay_plan(coverage, selected, dated), selected, dated


@query("h02_overlay_plan", f"WITH {SELECTED} SELECT grp, matched, total, codes, days, status FROM pl")
def h02(spark: SparkSession, sf: str) -> DataFrame:
    return driver(spark, sf)[0]


@query(
    "h02_overlay_report",
    f"""WITH {SELECTED}, {CAL},
    oe AS (SELECT DISTINCT grp AS calendar_id, date FROM sel JOIN pl USING (grp) JOIN dated USING (code) WHERE status = 'merged' AND rank <= pl.codes),
    aft AS (SELECT calendar_id, date, bin FROM cal WHERE bin <> 5 OR calendar_id NOT IN (SELECT calendar_id FROM oe) UNION SELECT calendar_id, date, 5 FROM oe),
    b AS (SELECT calendar_id, count(*) FILTER (bin = 5) AS n FROM cal GROUP BY 1), a AS (SELECT calendar_id, count(*) FILTER (bin = 5) AS n FROM aft GROUP BY 1)
    SELECT calendar_id, coalesce(b.n, 0) AS before, coalesce(a.n, 0) AS after FROM a FULL JOIN b USING (calendar_id)""",
)
def h02_report(spark: SparkSession, sf: str) -> DataFrame:
    plan, selected, dated = driver(spark, sf)
    cal = V.cal(spark, sf)
    merged = O.replace_category(cal, O.overlay_entries(plan, selected, dated), 5)
    return O.category_counts(cal, merged, 5)


SETS = f"""{CAL}, sk AS (SELECT DISTINCT calendar_id AS street, bin AS key FROM cal WHERE year(date) = 1998),
zd AS (SELECT DISTINCT bin AS key, date FROM cal WHERE year(date) = 1998),
ids AS (SELECT street, string_agg(key, '+' ORDER BY key) AS keyset FROM sk GROUP BY 1)"""


def street_keys(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    year = V.cal(spark, sf).where(F.year("date") == 1998)
    keys = year.select(F.col("calendar_id").alias("street"), F.col("bin").alias("key")).distinct()
    return keys, year.select(F.col("bin").alias("key"), "date").distinct()


@query("h03_street_calendars", f"WITH {SETS} SELECT street, 'spa-' || keyset AS calendar_id FROM ids")
def h03(spark: SparkSession, sf: str) -> DataFrame:
    return O.composite_ids(street_keys(spark, sf)[0], "spa-").select("street", "calendar_id")


@query(
    "h03_union_calendars",
    f"""WITH {SETS} SELECT DISTINCT 'spa-' || keyset AS calendar_id, date FROM (SELECT DISTINCT keyset FROM ids) JOIN zd ON contains('+' || keyset || '+', '+' || key || '+')""",
)
def h03_union(spark: SparkSession, sf: str) -> DataFrame:
    keys, dates = street_keys(spark, sf)
    return O.composite_entries(O.composite_ids(keys, "spa-"), dates)


# Zones are part names with the ship dates of their lowest part; a street has two of them or one.
ZONE_RULES = (("HOT GEAR", "calendars/x-gear"), ("HOT", "calendars/x-hot"), ("BOLT", "calendars/x-none"))
IMPORT = """zn AS (SELECT p_name AS zone, min(p_partkey) AS key, replace(p_name, ' ', '-') AS slug, upper(p_name) AS n FROM part GROUP BY 1),
zdt AS (SELECT DISTINCT key, CAST(l_shipdate AS DATE) AS date FROM zn JOIN lineitem ON l_partkey = key WHERE year(l_shipdate) = 1996),
op AS (SELECT p_partkey AS id, upper(p_name) AS a, CASE WHEN p_size % 3 > 0 THEN (SELECT upper(z.zone) FROM zn z WHERE z.key = (SELECT min(key) FROM zn)) END AS b, p_size % 11 = 0 AS lost FROM part),
pt AS (SELECT id, 0 AS pos, a AS n FROM op WHERE NOT lost UNION ALL SELECT id, 1, b FROM op WHERE NOT lost AND b IS NOT NULL AND b <> a),
zk AS (SELECT id, pos, key, slug FROM pt JOIN zn USING (n)),
ls AS (SELECT id, 'calendars/x-spa-' || string_agg(slug, '-' ORDER BY pos) AS calendar, count(*) AS k FROM zk GROUP BY 1),
ge AS (SELECT 'calendars/x-spa-' || slug AS calendar_id, date FROM zn JOIN zdt USING (key)
  UNION SELECT calendar, date FROM ls JOIN zk USING (id) JOIN zdt USING (key) WHERE k > 1),
old AS (SELECT DISTINCT ['calendars/x-gear', 'calendars/x-hot', 'calendars/x-other', 'calendars/x-spa-hot-gear'][o_custkey % 4 + 1] AS calendar_id,
  CAST(o_orderdate AS DATE) AS date, CAST(1 + o_custkey % 6 AS INTEGER) AS bin FROM orders),
ov AS (SELECT CASE WHEN contains(n, 'HOT GEAR') THEN 'calendars/x-gear' ELSE 'calendars/x-hot' END AS calendar_id, date FROM zn JOIN zdt USING (key) WHERE contains(n, 'HOT')),
af AS (SELECT calendar_id, date, bin FROM old WHERE calendar_id NOT IN (SELECT calendar_id FROM ge) AND (bin <> 6 OR calendar_id NOT IN (SELECT calendar_id FROM ov))
  UNION SELECT calendar_id, date, 6 FROM ov UNION SELECT calendar_id, date, 6 FROM ge)"""


def imported(spark: SparkSession, sf: str, twice: bool = False) -> dict[str, DataFrame]:
    part = V.table(spark, sf, "part")
    zones = part.groupBy(F.col("p_name").alias("zone")).agg(F.min("p_partkey").alias("key"))
    ships = V.table(spark, sf, "lineitem").where((F.col("l_shipdate") >= "1996-01-01") & (F.col("l_shipdate") < "1997-01-01"))
    schedules = cut(zones.join(ships.select(F.col("l_partkey").alias("key"), F.to_date("l_shipdate").alias("date")).distinct(), "key", "left"))
    common = F.lit(zones.agg(F.min_by("zone", "key")).first()[0])
    both = F.when((F.col("p_size") % 3 > 0) & (common != F.col("p_name")), F.concat_ws(", ", "p_name", common)).otherwise(F.col("p_name"))
    options = part.select(
        F.col("p_partkey").alias("option_id"), F.concat(F.lit("Via "), "p_partkey").alias("street"),
        F.when(F.col("p_size") % 11 != 0, both).otherwise(F.lit("?")).alias("zone"),
    )
    ids = F.array(*[F.lit(f"calendars/x-{name}") for name in ("gear", "hot", "other", "spa-hot-gear")])
    k = F.col("o_custkey")
    entries = V.table(spark, sf, "orders").select(
        F.get(ids, (k % 4).cast("int")).alias("calendar_id"), F.to_date("o_orderdate").alias("date"), (1 + k % 6).cast("int").alias("bin")
    ).distinct()
    index = part.where("p_size = 7").select(F.lit("x").alias("comune"), F.col("p_brand").alias("name"), F.concat(F.lit("calendars/x"), F.when(F.col("p_partkey") % 2 == 0, "-spa-old").otherwise("-b")).alias("calendar"))
    out = O.zone_import(schedules, options, entries, index, ZONE_RULES, "x")
    if twice:
        out = O.zone_import(schedules, options, cut(out["entries"]), cut(out["index"]), ZONE_RULES, "x")
    return out


@query("h03_zone_import", f"WITH {IMPORT} SELECT calendar_id, date, CAST(bin AS INTEGER) AS bin FROM af")
def h03_import(spark: SparkSession, sf: str) -> DataFrame:
    return imported(spark, sf)["entries"]


@query("h03_zone_import_again", f"WITH {IMPORT} SELECT calendar_id, date, CAST(bin AS INTEGER) AS bin FROM af")
def h03_import_again(spark: SparkSession, sf: str) -> DataFrame:
    """The same import over its own result."""
    return imported(spark, sf, twice=True)["entries"]


@query(
    "h03_zone_index",
    f"""WITH {IMPORT} SELECT DISTINCT 'x' AS comune, p_brand AS name, 'calendars/x-b' AS calendar FROM part WHERE p_size = 7 AND p_partkey % 2 = 1
    UNION SELECT 'x', 'Via ' || id, calendar FROM ls UNION SELECT 'x', 'Zona ' || zone, 'calendars/x-spa-' || slug FROM zn""",
)
def h03_index(spark: SparkSession, sf: str) -> DataFrame:
    return imported(spark, sf)["index"]


BASES = f"""{SETS}, {CAL_N},
st AS (SELECT c_custkey AS street, 'n' || c_nationkey AS base, 1 AS sp FROM customer
  UNION ALL SELECT c_custkey, 'n' || c_nationkey || '-p2', 2 FROM customer WHERE c_mktsegment = 'BUILDING'),
bs AS (SELECT street, arg_max(base, (sp, base)) AS base FROM st GROUP BY 1),
mp AS (SELECT street, base, keyset, base || '-plus-' || keyset AS calendar_id FROM bs JOIN ids USING (street)),
combo AS (SELECT DISTINCT base, keyset, calendar_id FROM mp)"""


def composites(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    customer = V.table(spark, sf, "customer")
    nation = F.concat(F.lit("n"), "c_nationkey")
    options = F.array(
        F.struct(nation.alias("base"), F.lit(1).alias("specificity")),
        F.when(
            F.col("c_mktsegment") == "BUILDING",
            F.struct(F.concat(nation, F.lit("-p2")).alias("base"), F.lit(2).alias("specificity")),
        ),
    )
    streets = customer.select(
        F.col("c_custkey").alias("street"), F.explode(F.array_compact(options)).alias("o")
    ).select("street", "o.*")
    keys, dates = street_keys(spark, sf)
    bases = V.cal_n(spark, sf).where(F.year("date") == 1998)
    return O.composites(streets, keys, bases, dates, 3)


@query("h04_composite_mapping", f"WITH {BASES} SELECT street, calendar_id FROM mp")
def h04(spark: SparkSession, sf: str) -> DataFrame:
    return composites(spark, sf)[0]


@query(
    "h04_composite_entries",
    f"""WITH {BASES}, e AS (SELECT combo.calendar_id, date, bin FROM combo JOIN cal_n ON cal_n.calendar_id = base AND year(date) = 1998 AND bin <> 3
      UNION SELECT combo.calendar_id, date, 3 FROM combo JOIN zd ON contains('+' || keyset || '+', '+' || key || '+'))
    SELECT calendar_id, bin, count(*) AS n, min(date) AS first, max(date) AS last FROM e GROUP BY 1, 2""",
)
def h04_entries(spark: SparkSession, sf: str) -> DataFrame:
    return composites(spark, sf)[1].groupBy("calendar_id", "bin").agg(
        F.count(F.lit(1)).alias("n"), F.min("date").alias("first"), F.max("date").alias("last")
    )


@query(
    "h04_composite_status",
    f"""WITH {SETS}, b AS (SELECT c_custkey AS street FROM customer WHERE c_acctbal > 0), o AS (SELECT DISTINCT street FROM sk)
    SELECT CASE WHEN b.street IS NOT NULL AND o.street IS NOT NULL THEN 'composite' WHEN b.street IS NOT NULL THEN 'no overlay' ELSE 'no base' END AS status, count(*) AS streets
    FROM b FULL JOIN o ON b.street = o.street GROUP BY 1""",
)
def h04_status(spark: SparkSession, sf: str) -> DataFrame:
    streets = V.table(spark, sf, "customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("street"))
    return O.composite_status(streets, street_keys(spark, sf)[0])


@query(
    "h05_prefer_then_fill",
    f"""WITH {STREET} SELECT DISTINCT street || comune AS street, 'S:' || code AS code FROM street WHERE calendar_id > 25
    UNION SELECT DISTINCT street || comune, 'C:' || calendar_id FROM street WHERE street || comune NOT IN (SELECT street || comune FROM street WHERE calendar_id > 25)""",
)
def h05(spark: SparkSession, sf: str) -> DataFrame:
    s = V.street(spark, sf)
    name = F.concat("street", "comune").alias("street")
    first = s.where("calendar_id > 25").select(name, "code")
    second = s.select(name, F.col("calendar_id").alias("code"))
    return O.prefer_then_fill(first, second, "street", "code", ("S", "C"))


IDX = "ex AS (SELECT p_type AS comune, p_name AS name, CASE WHEN p_size % 4 = 0 THEN p_brand || '-spa-' || p_size ELSE p_brand END AS calendar FROM part)"


def existing(spark: SparkSession, sf: str) -> DataFrame:
    size = F.col("p_size")
    return V.table(spark, sf, "part").select(
        F.col("p_type").alias("comune"), F.col("p_name").alias("name"),
        F.when(size % 4 == 0, F.concat("p_brand", F.lit("-spa-"), "p_size")).otherwise(F.col("p_brand")).alias("calendar"),
    )


@query(
    "h06_rebuild_index",
    f"""WITH {IDX} SELECT * FROM ex UNION SELECT n_name, unnest(CASE WHEN s_suppkey % 3 = 0 THEN ['Zona ' || s_suppkey] ELSE ['Via ' || s_suppkey, 'Via A'] END), 'cal-' || s_suppkey
    FROM supplier JOIN nation ON s_nationkey = n_nationkey""",
)
def h06(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("s_suppkey")
    nation = V.table(spark, sf, "nation")
    found = V.table(spark, sf, "supplier").join(
        F.broadcast(nation), F.col("s_nationkey") == F.col("n_nationkey")
    ).select(
        F.col("n_name").alias("comune"), F.concat(F.lit("cal-"), k).alias("calendar"),
        F.concat(F.lit("Zona "), k).alias("zone_label"),
        F.when(k % 3 == 0, F.expr("cast(array() as array<string>)"))
        .otherwise(F.array(F.concat(F.lit("Via  "), k), F.lit("Via A"), F.lit("Via A ")))
        .alias("addresses"),
    )
    return O.rebuild_index(found, existing(spark, sf))


@query(
    "h07_reimport_index",
    f"""WITH {IDX}, nw AS (SELECT DISTINCT 'NEW' AS comune, p_name AS name, p_brand AS calendar FROM part WHERE p_brand IN ('Brand#1', 'Brand#2'))
    SELECT DISTINCT * FROM ex WHERE calendar NOT IN (SELECT calendar FROM nw) UNION SELECT * FROM nw""",
)
def h07(spark: SparkSession, sf: str) -> DataFrame:
    fresh = V.table(spark, sf, "part").where(F.col("p_brand").isin("Brand#1", "Brand#2")).select(
        F.lit("NEW").alias("comune"), F.col("p_name").alias("name"), F.col("p_brand").alias("calendar")
    )
    return O.reimport_index(fresh, existing(spark, sf))


@query(
    "h08_replace_generated",
    f"""WITH {IDX} SELECT DISTINCT * FROM ex WHERE NOT contains(calendar, '-spa-') UNION SELECT DISTINCT p_type, p_name, 'x-spa-' || p_brand FROM part""",
)
def h08(spark: SparkSession, sf: str) -> DataFrame:
    generated = V.table(spark, sf, "part").select(
        F.col("p_type").alias("comune"), F.col("p_name").alias("name"), F.concat(F.lit("x-spa-"), "p_brand").alias("calendar")
    )
    return O.replace_generated(existing(spark, sf), generated)


@query(
    "h09_manifest",
    f"""WITH {CAL}, y AS (SELECT calendar_id AS slug, year(date) AS year, count(*) AS n FROM cal GROUP BY 1, 2)
    SELECT slug, string_agg(year || '=' || n, ',' ORDER BY year) AS years, CAST(sum(n) AS BIGINT) AS entries FROM y GROUP BY 1""",
)
def h09(spark: SparkSession, sf: str) -> DataFrame:
    m = O.manifest(V.cal(spark, sf).withColumnRenamed("calendar_id", "slug"))
    pairs = F.transform(F.map_entries("years"), lambda e: F.concat_ws("=", e["key"], e["value"]))
    return m.select("slug", F.array_join(pairs, ",").alias("years"), "entries")


@query(
    "h09_failed_sources",
    """SELECT c_custkey AS slug, 'no entries' AS error FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE year(o_orderdate) = 2001)""",
)
def h09_failed(spark: SparkSession, sf: str) -> DataFrame:
    entries = V.cal(spark, sf).where(F.year("date") == 2001).select(F.col("calendar_id").alias("slug"))
    return O.failed_sources(V.table(spark, sf, "customer").select(F.col("c_custkey").alias("slug")), entries)
