"""Calendar queries over entries derived from orders and events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from calendra.functions.dates import parse_ymd
from calendra.operators import calendars as C
from calendra.plans import views as V
from calendra.plans.registry import query
from calendra.plans.views import CAL, CAL_N, STREET, r

REF = "1998-03-30"


def joined(c: str):
    return F.array_join(F.col(c).cast("array<string>"), ",")


def bins_sql(where: str = "true") -> str:
    return f"""per_day AS (SELECT calendar_id, date, string_agg(bin, ',' ORDER BY bin) AS bins
      FROM cal WHERE {where} GROUP BY 1, 2)"""


@query("e01_bins_on_date", f"WITH {CAL}, {bins_sql()} SELECT calendar_id, bins FROM per_day WHERE date = DATE '{REF}'")
def e01(spark: SparkSession, sf: str) -> DataFrame:
    found = C.bins_on(V.cal(spark, sf), F.to_date(F.lit(REF)))
    return found.select("calendar_id", joined("bins").alias("bins"))


LAST_REQUEST = """req AS (SELECT o_custkey AS calendar_id, CAST(min(o_orderdate) AS DATE) - 1 AS ref_date FROM orders GROUP BY 1)"""


def requests(spark: SparkSession, sf: str) -> DataFrame:
    """One request per customer: the day before its first order."""
    first = F.to_date(F.min("o_orderdate"))
    return V.table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("calendar_id")).agg(
        F.date_add(first, -1).alias("ref_date")
    )


@query(
    "e02_pickups_tomorrow",
    f"""WITH {CAL}, {bins_sql()}, {LAST_REQUEST}
    SELECT r.calendar_id, ref_date, coalesce(bins, '') AS bins FROM req r
    LEFT JOIN per_day p ON p.calendar_id = r.calendar_id AND p.date = ref_date + 1""",
)
def e02(spark: SparkSession, sf: str) -> DataFrame:
    found = C.pickups_tomorrow(V.cal(spark, sf), requests(spark, sf))
    return found.select("calendar_id", "ref_date", joined("bins").alias("bins"))


BIN_DIM = "dim(bin, initial, name) AS (VALUES " + ", ".join(f"({b}, '{i}', '{n}')" for b, i, n in C.BINS) + ")"


@query(
    "e03_day_labels",
    f"""WITH {CAL}, {BIN_DIM}
    SELECT calendar_id, date, string_agg(coalesce(initial, '?'), '.' ORDER BY cal.bin) AS initials,
      string_agg(coalesce(name, '?'), ', ' ORDER BY cal.bin) AS names
    FROM cal LEFT JOIN dim USING (bin) GROUP BY 1, 2""",
)
def e03(spark: SparkSession, sf: str) -> DataFrame:
    return C.day_labels(V.cal(spark, sf))


@query(
    "e04_month_grid",
    f"""WITH {CAL}, {bins_sql()}, days AS (
      SELECT c_custkey AS calendar_id, CAST(d AS DATE) AS date FROM customer,
        range(TIMESTAMP '1998-03-01', TIMESTAMP '1998-04-01', INTERVAL 1 DAY) t(d))
    SELECT calendar_id, date, CAST(day(date) AS INTEGER) AS day, CAST(6 AS INTEGER) AS lead,
      CAST((6 + day(date) - 1) % 7 AS INTEGER) AS grid_col, CAST((6 + day(date) - 1) // 7 AS INTEGER) AS grid_row,
      coalesce(bins, '') AS bins, (month(date) % 2 = 1 AND month(date) <> 1 AND day(date) <= 7 AND isodow(date) = 1) AS free_street
    FROM days LEFT JOIN per_day USING (calendar_id, date)""",
)
def e04(spark: SparkSession, sf: str) -> DataFrame:
    everyone = V.table(spark, sf, "customer").select(F.col("c_custkey").alias("calendar_id"))
    grid = C.month_grid(V.cal(spark, sf), everyone, 1998, 3)
    return grid.withColumn("bins", joined("bins"))


@query(
    "e05_week_strip",
    f"""WITH {CAL}, {bins_sql()}, {LAST_REQUEST}, days AS (
      SELECT calendar_id, ref_date, ref_date + CAST(i AS INTEGER) AS date FROM req, range(7) t(i))
    SELECT calendar_id, ref_date, date, coalesce(bins, '') AS bins, date = ref_date AS is_today,
      (month(date) <> month(ref_date) OR year(date) <> year(ref_date)) AS other_month,
      (date <> ref_date AND month(date) <> month(date - 1)) AS month_start
    FROM days LEFT JOIN per_day USING (calendar_id, date)""",
)
def e05(spark: SparkSession, sf: str) -> DataFrame:
    strip = C.week_strip(V.cal(spark, sf), requests(spark, sf))
    return strip.withColumn("bins", joined("bins"))


@query(
    "e06_month_coverage",
    f"""WITH {CAL}, have AS (SELECT DISTINCT calendar_id, year(date) AS y, month(date) AS m FROM cal)
    SELECT c_custkey AS calendar_id, CAST(2000 AS INTEGER) AS year, CAST(mm AS INTEGER) AS month,
      CASE WHEN y IS NOT NULL THEN 'data' WHEN mm < 7 THEN 'past' ELSE 'missing' END AS state
    FROM customer CROSS JOIN range(1, 13) t(mm) LEFT JOIN have ON calendar_id = c_custkey AND y = 2000 AND m = mm""",
)
def e06(spark: SparkSession, sf: str) -> DataFrame:
    asked = V.table(spark, sf, "customer").select(
        F.col("c_custkey").alias("calendar_id"),
        F.lit(2000).alias("year"),
        F.explode(F.sequence(F.lit(1), F.lit(12))).alias("month"),
    )
    return C.month_coverage(V.cal(spark, sf), asked, F.to_date(F.lit("2000-07-15")))


@query(
    "e07_present_categories",
    f"""WITH ev AS (SELECT DISTINCT user_id AS calendar_id, CAST(6 AS INTEGER) AS bin FROM events WHERE event_type = 'error'),
    ids AS (SELECT DISTINCT user_id AS calendar_id FROM events), {BIN_DIM},
    b AS (SELECT calendar_id, bin FROM ids, dim WHERE bin < 6 UNION ALL SELECT * FROM ev)
    SELECT calendar_id, bin, initial FROM b JOIN dim USING (bin)""",
)
def e07(spark: SparkSession, sf: str) -> DataFrame:
    entries = V.table(spark, sf, "events").select(
        F.col("user_id").alias("calendar_id"),
        F.when(F.col("event_type") == "error", 6).otherwise(1).alias("bin"),
    )
    return C.present_categories(entries)


@query(
    "e08_evening_activation",
    f"""WITH {CAL}, {bins_sql('bin BETWEEN 0 AND 5')},
    t AS (SELECT event_id, user_id AS calendar_id, ts - INTERVAL 9131 DAY AS ts FROM events),
    x AS (SELECT event_id, ts, coalesce(bins, '') AS bins, hour(ts) >= 18 AND hour(ts) < 23 AS evening,
      (month(ts + INTERVAL 1 DAY) IN (3, 5, 7, 9, 11) AND day(ts + INTERVAL 1 DAY) <= 7 AND isodow(ts + INTERVAL 1 DAY) = 1) AS free
      FROM t LEFT JOIN per_day p ON p.calendar_id = t.calendar_id AND p.date = CAST(ts AS DATE) + 1)
    SELECT event_id, (evening AND (bins <> '' OR free)) AS lit,
      CASE WHEN evening AND bins <> '' AND NOT free THEN bins ELSE '' END AS lit_bins FROM x""",
)
def e08(spark: SparkSession, sf: str) -> DataFrame:
    # Events of January 2024 moved back to January 1999, where the calendars have entries.
    ticks = V.table(spark, sf, "events").select(
        "event_id",
        F.col("user_id").alias("calendar_id"),
        (F.col("ts") - F.expr("INTERVAL 9131 DAYS")).alias("ts"),
    )
    lit = C.evening_activation(V.cal(spark, sf), ticks)
    return lit.select("event_id", "lit", joined("lit_bins").alias("lit_bins"))


@query(
    "e09_parse_date",
    """WITH x AS (SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN strftime(o_orderdate, '%Y-%m-%d') WHEN 1 THEN strftime(o_orderdate, '%Y/%m/%d')
        WHEN 2 THEN strftime(o_orderdate, '%Y-') || '13-01' ELSE strftime(o_orderdate, '%Y') || '-02-' || printf('%02d', 28 + o_orderkey % 4) END AS text FROM orders)
    SELECT o_orderkey, text, CASE WHEN regexp_matches(text, '^\\d{4}-\\d{2}-\\d{2}$') THEN TRY_CAST(text AS DATE) END AS date FROM x""",
)
def e09(spark: SparkSession, sf: str) -> DataFrame:
    d, k = F.col("o_orderdate"), F.col("o_orderkey")
    text = (
        F.when(k % 4 == 0, F.date_format(d, "yyyy-MM-dd"))
        .when(k % 4 == 1, F.date_format(d, "yyyy/MM/dd"))
        .when(k % 4 == 2, F.concat(F.date_format(d, "yyyy-"), F.lit("13-01")))
        .otherwise(F.concat(F.date_format(d, "yyyy"), F.lit("-02-"), F.format_string("%02d", 28 + k % 4)))
    )
    return V.table(spark, sf, "orders").select("o_orderkey", text.alias("text")).withColumn(
        "date", parse_ymd(F.col("text"))
    )


@query(
    "e10_first_unsorted",
    """WITH s AS (SELECT o_custkey AS calendar_id, o_orderkey AS pos, o_orderdate,
      lag(o_orderdate) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS p FROM orders)
    SELECT calendar_id, min(pos) AS first_unsorted FROM s WHERE o_orderdate < p GROUP BY 1""",
)
def e10(spark: SparkSession, sf: str) -> DataFrame:
    entries = V.table(spark, sf, "orders").select(
        F.col("o_custkey").alias("calendar_id"), F.col("o_orderkey").alias("pos"), "o_orderdate"
    )
    return C.first_unsorted(entries, "pos", "o_orderdate", bucket_rows=4096)


PROFILE = f"""{CAL_N},
prof AS (SELECT calendar_id, CAST(year(date) AS INTEGER) AS year, count(*) AS entries,
  CAST(count(DISTINCT month(date)) AS INTEGER) AS months, list_sort(list(DISTINCT bin)) AS bins
  FROM cal_n GROUP BY 1, 2)"""


@query(
    "e11_calendar_profile",
    f"WITH {PROFILE} SELECT calendar_id, year, entries, months, array_to_string(bins, ',') AS bins FROM prof",
)
def e11(spark: SparkSession, sf: str) -> DataFrame:
    return C.calendar_profile(V.cal_n(spark, sf)).withColumn("bins", joined("bins"))


def q(p: float) -> str:
    return f"list_sort(list(entries))[CAST(round_even({p}e0 * (count(*) - 1), 0) AS BIGINT) + 1]"


CLASSIFIED = f"""{PROFILE},
quart AS (SELECT year, count(*) AS n, median(entries) AS median_entries, {q(0.25)} AS q1, {q(0.75)} AS q3 FROM prof GROUP BY 1),
fence AS (SELECT *, CASE WHEN n >= 4 THEN q1 - 1.5e0 * (q3 - q1) END AS low, CASE WHEN n >= 4 THEN q3 + 1.5e0 * (q3 - q1) END AS high FROM quart),
cls AS (SELECT calendar_id, prof.year, entries, months, bins, median_entries, low, high, CASE
  WHEN entries < 10 THEN 'broken'
  WHEN low IS NULL THEN 'ok'
  WHEN (bins = [2] AND entries BETWEEN 20 AND 60 AND months >= 10) OR (bins = [4] AND entries BETWEEN 8 AND 30 AND months >= 7)
    OR (bins = [6] AND entries BETWEEN 10 AND 60 AND months >= 8) THEN 'ok'
  WHEN entries < 50 THEN 'critical' WHEN entries < low THEN 'alert' WHEN entries > high THEN 'high' ELSE 'ok' END AS severity
  FROM prof JOIN fence ON prof.year = fence.year)"""


def classified(spark: SparkSession, sf: str) -> DataFrame:
    return C.classify(C.calendar_profile(V.cal_n(spark, sf)))


@query("e12_anomaly_class", f"WITH {CLASSIFIED} SELECT calendar_id, year, entries, low, high, severity FROM cls")
def e12(spark: SparkSession, sf: str) -> DataFrame:
    return classified(spark, sf).select("calendar_id", "year", "entries", "low", "high", "severity")


@query(
    "e13_anomaly_report",
    f"""WITH {CLASSIFIED} SELECT year, count(*) AS total, any_value(median_entries) AS median_entries,
      {r("sum(entries)::DOUBLE / count(*)", 1)} AS mean_entries, min(entries) AS min_entries, max(entries) AS max_entries,
      {', '.join(f"count(*) FILTER (severity = '{s}') AS {s}" for s in ('broken', 'critical', 'alert', 'high', 'ok'))},
      {', '.join(f"count(*) FILTER (entries >= {lo}{'' if hi is None else f' AND entries < {hi}'}) AS b_{lo}" for _, lo, hi in C.BUCKETS)}
    FROM cls GROUP BY 1""",
)
def e13(spark: SparkSession, sf: str) -> DataFrame:
    return C.anomaly_report(classified(spark, sf))


@query(
    "e13_anomaly_alerts",
    f"""WITH {CLASSIFIED} SELECT calendar_id, year, entries, months, array_to_string(bins, ',') AS bins, severity
    FROM cls WHERE severity <> 'ok'""",
)
def e13_alerts(spark: SparkSession, sf: str) -> DataFrame:
    alerts = classified(spark, sf).where(F.col("severity") != "ok").orderBy(*C.alert_order())
    return alerts.select("calendar_id", "year", "entries", "months", joined("bins").alias("bins"), "severity")


@query(
    "e14_quality_gate",
    f"""WITH {CLASSIFIED} SELECT year, bool_or(severity IN ('broken', 'critical')) AS failed FROM cls GROUP BY 1""",
)
def e14(spark: SparkSession, sf: str) -> DataFrame:
    return C.gate(classified(spark, sf), "critical")


# Streets point to the calendars of customers; some sizes have no order in the years checked.
ERRORS = f"""{CAL}, {STREET},
act AS (SELECT DISTINCT CAST(calendar_id AS VARCHAR) AS calendar_id FROM cal WHERE year(date) = 2001),
st AS (SELECT street_id, comune, street, CASE WHEN street_id % 50 = 0 THEN '' ELSE CAST(calendar_id * 7 AS VARCHAR) END AS calendar_id FROM street),
err AS (SELECT *, CASE WHEN calendar_id = '' THEN 'blank calendar' ELSE 'no entries in active years' END AS error
  FROM st WHERE calendar_id NOT IN (SELECT calendar_id FROM act))"""


def errors(spark: SparkSession, sf: str) -> DataFrame:
    sid = F.col("street_id")
    path = F.when(sid % 50 == 0, F.lit("")).otherwise((F.col("calendar_id") * 7).cast("string"))
    streets = V.street(spark, sf).select("street_id", "comune", "street", path.alias("calendar_id"))
    return C.reference_errors(streets, V.cal(spark, sf), [2001])


@query("e15_reference_errors", f"WITH {ERRORS} SELECT street_id, comune, calendar_id, error FROM err")
def e15(spark: SparkSession, sf: str) -> DataFrame:
    return errors(spark, sf).select("street_id", "comune", "calendar_id", "error")


@query(
    "e15_places_without_streets",
    """SELECT n_name AS comune FROM nation WHERE n_nationkey NOT IN (SELECT s_nationkey - s_nationkey % 3 FROM supplier)""",
)
def e15_places(spark: SparkSession, sf: str) -> DataFrame:
    nation = V.table(spark, sf, "nation").select("n_nationkey", F.col("n_name").alias("comune"))
    placed = F.col("s_nationkey") - F.col("s_nationkey") % 3  # leaves two of three nations without
    supplier = V.table(spark, sf, "supplier").join(F.broadcast(nation), placed == F.col("n_nationkey"))
    return C.without_streets(nation.select("comune"), supplier.select("comune"))


@query(
    "e16_failure_digest",
    f"""WITH {ERRORS}, rk AS (SELECT *, comune || ' / ' || street AS label,
      row_number() OVER (PARTITION BY calendar_id ORDER BY comune || ' / ' || street, street_id) AS rn FROM err),
    hd AS (SELECT calendar_id, min(error) AS error, count(*) AS streets,
      string_agg(label, '; ' ORDER BY label) FILTER (rn <= 5) AS samples FROM rk GROUP BY 1),
    pl AS (SELECT calendar_id, comune, (row_number() OVER (PARTITION BY calendar_id ORDER BY comune) - 1) // 20 AS part FROM (SELECT DISTINCT calendar_id, comune FROM rk))
    SELECT calendar_id, part, error, streets, string_agg(comune, ', ' ORDER BY comune) AS places, samples FROM pl JOIN hd USING (calendar_id) GROUP BY ALL""",
)
def e16(spark: SparkSession, sf: str) -> DataFrame:
    return C.failure_digest(errors(spark, sf), places=20).orderBy(F.col("streets").desc(), "calendar_id", "part")


DIFF = f"""{CAL}, a AS (SELECT * FROM cal WHERE year(date) = 1998 AND bin <> 5),
b AS (SELECT * FROM cal WHERE year(date) IN (1998, 1999) AND bin <> 1),
yrs AS (SELECT DISTINCT calendar_id, year(date) AS y FROM a),
b2 AS (SELECT b.* FROM b SEMI JOIN yrs ON b.calendar_id = yrs.calendar_id AND year(b.date) = y),
cmp AS (SELECT *, CASE WHEN rr IS NULL THEN 'missing' WHEN ll IS NULL THEN 'extra' ELSE 'both' END AS status
  FROM (SELECT *, 1 AS ll FROM a) FULL JOIN (SELECT *, 1 AS rr FROM b2) USING (calendar_id, date, bin))"""


def compared(spark: SparkSession, sf: str) -> DataFrame:
    cal = V.cal(spark, sf)
    year = F.year("date")
    return C.diff(
        cal.where((year == 1998) & (F.col("bin") != 5)),
        cal.where(year.isin(1998, 1999) & (F.col("bin") != 1)),
    )


@query("e17_calendar_diff", f"WITH {DIFF} SELECT calendar_id, date, bin, status FROM cmp")
def e17(spark: SparkSession, sf: str) -> DataFrame:
    return compared(spark, sf)


@query(
    "e17_diff_counts",
    f"""WITH {DIFF} SELECT calendar_id, count(*) FILTER (status <> 'extra') AS expected, count(*) FILTER (status <> 'missing') AS extracted,
    count(*) FILTER (status = 'missing') AS missing, count(*) FILTER (status = 'extra') AS extra FROM cmp GROUP BY 1""",
)
def e17_counts(spark: SparkSession, sf: str) -> DataFrame:
    return C.diff_counts(compared(spark, sf))


@query(
    "e18_sole_members",
    """SELECT p_name || '@' || p_type AS comune, min(p_size) AS calendar_id FROM part GROUP BY 1 HAVING count(*) = 1""",
)
def e18(spark: SparkSession, sf: str) -> DataFrame:
    streets = V.street(spark, sf).select(
        F.concat_ws("@", "street", "comune").alias("comune"), "calendar_id"
    )
    return C.sole_members(streets, "comune", "calendar_id")
