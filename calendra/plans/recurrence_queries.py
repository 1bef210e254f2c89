"""Recurrence queries. Rule texts are derived from supplier and part rows; the SQL twins
compute the expected dates from the keys and never parse the text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from calendra.functions import rule_table as T
from calendra.functions import rules as R
from calendra.functions.dates import free_street_day
from calendra.operators import recurrence as E
from calendra.plans import views as V
from calendra.plans.registry import query

DAYS = ("lunedì", "martedì", "mercoledì", "giovedì", "venerdì", "sabato", "domenica")
MONTHS = tuple(m.lower() for m in R.MONTHS)
ROMAN = ("I", "II", "III", "IV", "V")
YEAR = 2026


def word(words: tuple[str, ...], zero_based: Column) -> Column:
    return F.element_at(F.array(*[F.lit(w) for w in words]), (zero_based + 1).cast("int"))


def keyed(spark: SparkSession, sf: str, name: str, key: str) -> DataFrame:
    return V.table(spark, sf, name).select(F.col(key).alias("k"))


DATES = f"""days AS (
  SELECT CAST(d AS DATE) AS date, isodow(d) - 1 AS wd, month(d) AS m, CAST(ceil(day(d) / 7e0) AS INTEGER) AS nth,
    month(d + INTERVAL 7 DAY) <> month(d) AS is_last
  FROM range(TIMESTAMP '{YEAR}-01-01', TIMESTAMP '{YEAR + 1}-01-01', INTERVAL 1 DAY) t(d))"""


@query(
    "d01_weekly_expansion",
    f"""WITH {DATES} SELECT s_suppkey AS zone, date FROM supplier JOIN days ON wd = s_suppkey % 7""",
)
def d01(spark: SparkSession, sf: str) -> DataFrame:
    sched = keyed(spark, sf, "supplier", "s_suppkey").select(
        F.col("k").alias("zone"), (F.col("k") % 7).cast("int").alias("weekday")
    )
    return E.expand_weekly(sched, F.lit(YEAR)).select("zone", "date")


@query(
    "d02_nth_weekday",
    f"""WITH {DATES} SELECT s_suppkey AS zone, date FROM supplier JOIN days ON wd = s_suppkey % 7
      AND (nth = s_suppkey % 6 OR (s_suppkey % 6 = 0 AND is_last))""",
)
def d02(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("k")
    nth = F.when(k % 6 == 0, -1).otherwise((k % 6).cast("int"))
    return E.expand(
        keyed(spark, sf, "supplier", "s_suppkey"),
        F.lit(YEAR), F.array((k % 7).cast("int")), R.all_months(), F.array(nth),
    ).select(F.col("k").alias("zone"), "date")


def rule_text(k: Column) -> Column:
    """Ordinals and weekday, service months for even keys, a stopped month for others."""
    return F.concat(
        word(ROMAN, k % 4), F.lit(" e "), word(ROMAN, (k + 2) % 4), F.lit(" "), word(DAYS, k % 7),
        F.when(
            k % 2 == 0,
            F.concat(F.lit(" del mese mesi di "), word(MONTHS, k % 12), F.lit(" "), word(MONTHS, (k + 5) % 12)),
        ).otherwise(
            F.concat(F.lit(" del mese servizio interrotto nei mesi di "), word(MONTHS, k % 12))
        ),
    )


RULE_SQL = f"""WITH {DATES} SELECT s_suppkey AS zone, date FROM supplier JOIN days ON wd = s_suppkey % 7
  AND nth IN (s_suppkey % 4 + 1, (s_suppkey + 2) % 4 + 1)
  AND (CASE WHEN s_suppkey % 2 = 0 THEN m IN (s_suppkey % 12 + 1, (s_suppkey + 5) % 12 + 1)
       ELSE m <> s_suppkey % 12 + 1 END)"""


@query("d03_rule_expansion", RULE_SQL)
def d03(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("k")
    df = keyed(spark, sf, "supplier", "s_suppkey").select(
        k.alias("zone"), word(DAYS, k % 7).alias("weekday"), rule_text(k).alias("rule")
    )
    return E.expand_rules(df, "weekday", "rule", F.lit(YEAR)).select("zone", "date")


@query("d03_rule_table_function", RULE_SQL)
def d03_table(spark: SparkSession, sf: str) -> DataFrame:
    """The same rules by the table function, in plain SQL."""
    T.register(spark)
    k = F.col("k")
    rules = keyed(spark, sf, "supplier", "s_suppkey").select(
        k.alias("zone"), word(DAYS, k % 7).alias("weekday"), rule_text(k).alias("rule")
    )
    return spark.sql(f"SELECT zone, date FROM {{rules}}, LATERAL expand_rule(weekday, rule, {YEAR})", rules=rules)


@query(
    "d04_month_scoped_rules",
    f"""WITH {DATES} SELECT DISTINCT s_suppkey AS zone, date FROM supplier JOIN days ON wd = s_suppkey % 7
      AND ((nth = s_suppkey % 4 + 1 AND m = s_suppkey % 12 + 1)
        OR (nth IN (1, 3) AND m IN ((s_suppkey + 3) % 12 + 1, (s_suppkey + 4) % 12 + 1)))""",
)
def d04(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("k")
    text = F.concat(
        word(ROMAN, k % 4), F.lit(" "), word(DAYS, k % 7), F.lit(" del mese ("), word(MONTHS, k % 12),
        F.lit(") I e III "), word(DAYS, k % 7), F.lit(" del mese ("),
        word(MONTHS, (k + 3) % 12), F.lit(" "), word(MONTHS, (k + 4) % 12), F.lit(")"),
    )
    df = keyed(spark, sf, "supplier", "s_suppkey").select(k.alias("zone"), text.alias("rule"))
    specs = E.scoped_specs(F.lit(YEAR), R.fold_rule(F.col("rule")))
    return E.expand_specs(df, F.lit(YEAR), specs).select("zone", "date")


FREQUENCIES = ("", " ultimo del mese", " una volta al mese", " ogni due mesi", " ogni due settimane")


def clause_text(k: Column) -> Column:
    return F.concat(word(DAYS, k % 7), word(FREQUENCIES, k % 5))


def clause_sql(key: str) -> str:
    return f"""wd = {key} % 7 AND CASE {key} % 5 WHEN 0 THEN true WHEN 1 THEN is_last WHEN 2 THEN nth = 1
      WHEN 3 THEN nth = 1 AND m % 2 = 1 ELSE nth IN (1, 3, 5) END"""


@query(
    "d05_clause_expansion",
    f"WITH {DATES} SELECT s_suppkey AS zone, date FROM supplier JOIN days ON {clause_sql('s_suppkey')}",
)
def d05(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("k")
    df = keyed(spark, sf, "supplier", "s_suppkey").select(k.alias("zone"), clause_text(k).alias("rule"))
    return E.expand_clauses(df, "rule", F.lit(YEAR)).select("zone", "date")


@query(
    "d06_seasonal_clauses",
    f"""WITH {DATES}, x AS (SELECT s_suppkey AS zone, s_suppkey % 5 AS a, 4 + s_suppkey % 2 AS b FROM supplier)
    SELECT zone, date FROM x JOIN days ON
      (m BETWEEN 3 AND 6 AND wd BETWEEN 0 AND b) OR (m BETWEEN 9 AND 11 AND wd BETWEEN 1 AND 4 AND wd <> a
        AND nth IN (1, 3, 5))""",
)
def d06(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("k")
    text = F.concat(
        F.lit("Dal lunedì al "), word(DAYS, 4 + k % 2), F.lit(" (marzo - giugno) dal martedì al venerdì escluso "),
        word(DAYS, k % 5), F.lit(" (settembre - novembre) ogni due settimane"),
    )
    df = keyed(spark, sf, "supplier", "s_suppkey").select(k.alias("zone"), text.alias("rule"))
    return E.expand_clauses(df, "rule", F.lit(YEAR)).select("zone", "date")


def ints(c: Column) -> Column:
    return F.array_join(F.array_sort(c).cast("array<string>"), ",")


@query(
    "d07_weekday_parse",
    """WITH x AS (SELECT p_partkey AS k, p_partkey % 7 AS a, (p_partkey // 7) % 7 AS b, (p_partkey // 3) % 7 AS c FROM part),
    y AS (SELECT k, CASE k % 3
      WHEN 0 THEN list_filter(range(0, 7), lambda d: CASE WHEN a <= b THEN d BETWEEN a AND b ELSE d >= a OR d <= b END)
      WHEN 1 THEN list_filter(range(0, 7), lambda d: d = a OR d = b)
      ELSE list_filter(range(0, 7), lambda d: d <> c AND CASE WHEN a <= b THEN d BETWEEN a AND b ELSE d >= a OR d <= b END) END AS days
      FROM x)
    SELECT k, array_to_string(days, ',') AS weekdays FROM y""",
)
def d07(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("k")
    a, b, c = (word(DAYS, e) for e in (k % 7, F.floor(k / 7) % 7, F.floor(k / 3) % 7))
    ranged = F.concat(F.lit("dal "), a, F.lit(" al "), b)
    text = (
        F.when(k % 3 == 0, ranged)
        .when(k % 3 == 1, F.concat(a, F.lit(" e "), b))
        .otherwise(F.concat(ranged, F.lit(" escluso "), c))
    )
    folded = keyed(spark, sf, "part", "p_partkey").withColumn("t", R.fold_rule(text))
    return folded.select("k", ints(R.weekdays_of(F.col("t"))).alias("weekdays"))


@query(
    "d08_month_parse",
    """WITH x AS (SELECT p_partkey AS k, p_partkey % 12 + 1 AS a, (p_partkey // 12) % 12 + 1 AS b FROM part),
    y AS (SELECT k, CASE WHEN k % 2 = 0
      THEN list_filter(range(1, 13), lambda d: CASE WHEN a <= b THEN d BETWEEN a AND b ELSE d >= a OR d <= b END)
      ELSE list_filter(range(1, 13), lambda d: d = a OR d = b) END AS ms FROM x)
    SELECT k, array_to_string(ms, ',') AS months FROM y""",
)
def d08(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("k")
    a, b = word(MONTHS, k % 12), word(MONTHS, F.floor(k / 12) % 12)
    text = F.when(k % 2 == 0, F.concat(F.lit("("), a, F.lit(" - "), b, F.lit(")"))).otherwise(
        F.concat(a, F.lit(", "), b)
    )
    folded = keyed(spark, sf, "part", "p_partkey").withColumn("t", R.fold_rule(text))
    return folded.select("k", ints(R.months_of(F.col("t"))).alias("months"))


@query(
    "d09_ordinal_parse",
    """SELECT p_partkey AS k, CASE WHEN p_partkey % 3 = 2 THEN ''
      WHEN p_partkey % 4 = (p_partkey // 4) % 4 THEN CAST(p_partkey % 4 + 1 AS VARCHAR)
      ELSE least(p_partkey % 4, (p_partkey // 4) % 4) + 1 || ',' || greatest(p_partkey % 4, (p_partkey // 4) % 4) + 1 END AS ordinals
    FROM part""",
)
def d09(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("k")
    words = ("primo", "II", "3", "IV")
    text = F.concat(
        word(words, k % 4), F.lit(" e "), word(words, F.floor(k / 4) % 4),
        F.when(k % 3 == 0, F.concat(F.lit(" "), word(DAYS, k % 7)))
        .when(k % 3 == 1, F.lit(" del mese"))
        .otherwise(F.lit(" piano terra")),
    )
    return keyed(spark, sf, "part", "p_partkey").select(
        "k", ints(R.ordinals_of(R.fold_rule(text))).alias("ordinals")
    )


@query(
    "d10_active_stopped_months",
    """SELECT p_partkey AS k,
      CASE WHEN p_partkey % 3 = 2 THEN '' WHEN p_partkey % 12 + 1 = 6 THEN '6'
        ELSE least(p_partkey % 12 + 1, 6) || ',' || greatest(p_partkey % 12 + 1, 6) END AS active,
      CASE WHEN p_partkey % 3 <> 2 THEN '' WHEN p_partkey % 2 = 0 OR p_partkey % 12 + 1 = 9 THEN CAST(p_partkey % 12 + 1 AS VARCHAR)
        ELSE least(p_partkey % 12 + 1, 9) || ',' || greatest(p_partkey % 12 + 1, 9) END AS stopped
    FROM part""",
)
def d10(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("k")
    m = word(MONTHS, k % 12)
    text = (
        F.when(k % 3 == 0, F.concat(F.lit("Servizio attivo nei mesi di "), m, F.lit(" (1/30) - giugno I e III lunedì")))
        .when(k % 3 == 1, F.concat(F.lit("II martedì del mese mesi di "), m, F.lit(" e giugno")))
        .when(k % 2 == 0, F.concat(F.lit("Servizio interrotto nei mesi di "), m, F.lit(" offerta luglio")))
        .otherwise(F.concat(F.lit("Interrotto nel mese di "), m, F.lit(" offerta settembre mattino luglio")))
    )
    t = F.col("t")
    return keyed(spark, sf, "part", "p_partkey").withColumn("t", R.fold_rule(text)).select(
        "k", ints(R.active_months_of(t)).alias("active"), ints(R.stopped_months_of(t)).alias("stopped")
    )


@query(
    "d11_free_street_days",
    """SELECT DISTINCT CAST(o_orderdate AS DATE) AS date FROM orders
    WHERE month(o_orderdate) IN (3, 5, 7, 9, 11) AND day(o_orderdate) <= 7 AND isodow(o_orderdate) = 1""",
)
def d11(spark: SparkSession, sf: str) -> DataFrame:
    dates = V.table(spark, sf, "orders").select(F.to_date("o_orderdate").alias("date")).distinct()
    return dates.where(free_street_day(F.col("date")))


@query(
    "d12_dates_for_codes",
    f"""WITH {DATES} SELECT DISTINCT s_nationkey AS target, date FROM supplier JOIN days ON {clause_sql('s_suppkey')}""",
)
def d12(spark: SparkSession, sf: str) -> DataFrame:
    supplier = V.table(spark, sf, "supplier")
    k = F.col("k")
    dated = E.expand_clauses(
        supplier.select(F.col("s_suppkey").alias("k")).select(k.alias("code"), clause_text(k).alias("rule")),
        "rule", F.lit(YEAR),
    )
    choices = supplier.select(F.col("s_nationkey").alias("target"), F.col("s_suppkey").alias("code"))
    return E.dates_for_codes(choices, dated, YEAR)


@query(
    "d13_rule_preference",
    """WITH g AS (SELECT o_custkey AS zone, o_orderkey AS rule_id,
        CASE CAST(left(o_orderpriority, 1) AS INTEGER) WHEN 1 THEN 0 WHEN 2 THEN 1 WHEN 3 THEN 2 WHEN 4 THEN 3 ELSE 2 END AS rank
      FROM orders),
    b AS (SELECT *, min(rank) OVER (PARTITION BY zone) AS best FROM g)
    SELECT zone, rule_id, CAST(rank AS INTEGER) AS rank FROM b WHERE rank = best""",
)
def d13(spark: SparkSession, sf: str) -> DataFrame:
    p = F.left("o_orderpriority", F.lit(1))
    rules = V.table(spark, sf, "orders").select(
        F.col("o_custkey").alias("zone"),
        F.col("o_orderkey").alias("rule_id"),
        F.when(p == "2", F.lit("Meccanizzato")).otherwise(F.lit("Manuale")).alias("type"),
        F.when(p == "1", F.lit("I e III lunedì del mese"))
        .when(p == "3", F.lit("mattino"))
        .when(p == "5", F.lit("pomeriggio"))
        .otherwise(F.lit(""))
        .alias("rule"),
    )
    return E.preferred_rules(rules, "zone").select("zone", "rule_id", "rank")
