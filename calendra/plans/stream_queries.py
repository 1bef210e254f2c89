"""Reminder queries: batch plans with SQL twins, and Structured Streaming runs over events."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from calendra.functions.lineage import shared_folder
from calendra.plans import views as V
from calendra.plans.registry import query
from calendra.plans.views import CAL
from calendra.streaming import dispatch as P
from calendra.streaming import reminders as R
from calendra.streaming import subscriptions as S

# Civil time in SQL by the European rule: last Sundays of March and October at 01:00 UTC.
ROME_SQL = """({t} + CASE WHEN {t} >= make_timestamp(year({t}), 3, 31, 1, 0, 0) - to_days(CAST(isodow(make_date(year({t}), 3, 31)) % 7 AS INTEGER))
  AND {t} < make_timestamp(year({t}), 10, 31, 1, 0, 0) - to_days(CAST(isodow(make_date(year({t}), 10, 31)) % 7 AS INTEGER)) THEN INTERVAL 2 HOUR ELSE INTERVAL 1 HOUR END)"""


def rome_sql(t: str) -> str:
    return ROME_SQL.format(t=t)


@query(
    "l01_civil_time",
    f"""WITH x AS (SELECT event_id, ts + to_days(CAST(event_id % 366 AS INTEGER)) AS t FROM events), y AS (SELECT event_id, {rome_sql('t')} AS r FROM x)
    SELECT event_id, CAST(r AS DATE) AS civil_date, CAST(hour(r) AS INTEGER) AS civil_hour FROM y""",
)
def l01(spark: SparkSession, sf: str) -> DataFrame:
    shifted = F.col("ts") + F.make_dt_interval((F.col("event_id") % 366).cast("int"))
    date, hour = P.civil_parts(shifted)
    return V.table(spark, sf, "events").select("event_id", date.alias("civil_date"), hour.alias("civil_hour"))


def requests_of(events: DataFrame) -> DataFrame:
    """Events as subscription requests: errors unsubscribe, some requests are invalid."""
    k = F.regexp_extract("props", r"(\d+)", 1).cast("int")
    scheme = F.when(F.col("value") > 450, F.lit("http://")).otherwise(F.lit("https://"))
    return events.select(
        F.col("event_id").alias("seq"), "ts",
        F.when(F.col("event_type") == "error", F.lit("unsubscribe")).otherwise(F.lit("subscribe")).alias("action"),
        F.concat(scheme, F.lit("push.example/"), "user_id").alias("endpoint"),
        F.lit("p").alias("p256dh"), F.lit("a").alias("auth"),
        F.concat(F.when(k % 10 == 9, F.lit("other/c")).otherwise(F.lit("calendars/c")), "user_id", F.lit("-2026.h")).alias("calendar_id"),
        (k % 30).cast("string").alias("hour"),
    )


STATE_SQL = """rq AS (SELECT event_id AS seq, ts, event_type = 'error' AS un, CASE WHEN value > 450 THEN 'http://' ELSE 'https://' END || 'push.example/' || user_id AS endpoint,
  CAST(regexp_extract(props, '(\\d+)', 1) AS INTEGER) AS k, user_id FROM events),
ok AS (SELECT sha256(endpoint) AS key, * FROM rq WHERE un OR (starts_with(endpoint, 'https://') AND k % 10 <> 9)),
ld AS (SELECT key, max((ts, seq)) FILTER (un) AS d FROM ok GROUP BY 1),
st AS (SELECT ok.key, arg_max(un, (ts, seq)) AS gone, arg_max(endpoint, (ts, seq)) AS endpoint, arg_max('calendars/c' || user_id, (ts, seq)) AS calendar_id,
  arg_max(CASE WHEN k % 30 BETWEEN 1 AND 23 THEN k % 30 ELSE 20 END, (ts, seq)) AS hour,
  min(ts) FILTER (NOT un AND (d IS NULL OR (ts, seq) > d)) AS created_at, max(ts) AS updated_at FROM ok JOIN ld ON ok.key = ld.key GROUP BY 1)"""
LIVE_SQL = f"WITH {STATE_SQL} SELECT key, endpoint, calendar_id, CAST(hour AS INTEGER) AS hour, created_at, updated_at FROM st WHERE NOT gone"


def two_batches(spark: SparkSession, sf: str) -> str:
    """The change log of all events in two batches, the second upon the state of the first."""
    path = f"{shared_folder(spark)}/subs-{uuid.uuid4().hex}/state"
    events = V.table(spark, sf, "events")
    at = F.unix_micros(F.col("ts").cast("timestamp"))
    middle = events.agg(F.percentile_approx(at, 0.5)).first()[0]
    for batch, part in enumerate((at <= F.lit(middle), at > F.lit(middle))):
        S.apply_batch(requests_of(events.where(part)), path, batch)
    return path


@query("l02_subscription_upsert", LIVE_SQL)
def l02(spark: SparkSession, sf: str) -> DataFrame:
    return S.read_state(spark, two_batches(spark, sf)).select("key", "endpoint", "calendar_id", "hour", "created_at", "updated_at")


def event_stream(spark: SparkSession, sf: str) -> DataFrame:
    """The events table as a file stream."""
    schema = V.table(spark, sf, "events").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf)


@query("l02_subscription_stream", LIVE_SQL)
def l02_stream(spark: SparkSession, sf: str) -> DataFrame:
    """The same upsert as a Structured Streaming query that writes a change log."""
    root = f"{shared_folder(spark)}/subs-{uuid.uuid4().hex}"
    running = S.subscribe_stream(requests_of(event_stream(spark, sf)), f"{root}/state", f"{root}/cp")
    running.awaitTermination()
    return S.read_state(spark, f"{root}/state").select("key", "endpoint", "calendar_id", "hour", "created_at", "updated_at")


@query(
    "l03_unsubscribe",
    f"WITH {STATE_SQL} SELECT key, updated_at FROM st WHERE gone",
)
def l03(spark: SparkSession, sf: str) -> DataFrame:
    log = S.read_log(spark, two_batches(spark, sf), S.LOG_SCHEMA)
    newest = log.groupBy("key").agg(F.max_by(F.struct("updated_at", "deleted"), "batch").alias("s"))
    return newest.where("s.deleted").select("key", "s.updated_at")


@query(
    "l03_request_errors",
    """WITH x AS (SELECT event_id, event_type = 'error' AS un, event_id % 20 = 0 AS blank, value > 450 OR CAST(regexp_extract(props, '(\\d+)', 1) AS INTEGER) % 10 = 9 AS bad FROM events)
    SELECT event_id AS seq, CASE WHEN un THEN 'missing_endpoint' ELSE 'invalid' END AS error FROM x WHERE (un AND blank) OR (NOT un AND (bad OR blank))""",
)
def l03_errors(spark: SparkSession, sf: str) -> DataFrame:
    rq = requests_of(V.table(spark, sf, "events")).withColumn(
        "endpoint", F.when(F.col("seq") % 20 != 0, F.col("endpoint"))
    )
    return rq.withColumn("error", S.request_error(F.col("action"))).where("error IS NOT NULL").select("seq", "error")


# Subscriptions from customers, one tick at the latest event time moved to autumn 1998.
SUBS = """sub AS (SELECT sha256(c_name) AS key, CASE WHEN c_custkey % 20 = 0 THEN '' ELSE 'https://p/' || c_custkey END AS endpoint,
  CASE WHEN c_custkey % 13 = 0 THEN c_custkey + 1000000 ELSE c_custkey END AS calendar_id,
  CASE WHEN c_custkey % 29 = 0 THEN '7.5' ELSE CAST(1 + c_custkey % 23 AS VARCHAR) END AS hour,
  CASE WHEN c_custkey % 7 = 0 THEN DATE '1998-10-25' WHEN c_custkey % 7 = 1 THEN DATE '1998-10-24' END AS last_sent_date, c_custkey FROM customer)"""
TICK = "1998-10-25 18:05:00"


def subs(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("c_custkey")
    return V.table(spark, sf, "customer").select(
        F.sha2("c_name", 256).alias("key"),
        F.when(k % 20 == 0, F.lit("")).otherwise(F.concat(F.lit("https://p/"), k)).alias("endpoint"),
        F.when(k % 13 == 0, k + 1_000_000).otherwise(k).alias("calendar_id"),
        F.when(k % 29 == 0, F.lit("7.5")).otherwise((1 + k % 23).cast("string")).alias("hour"),
        F.when(k % 7 == 0, F.to_date(F.lit("1998-10-25"))).when(k % 7 == 1, F.to_date(F.lit("1998-10-24"))).alias("last_sent_date"),
        "c_custkey",
    )


@query("l04_list_valid", f"WITH {SUBS} SELECT key, endpoint FROM sub WHERE endpoint <> ''")
def l04(spark: SparkSession, sf: str) -> DataFrame:
    return S.list_valid(subs(spark, sf)).select("key", "endpoint")


PLAN = f"""{SUBS}, {CAL},
kn AS (SELECT DISTINCT calendar_id FROM cal WHERE year(date) IN (1998, 1999)),
bn AS (SELECT calendar_id, string_agg(bin, ',' ORDER BY bin) AS bins FROM cal WHERE date = DATE '1998-10-26' GROUP BY 1),
pl AS (SELECT sub.*, CASE WHEN contains(hour, '.') OR CAST(hour AS DOUBLE) > 19 THEN 'not due' WHEN last_sent_date = DATE '1998-10-25' THEN 'done today'
    WHEN kn.calendar_id IS NULL THEN 'no calendar' WHEN bins IS NULL THEN 'empty day' ELSE 'send' END AS status, bins
  FROM sub LEFT JOIN kn ON kn.calendar_id = sub.calendar_id LEFT JOIN bn ON bn.calendar_id = sub.calendar_id)"""


def planned(spark: SparkSession, sf: str) -> DataFrame:
    tick = F.lit(TICK).cast("timestamp_ntz")
    return P.plan(subs(spark, sf), V.cal(spark, sf), tick, (1998, 1999))


@query(
    "l05_dispatch_plan",
    f"WITH {PLAN} SELECT key, status, CASE WHEN status = 'send' THEN bins ELSE '' END AS bins, DATE '1998-10-26' AS pickup_date FROM pl",
)
def l05(spark: SparkSession, sf: str) -> DataFrame:
    bins = F.coalesce(F.array_join(F.col("bins").cast("array<string>"), ","), F.lit(""))
    return planned(spark, sf).select("key", "status", bins.alias("bins"), "pickup_date")


def outcomes(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("c_custkey") % 5
    code = F.when(k == 0, 410).when(k == 1, 500).when(k == 2, 404).otherwise(201)
    return V.table(spark, sf, "customer").select(F.sha2("c_name", 256).alias("key"), code.alias("status"))


FOLD = f"""{PLAN}, fo AS (SELECT key, status, last_sent_date, CASE WHEN status <> 'send' THEN 'skipped' WHEN c_custkey % 5 IN (0, 2) THEN 'removed' WHEN c_custkey % 5 = 1 THEN 'error' ELSE 'sent' END AS result FROM pl)"""


@query(
    "l06_fold_outcomes",
    f"WITH {FOLD} SELECT key, result, result = 'removed' AS deleted, CASE WHEN result = 'sent' OR status = 'empty day' THEN DATE '1998-10-25' ELSE last_sent_date END AS last_sent_date FROM fo",
)
def l06(spark: SparkSession, sf: str) -> DataFrame:
    folded = P.fold_outcomes(planned(spark, sf), outcomes(spark, sf))
    return folded.select("key", "result", "deleted", "last_sent_date")


@query(
    "l07_tick_summary",
    f"""WITH {FOLD} SELECT DATE '1998-10-25' AS tick_date, count(*) FILTER (result = 'sent') AS sent, count(*) FILTER (result = 'skipped') AS skipped,
    count(*) FILTER (result = 'removed') AS removed, count(*) FILTER (result = 'error') AS errors, count(*) AS total FROM fo""",
)
def l07(spark: SparkSession, sf: str) -> DataFrame:
    return P.summarise(P.fold_outcomes(planned(spark, sf), outcomes(spark, sf)))


@query(
    "l08_first_of_day",
    f"""WITH x AS (SELECT *, CAST({rome_sql('ts')} AS DATE) AS civil_date FROM events)
    SELECT user_id, civil_date, min(ts) AS ts, arg_min(event_id, (ts, event_id)) AS event_id FROM x GROUP BY 1, 2""",
)
def l08(spark: SparkSession, sf: str) -> DataFrame:
    return P.first_of_day(V.table(spark, sf, "events"), "user_id", "ts", "event_id")


@query(
    "l08_once_a_day_stream",
    f"SELECT DISTINCT user_id, CAST({rome_sql('ts')} AS DATE) AS civil_date FROM events",
)
def l08_stream(spark: SparkSession, sf: str) -> DataFrame:
    """Structured Streaming with watermark and keyed state, written to a table."""
    root = f"{shared_folder(spark)}/daily-{uuid.uuid4().hex}"
    events = event_stream(spark, sf).select("user_id", F.col("ts").cast("timestamp").alias("ts"))
    running = (
        P.once_a_day(events, "user_id", "ts")
        .select("user_id", "civil_date")
        .writeStream.format("parquet")
        .option("checkpointLocation", f"{root}/cp")
        .trigger(availableNow=True)
        .start(f"{root}/out")
    )
    running.awaitTermination()
    return spark.read.schema("user_id bigint, civil_date date").parquet(f"{root}/out")


# Hours after the first midnight at which arrivals end: events come in so many slices.
ARRIVALS = (9, 21, 33, 45, 400)
SLICE_SQL = "CASE " + " ".join(f"WHEN ts < TIMESTAMP '2024-01-01' + INTERVAL {h} HOUR THEN {i}" for i, h in enumerate(ARRIVALS)) + f" ELSE {len(ARRIVALS)} END"


def arrivals(events: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Events as requests and as ticks, each with the slice it arrives in.

    Views are ticks: hours without one are missed, every fifth comes again a slice later.
    """
    start = F.lit("2024-01-01").cast("timestamp_ntz")
    slice_no = F.lit(len(ARRIVALS))
    for i, hour in reversed(list(enumerate(ARRIVALS))):
        slice_no = F.when(F.col("ts") < start + F.make_dt_interval(F.lit(0), F.lit(hour)), i).otherwise(slice_no)
    k = F.regexp_extract("props", r"(\d+)", 1).cast("int")
    action = F.when(F.col("event_type") == "error", "unsubscribe").when(F.col("event_type") == "click", "failed").otherwise("subscribe")
    cut_in = events.withColumn("slice", slice_no)
    instant = F.col("ts").cast("timestamp").alias("ts")
    requests = cut_in.where("event_type <> 'view'").select(
        F.col("user_id").cast("string").alias("key"), action.alias("action"), F.concat(F.lit("calendars/c"), "user_id").alias("calendar_id"),
        (1 + k % 23).alias("hour"), instant, F.col("event_id").alias("seq"), "slice",
    )
    again = F.when(F.col("event_id") % 5 == 0, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    ticks = cut_in.where("event_type = 'view'").withColumn("later", F.explode(again)).select(instant, (F.col("slice") + F.col("later")).alias("slice"))
    return requests, ticks


@query(
    "l08_reminder_stream",
    f"""WITH x AS (SELECT *, {SLICE_SQL} AS slice, epoch_us(ts) // 1000 AS ms, CAST(regexp_extract(props, '(\\d+)', 1) AS INTEGER) AS k FROM events),
    w AS (SELECT s AS slice, make_timestamp(max(ms) * 1000) AS now FROM x JOIN range({len(ARRIVALS) + 1}) r(s) ON slice <= s WHERE event_type = 'view' GROUP BY 1),
    c AS (SELECT slice, now, CAST({rome_sql('now')} AS DATE) AS day, hour({rome_sql('now')}) AS hr FROM w),
    st AS (SELECT user_id, c.slice, now, day, hr, max(x.ms) AS since, arg_max(1 + k % 23, (ts, event_id)) FILTER (event_type NOT IN ('click', 'error')) AS wish,
        max((ts, event_id)) FILTER (event_type NOT IN ('click', 'error')) AS on_at, max((ts, event_id)) FILTER (event_type = 'error') AS off_at,
        count(*) FILTER (event_type IN ('click', 'error')) AS life FROM x JOIN c ON x.slice <= c.slice WHERE event_type <> 'view' GROUP BY 1, 2, 3, 4, 5)
    SELECT CAST(user_id AS VARCHAR) AS key, 'calendars/c' || user_id AS calendar_id, day AS civil_date, min(now) AS sent_at FROM st
    WHERE wish <= hr AND (off_at IS NULL OR on_at > off_at) AND since <= epoch_us(now) // 1000 GROUP BY user_id, day, life""",
)
def l08_reminders(spark: SparkSession, sf: str) -> DataFrame:
    """Keyed state with timers over slices that arrive one after another."""
    root = f"{shared_folder(spark)}/reminders-{uuid.uuid4().hex}"
    requests, ticks = arrivals(V.table(spark, sf, "events"))

    def arrived(kind: str, df: DataFrame) -> DataFrame:
        schema = df.drop("slice").schema
        return spark.readStream.schema(schema).option("recursiveFileLookup", "true").parquet(f"{root}/{kind}")

    for number in range(len(ARRIVALS) + 1):
        for kind, df in (("requests", requests), ("ticks", ticks)):
            df.where(F.col("slice") == number).drop("slice").write.parquet(f"{root}/{kind}/{number}")
        due = R.reminders(arrived("requests", requests), arrived("ticks", ticks))
        R.start(due, f"{root}/out", f"{root}/cp").awaitTermination()
    sent = spark.read.schema(R.OUT).parquet(f"{root}/out")
    return sent.select("key", "calendar_id", "civil_date", F.col("sent_at").cast("timestamp_ntz").alias("sent_at"))


@query(
    "l09_calendar_memo",
    f"""WITH {SUBS}, {CAL} SELECT DISTINCT calendar_id, calendar_id IN (SELECT calendar_id FROM cal WHERE year(date) IN (1998, 1999)) AS known FROM sub""",
)
def l09(spark: SparkSession, sf: str) -> DataFrame:
    return P.calendar_memo(subs(spark, sf), V.cal(spark, sf), (1998, 1999))


@query(
    "l09_planned_stream",
    f"""WITH {CAL}, d AS (SELECT event_id, user_id AS calendar_id, CAST(ts AS DATE) - INTERVAL 26 YEAR + INTERVAL 1 DAY AS p FROM events),
    a AS (SELECT * FROM cal WHERE year(date) = 1998), kn AS (SELECT DISTINCT calendar_id FROM a),
    bn AS (SELECT calendar_id, date, string_agg(bin, ',' ORDER BY bin) AS bins FROM a GROUP BY 1, 2)
    SELECT event_id, CASE WHEN kn.calendar_id IS NULL THEN 'no calendar' WHEN bins IS NULL THEN 'empty day' ELSE 'send' END AS status, coalesce(bins, '') AS bins
    FROM d LEFT JOIN kn ON kn.calendar_id = d.calendar_id LEFT JOIN bn ON bn.calendar_id = d.calendar_id AND bn.date = CAST(p AS DATE)""",
)
def l09_planned(spark: SparkSession, sf: str) -> DataFrame:
    """A stream of due reminders (events moved to 1998) met with the calendars."""
    root = f"{shared_folder(spark)}/planned-{uuid.uuid4().hex}"
    due = event_stream(spark, sf).select(
        "event_id", F.col("user_id").alias("calendar_id"), F.date_add(F.add_months(F.to_date("ts"), -26 * 12), 1).alias("pickup_date")
    )
    bins = F.coalesce(F.array_join(F.col("bins").cast("array<string>"), ","), F.lit("")).alias("bins")
    out = R.planned(due, V.cal(spark, sf), (1998,)).select("event_id", "status", bins)
    out.writeStream.format("parquet").option("checkpointLocation", f"{root}/cp").trigger(availableNow=True).start(f"{root}/out").awaitTermination()
    return spark.read.schema("event_id bigint, status string, bins string").parquet(f"{root}/out")
