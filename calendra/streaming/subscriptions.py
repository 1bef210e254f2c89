"""Reminder subscriptions: validation, keyed upsert and delete, batch and streaming.

State is kept as a change log: every micro-batch writes only the keys it touched, as full
rows or as deletions, into its own folder. A repeated batch overwrites its folder, so a
lost executor or a restarted query never applies a batch twice. Both logs are folded into
a base now and then (see ``log``), so reading them meets a bounded number of folders.
``compact`` copies the state of a batch into a new log. Dispatch writes its marks and removals to a log of its own; reading the
state joins both, so the two streams never wait for each other.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from calendra.sources.calendar_text import calendar_base
from calendra.streaming.log import FOLD_FROM, fold_if_long, read_log

# Default hour and zone, accepted address start.
DEFAULT_HOUR, ZONE = 20, "Europe/Rome"
ENDPOINT_START, CALENDAR_START = "https://", "calendars/"

STATE = [
    "key", "endpoint", "p256dh", "auth", "calendar_id", "hour", "tz", "created_at", "updated_at",
    "last_sent_date",
]
STATE_SCHEMA = (
    "key string, endpoint string, p256dh string, auth string, calendar_id string, hour int, tz string,"
    " created_at timestamp_ntz, updated_at timestamp_ntz, last_sent_date date"
)


def subscription_key(endpoint: Column) -> Column:
    return F.sha2(endpoint, 256)


def valid_subscription() -> Column:
    return (
        F.col("endpoint").startswith(ENDPOINT_START)
        & F.col("p256dh").isNotNull()
        & F.col("auth").isNotNull()
        & calendar_base(F.col("calendar_id")).startswith(CALENDAR_START)
    )


def request_error(action: Column) -> Column:
    """Why a request is refused; null when it is accepted."""
    no_endpoint = F.coalesce(F.col("endpoint"), F.lit("")) == ""
    return (
        F.when((action == "unsubscribe") & no_endpoint, F.lit("missing_endpoint"))
        .when((action == "subscribe") & ~F.coalesce(valid_subscription(), F.lit(False)), F.lit("invalid"))
    )


def accepted(requests: DataFrame) -> DataFrame:
    """Valid requests with key, cleaned calendar and hour (1..23, else the default)."""
    hour = F.col("hour").try_cast("double")
    whole = (hour == F.floor(hour)) & hour.between(1, 23)
    return requests.where(request_error(F.col("action")).isNull()).select(
        "action", "ts", "seq", subscription_key(F.col("endpoint")).alias("key"), "endpoint", "p256dh", "auth",
        calendar_base(F.col("calendar_id")).alias("calendar_id"),
        F.when(whole, hour.cast("int")).otherwise(DEFAULT_HOUR).alias("hour"),
    )


def changes(requests: DataFrame, current: DataFrame) -> DataFrame:
    """State rows of the keys a batch touches; ``deleted`` marks removals.

    The last request of a key decides. Creation time and last send survive unless the batch
    also deleted the key. Requests are combined map-side per key.
    """
    req = accepted(requests)
    at = F.struct("ts", "seq")
    dropped = req.where("action = 'unsubscribe'").groupBy("key").agg(F.max(at).alias("dropped_at"))
    kept = req.join(dropped, "key", "left")
    alive = (F.col("action") == "subscribe") & (F.col("dropped_at").isNull() | (at > F.col("dropped_at")))
    folded = kept.groupBy("key").agg(
        F.max_by(F.struct("action", "endpoint", "p256dh", "auth", "calendar_id", "hour", "ts"), at).alias("last"),
        F.min(F.when(alive, F.col("ts"))).alias("first_ts"),
        F.max(F.col("dropped_at").isNotNull()).alias("was_dropped"),
    )
    old = current.select("key", F.col("created_at").alias("old_created"), F.col("last_sent_date").alias("old_sent"))
    fresh = F.col("was_dropped")
    return folded.join(old, "key", "left").select(
        "key", "last.endpoint", "last.p256dh", "last.auth", "last.calendar_id", "last.hour",
        F.lit(ZONE).alias("tz"),
        F.when(fresh, F.col("first_ts")).otherwise(F.coalesce("old_created", "first_ts")).alias("created_at"),
        F.col("last.ts").alias("updated_at"),
        F.when(~fresh, F.col("old_sent")).alias("last_sent_date"),
        (F.col("last.action") == "unsubscribe").alias("deleted"),
    )


MARK_SCHEMA = "key string, tick_ts timestamp_ntz, last_sent_date date, removed boolean"


LOG_SCHEMA = f"{STATE_SCHEMA}, deleted boolean"


def newest_rows(log: DataFrame) -> DataFrame:
    """The last row of every key."""
    newest = F.max_by(F.struct(*STATE[1:], "deleted"), "batch")
    return log.groupBy("key").agg(newest.alias("s")).select("key", *[f"s.{c}" for c in (*STATE[1:], "deleted")])


def live_rows(log: DataFrame) -> DataFrame:
    """The state log folded: removed keys are as good as unknown ones."""
    return newest_rows(log).where("NOT deleted")


def last_marks(marks: DataFrame) -> DataFrame:
    """The mark log folded: the last mark and the last removal of every key."""
    last = F.max(F.struct("tick_ts", "last_sent_date")).alias("m")
    return marks.groupBy("key", "removed").agg(last).select("key", "m.*", "removed")


def read_state(
    spark: SparkSession, path: str, marks_path: str | None = None, before: int | None = None,
    marks_before: int | None = None,
) -> DataFrame:
    """Live subscriptions, optionally as of the start of a batch of either log."""
    live = newest_rows(read_log(spark, path, LOG_SCHEMA, before)).where("NOT deleted").drop("deleted")
    if marks_path is None:
        return live
    marks = read_log(spark, marks_path, MARK_SCHEMA, marks_before)
    per_key = marks.groupBy("key").agg(
        F.max(F.when(~F.col("removed"), F.struct("tick_ts", "last_sent_date"))).alias("mark"),
        F.max(F.when(F.col("removed"), F.col("tick_ts"))).alias("removed_at"),
    )
    # Marks and removals older than the subscription's own times belong to a former one.
    counts = F.col("mark.tick_ts") >= F.col("created_at")
    return (
        live.join(per_key, "key", "left")
        .where("removed_at IS NULL OR removed_at < updated_at")
        .withColumn("last_sent_date", F.when(counts, F.col("mark.last_sent_date")).otherwise(F.col("last_sent_date")))
        .select(*STATE)
    )


def write_changes(rows: DataFrame, path: str, batch: int) -> None:
    rows.select(*STATE, "deleted").write.mode("overwrite").parquet(f"{path}/batch={batch}")


def write_marks(rows: DataFrame, path: str, batch: int) -> None:
    rows.select("key", "tick_ts", "last_sent_date", "removed").write.mode("overwrite").parquet(
        f"{path}/batch={batch}"
    )


def apply_batch(
    requests: DataFrame, path: str, batch: int, marks_path: str | None = None, fold_from: int = FOLD_FROM,
) -> None:
    fold_if_long(requests.sparkSession, path, LOG_SCHEMA, live_rows, batch, fold_from)
    current = read_state(requests.sparkSession, path, marks_path, before=batch)
    touched = accepted(requests).select("key").distinct()
    write_changes(changes(requests, current.join(touched, "key", "left_semi")), path, batch)


def compact(spark: SparkSession, path: str, target: str, upto: int, marks_path: str | None = None) -> None:
    """Fold the batches up to ``upto`` into one batch of a new log."""
    live = read_state(spark, path, marks_path, before=upto + 1)
    write_changes(live.withColumn("deleted", F.lit(False)), target, upto)


def subscribe_stream(requests: DataFrame, path: str, checkpoint: str, marks_path: str | None = None):
    """Start the upsert stream; ``requests`` is a streaming DataFrame."""
    return (
        requests.writeStream.foreachBatch(lambda df, batch: apply_batch(df, path, batch, marks_path))
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def list_valid(state: DataFrame) -> DataFrame:
    return state.where(F.coalesce(F.col("endpoint"), F.lit("")) != "")
