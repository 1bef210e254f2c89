"""Reminder dispatch: plan per tick, outcome fold, summary, and once-a-day streaming."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from calendra.functions.dates import rome_time
from calendra.operators.calendars import bins_per_day
from calendra.streaming.log import FOLD_FROM, fold_if_long
from calendra.streaming.subscriptions import MARK_SCHEMA, last_marks, read_state, write_marks

# Delivery answers that remove a subscription, and the lateness allowed.
GONE = (404, 410)
LATENESS = "1 day"


def civil_parts(ts_utc: Column) -> tuple[Column, Column]:
    """Civil date and hour in Rome of a UTC instant."""
    local = rome_time(ts_utc)
    return F.to_date(local), F.hour(local)


def calendar_memo(subscriptions: DataFrame, cal: DataFrame, years: Sequence[int]) -> DataFrame:
    """Each asked calendar once, with whether it has entries in the active years."""
    asked = subscriptions.select("calendar_id").distinct()
    known = cal.where(F.year("date").isin(*years)).select("calendar_id").distinct().withColumn("known", F.lit(True))
    return asked.join(known, "calendar_id", "left").withColumn("known", F.coalesce("known", F.lit(False)))


def plan(subscriptions: DataFrame, cal: DataFrame, tick: Column, years: Sequence[int]) -> DataFrame:
    """What one tick does with every subscription.

    Not due or already handled: skip. Calendar missing: skip, unmarked. Nothing tomorrow:
    skip, marked. Else send. The cheap tests come first; only due keys meet the calendar,
    and the calendar is cut to one day and the asked ids before it is grouped.
    """
    date, hour_now = civil_parts(tick)
    hour = F.col("hour").try_cast("double")
    due = (hour == F.floor(hour)) & (hour_now >= hour)
    pickup = F.date_add(date, 1)
    staged = subscriptions.withColumn(
        "_early",
        F.when(~F.coalesce(due, F.lit(False)), F.lit("not due")).when(F.col("last_sent_date") >= date, F.lit("done today")),
    )
    waiting = staged.where("_early IS NULL")
    memo = calendar_memo(waiting, cal, years)
    day = cal.where(F.year("date").isin(*years) & (F.col("date") == pickup))
    asked = waiting.select("calendar_id").distinct()
    bins = bins_per_day(day.join(asked, "calendar_id", "left_semi")).select("calendar_id", "bins")
    reached = waiting.join(memo, "calendar_id", "left").join(bins, "calendar_id", "left")
    status = (
        F.when(~F.coalesce("known", F.lit(False)), F.lit("no calendar"))
        .when(F.col("bins").isNull(), F.lit("empty day"))
        .otherwise(F.lit("send"))
    )
    cols = subscriptions.columns
    none = F.lit(None).cast("array<int>")
    skipped = staged.where("_early IS NOT NULL").select(*cols, F.col("_early").alias("status"), none.alias("bins"))
    return skipped.unionByName(reached.select(*cols, status.alias("status"), "bins")).withColumns(
        {"tick_date": date, "pickup_date": pickup}
    )


def fold_outcomes(planned: DataFrame, outcomes: DataFrame) -> DataFrame:
    """Result and next state per key: sent marks, gone deletes, other errors change nothing.

    ``outcomes`` has key and HTTP status of the attempted sends.
    """
    code = F.col("code")
    result = (
        F.when(F.col("status") != "send", F.lit("skipped"))
        .when(code.between(200, 299), F.lit("sent"))
        .when(code.isin(*GONE), F.lit("removed"))
        .otherwise(F.lit("error"))
    )
    mark = (F.col("result") == "sent") | (F.col("status") == "empty day")
    return (
        planned.join(outcomes.select("key", F.col("status").alias("code")), "key", "left")
        .withColumn("result", result)
        .withColumn("deleted", F.col("result") == "removed")
        .withColumn("last_sent_date", F.when(mark, F.col("tick_date")).otherwise(F.col("last_sent_date")))
        .withColumn("marked", mark)
        .drop("code")
    )


def summarise(folded: DataFrame, by: Sequence[str] = ("tick_date",)) -> DataFrame:
    def n(result: str) -> Column:
        return F.count_if(F.col("result") == result)

    return folded.groupBy(*by).agg(
        n("sent").alias("sent"), n("skipped").alias("skipped"), n("removed").alias("removed"),
        n("error").alias("errors"), F.count(F.lit(1)).alias("total"),
    )


def first_of_day(events: DataFrame, key: str, ts: str, order: str) -> DataFrame:
    """First event per key and Rome civil day (batch form of the once-a-day rule)."""
    date, _ = civil_parts(F.col(ts))
    return events.groupBy(key, date.alias("civil_date")).agg(
        F.min(F.struct(ts, order)).alias("f")
    ).select(key, "civil_date", f"f.{ts}", f"f.{order}")


def once_a_day(stream: DataFrame, key: str, ts: str) -> DataFrame:
    """Streaming form: one row per key and civil day, state dropped after the lateness.

    ``ts`` must be a TIMESTAMP holding UTC instants.
    """
    local = F.from_utc_timestamp(F.col(ts), "Europe/Rome")
    return (
        stream.withColumn("civil_date", F.to_date(local))
        .withWatermark(ts, LATENESS)
        .dropDuplicatesWithinWatermark([key, "civil_date"])
    )


def dispatch_stream(
    ticks: DataFrame, state_path: str, marks_path: str, cal: DataFrame, years: Sequence[int], send, checkpoint: str,
    fold_from: int = FOLD_FROM,
):
    """Start the dispatch stream over hourly ticks.

    ``send`` maps the planned sends to outcomes (key, status); it is the sink side effect.
    The ticks of a micro-batch are played in order. Every tick writes its own folder of marks
    under the seconds of its instant, so a repeated tick rewrites its folder and no backlog
    can run into the numbers of another batch. Marks are folded before the first tick of a
    micro-batch only, so a repeated micro-batch finds the state that it began with.
    """

    def play(df: DataFrame, batch: int) -> None:
        spark = df.sparkSession
        # Ticks are one per hour: even a backlog of years is a short list.
        ticks_at = F.col("ts").cast("timestamp").cast("bigint").alias("number")
        for place, row in enumerate(df.select("ts", ticks_at).distinct().orderBy("ts").collect()):
            if place == 0:
                fold_if_long(spark, marks_path, MARK_SCHEMA, last_marks, row["number"], fold_from)
            number = row["number"]
            tick = F.lit(row["ts"]).cast("timestamp_ntz")
            state = read_state(spark, state_path, marks_path, marks_before=number)
            planned = plan(state, cal, tick, years)
            folded = fold_outcomes(planned, send(planned.where("status = 'send'")))
            touched = folded.where("marked OR deleted").withColumns({"tick_ts": tick, "removed": F.col("deleted")})
            write_marks(touched, marks_path, number)

    return (
        ticks.writeStream.foreachBatch(play)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
