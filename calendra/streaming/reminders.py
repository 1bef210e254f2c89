"""Reminders once a civil day as keyed state with timers, caught up after missed ticks.

Each subscription keeps its hour, calendar and last reminded day in the state of its key,
and one timer for its next due instant. The clock is the watermark of the ticks: when it
passes a timer, only the keys that are due are touched, so a tick reads neither the other
subscriptions nor a log. A tick that was missed is made up for by the next one of the same
civil day; a day without any later tick is let pass, and its reminder is never sent on the
next one. Repeated and late ticks do not move the clock and do nothing.

Requests carry no clock, so a late one is applied, never dropped. Those of one key within a
micro-batch are applied in the order of (ts, seq), after what was due before the batch.
State is one small row a live subscription; unsubscribing removes it. The state store must
support timers (RocksDB); its provider is read when the stream starts.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterator, Sequence
from zoneinfo import ZoneInfo

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle, TimerValues

from calendra.operators.calendars import bins_per_day

ROME = ZoneInfo("Europe/Rome")
PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: What a request asks for; ``failed`` takes back the day's mark, so that the next tick tries again.
ACTIONS = ("subscribe", "unsubscribe", "failed")
OUT = "key string, calendar_id string, civil_date date, pickup_date date, sent_at timestamp"


def civil(ms: int) -> tuple[dt.date, int]:
    """Date and hour in Rome of milliseconds since 1970 in UTC."""
    local = dt.datetime.fromtimestamp(ms / 1000, ROME)
    return local.date(), local.hour


def instant(date: dt.date, hour: int) -> int:
    """Milliseconds since 1970 of an hour of a civil day in Rome."""
    return int(dt.datetime(date.year, date.month, date.day, hour, tzinfo=ROME).timestamp()) * 1000


class Reminders(StatefulProcessor):
    """State of one subscription: hour and calendar, last reminded day, next timer.

    They are one value: each call of the state store is a message to the JVM, and a key needs
    one read and one write.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("state", "hour int, calendar_id string, last date, next bigint")

    def _read(self) -> None:
        self.before = self.state.get()
        self.hour, self.calendar_id, self.last, self.next = self.before or (None, None, None, None)
        self.timer = self.next

    def _write(self) -> None:
        """What has changed; a state without anything is removed."""
        after = (self.hour, self.calendar_id, self.last, self.next)
        if self.timer != self.next:
            if self.timer is not None:
                self.handle.deleteTimer(self.timer)
            if self.next is not None:
                self.handle.registerTimer(self.next)
        if after == (None, None, None, None):
            if self.before is not None:
                self.state.clear()
        elif self.before is None or tuple(self.before) != after:
            self.state.update(after)

    def _due(self, key: str, now: int) -> Iterator[Row]:
        """The reminder of the clock's civil day, if it is due and not sent."""
        if self.hour is None:
            return
        date, at = civil(now)
        if at >= self.hour and (self.last is None or self.last < date):
            self.last = date
            yield Row(
                key=key, calendar_id=self.calendar_id, civil_date=date, pickup_date=date + dt.timedelta(days=1),
                sent_at=dt.datetime.fromtimestamp(now / 1000, dt.timezone.utc),
            )

    def _set_timer(self, since: int) -> None:
        """One timer, at the next due instant from ``since`` on."""
        date, _ = civil(since)
        if self.last is not None and self.last >= date:
            date += dt.timedelta(days=1)
        # timers fire when the clock is past them
        self.next = max(instant(date, self.hour), since) - 1

    def handleInputRows(self, key, rows: Iterator[Row], timerValues: TimerValues) -> Iterator[Row]:
        (name,) = key
        now = timerValues.getCurrentWatermarkInMs()
        self._read()
        if self.next is not None and self.next < now:
            yield from self._due(name, now)
        since = now
        for row in sorted(rows, key=lambda r: (r.ts, r.seq)):
            since = max(since, int(row.ts.replace(tzinfo=row.ts.tzinfo or dt.timezone.utc).timestamp() * 1000))
            if row.action == "subscribe":
                self.hour, self.calendar_id = row.hour, row.calendar_id
            elif row.action == "unsubscribe":
                self.hour = self.calendar_id = self.last = None
            elif row.action == "failed":
                self.last = None
        if self.hour is not None:
            self._set_timer(since)
        else:
            self.next = None
        self._write()

    def handleExpiredTimer(self, key, timerValues: TimerValues, expiredTimerInfo) -> Iterator[Row]:
        now = timerValues.getCurrentWatermarkInMs()
        self._read()
        # the store removes a timer that has fired
        self.next = self.timer = None
        if self.hour is not None:
            yield from self._due(key[0], now)
            self._set_timer(now)
        self._write()

    def close(self) -> None:
        pass


def reminders(requests: DataFrame, ticks: DataFrame) -> DataFrame:
    """Due reminders (``OUT``) of a stream of requests and a stream of ticks.

    ``requests`` has key, action, calendar_id, hour (1 to 23), ts (TIMESTAMP) and seq, valid as
    ``subscriptions.accepted`` leaves them; ``ticks`` has ts, the instant at which it ran.
    """
    asked = requests.where(F.col("action").isin(*ACTIONS)).select(
        "key", "action", "calendar_id", F.col("hour").cast("int").alias("hour"), "ts", "seq", F.lit(None).cast("timestamp").alias("clock"),
    )
    none = F.lit(None)
    ran = ticks.select(
        none.cast("string").alias("key"), none.cast("string").alias("action"), none.cast("string").alias("calendar_id"), none.cast("int").alias("hour"),
        "ts", F.lit(0).cast("bigint").alias("seq"), F.col("ts").alias("clock"),
    )
    # ticks only move the clock: behind the watermark they are dropped, or all would meet as one key
    return (
        asked.unionByName(ran).withWatermark("clock", "0 seconds").where("clock IS NULL").groupBy("key")
        .transformWithState(Reminders(), outputStructType=OUT, outputMode="Append", timeMode="EventTime")
    )


def planned(due: DataFrame, cal: DataFrame, years: Sequence[int]) -> DataFrame:
    """Due reminders of a stream met with the calendars as they stand when a batch runs.

    Adds ``status``, as the dispatch plan has it: no calendar (to be answered by ``failed``, so
    that a later tick tries again), empty day, or send with the day's ``bins``. ``cal`` has
    calendar_id, date and bin; it is cut to the active years and read once a batch.
    """
    active = cal.where(F.year("date").isin(*years))
    known = active.select(F.col("calendar_id").alias("_known")).distinct()
    days = bins_per_day(active).select(F.col("calendar_id").alias("_of"), F.col("date").alias("_date"), "bins")
    met = due.join(known, F.col("calendar_id") == F.col("_known"), "left").join(
        days, (F.col("calendar_id") == F.col("_of")) & (F.col("pickup_date") == F.col("_date")), "left"
    )
    status = F.when(F.col("_known").isNull(), "no calendar").when(F.col("bins").isNull(), "empty day").otherwise("send")
    return met.withColumn("status", status).drop("_known", "_of", "_date")


def start(due: DataFrame, path: str, checkpoint: str, available_now: bool = True):
    """Write due reminders as files, with the state store that timers need."""
    spark = due.sparkSession
    before = spark.conf.get(PROVIDER, None)
    spark.conf.set(PROVIDER, ROCKSDB)
    try:
        writer = due.writeStream.format("parquet").option("checkpointLocation", checkpoint)
        return (writer.trigger(availableNow=True) if available_now else writer).start(path)
    finally:
        _restore(spark, before)


def _restore(spark: SparkSession, before: str | None) -> None:
    if before is None:
        spark.conf.unset(PROVIDER)
    else:
        spark.conf.set(PROVIDER, before)
