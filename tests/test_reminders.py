"""Keyed reminders with timers: missed, repeated and late ticks."""

from __future__ import annotations

import datetime as dt

import pytest
from calendra.streaming import reminders as R

REQUESTS = "key string, action string, calendar_id string, hour int, ts timestamp, seq bigint"


def at(text):
    return dt.datetime.fromisoformat(text).replace(tzinfo=dt.timezone.utc)


class World:
    """Files that arrive, and the stream run over what is new."""

    def __init__(self, spark, folder):
        self.spark, self.folder, self.number = spark, folder, 0
        for kind, schema in (("requests", REQUESTS), ("ticks", "ts timestamp")):
            self.put(kind, [], schema)

    def put(self, kind, rows, schema):
        self.spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(self.folder / kind / str(self.number)))
        self.number += 1

    def run(self, requests=(), ticks=()):
        if requests:
            self.put("requests", [(k, a, f"c-{k}", h, at(t), i) for i, (k, a, h, t) in enumerate(requests)], REQUESTS)
        if ticks:
            self.put("ticks", [(at(t),) for t in ticks], "ts timestamp")

        def read(kind, schema):
            return self.spark.readStream.schema(schema).option("recursiveFileLookup", "true").parquet(str(self.folder / kind))

        due = R.reminders(read("requests", REQUESTS), read("ticks", "ts timestamp"))
        R.start(due, str(self.folder / "out"), str(self.folder / "cp")).awaitTermination()
        rows = self.spark.read.schema(R.OUT).parquet(str(self.folder / "out")).collect()
        return sorted((r.key, str(r.civil_date), r.sent_at.strftime("%d %H:%M")) for r in rows)


def test_missed_repeated_and_late_ticks(spark, tmp_path):
    before = spark.conf.get(R.PROVIDER, None)
    world = World(spark, tmp_path)
    subscribed = [("a", "subscribe", 20, "2026-03-02T10:00:00"), ("b", "subscribe", 7, "2026-03-02T10:00:00"), ("c", "unsubscribe", 7, "2026-03-02T10:00:00")]
    # b's hour has passed when it subscribes: the next tick reminds it; Rome is an hour ahead
    first = [("b", "2026-03-02", "02 11:00")]
    assert world.run(subscribed, ["2026-03-02T11:00:00"]) == first
    # a's tick of 20 o'clock is missed: that of 21:05 makes up for it on the same day
    second = sorted([*first, ("a", "2026-03-02", "02 20:05")])
    assert world.run(ticks=["2026-03-02T20:05:00"]) == second
    # the same tick again, and the missed one late
    assert world.run(ticks=["2026-03-02T20:05:00", "2026-03-02T19:05:00"]) == second
    # all ticks of a's third of March are missed: it is not made up for on the fourth
    third = sorted([*second, ("b", "2026-03-04", "04 06:30")])
    assert world.run(ticks=["2026-03-04T06:30:00"]) == third
    # a failed send is tried again by the next tick of the day; an unsubscribed key is silent
    fourth = sorted([*third, ("b", "2026-03-04", "04 08:00")])
    assert world.run([("b", "failed", None, "2026-03-04T07:00:00"), ("a", "unsubscribe", None, "2026-03-04T07:00:00")], ["2026-03-04T08:00:00"]) == fourth
    assert world.run(ticks=["2026-03-04T22:30:00"]) == fourth  # 23:30 in Rome
    # an hour that is moved back counts from the next tick on, once a day
    fifth = sorted([*fourth, ("b", "2026-03-05", "05 03:00")])
    assert world.run([("b", "subscribe", 2, "2026-03-05T00:30:00")], ["2026-03-05T03:00:00"]) == fifth
    assert world.run([("b", "subscribe", 9, "2026-03-05T05:00:00")], ["2026-03-05T12:00:00"]) == fifth
    # a request older than the clock is applied, not dropped
    assert world.run([("d", "subscribe", 1, "2026-03-04T05:00:00")], ["2026-03-05T13:00:00"]) == sorted([*fifth, ("d", "2026-03-05", "05 12:00")])
    assert spark.conf.get(R.PROVIDER, None) == before


@pytest.mark.parametrize("when, date, hour", [("2026-03-29T00:30", "2026-03-29", 1), ("2026-03-29T01:30", "2026-03-29", 3), ("2026-10-25T01:30", "2026-10-25", 2), ("2026-12-31T23:00", "2027-01-01", 0)])
def test_civil_time(when, date, hour):
    ms = int(at(when).timestamp() * 1000)
    assert R.civil(ms) == (dt.date.fromisoformat(date), hour)
    assert R.instant(dt.date.fromisoformat(date), hour) <= ms
