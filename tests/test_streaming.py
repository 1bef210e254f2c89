from __future__ import annotations

import datetime as dt

import pyarrow as pa
import pyarrow.parquet as pq

from pyspark.sql import functions as F

from calendra.streaming import dispatch as P
from calendra.streaming import log as L
from calendra.streaming import subscriptions as S

REQ = "seq bigint, ts timestamp_ntz, action string, endpoint string, p256dh string, auth string, calendar_id string, hour string"


def ts(text):
    return dt.datetime.fromisoformat(text)


def req(seq, when, action="subscribe", endpoint="https://a", calendar="calendars/c1-2026.h", hour="20"):
    return (seq, ts(when), action, endpoint, "p", "a", calendar, hour)


def put(spark, folder, name, rows, schema):
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(folder / name))


def stream(spark, folder, schema):
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(folder))


def state(spark, tmp_path):
    live = S.read_state(spark, str(tmp_path / "state"), str(tmp_path / "marks"))
    return {r.endpoint: r for r in live.collect()}


def subscribe(spark, tmp_path):
    query = S.subscribe_stream(stream(spark, tmp_path / "in", REQ), str(tmp_path / "state"), str(tmp_path / "cp"), str(tmp_path / "marks"))
    query.awaitTermination()


def test_upsert_over_batches_keeps_creation_and_drops_on_unsubscribe(spark, tmp_path):
    put(spark, tmp_path / "in", "b1", [req(1, "2026-01-01T10:00:00", hour="7"), req(2, "2026-01-01T10:05:00", endpoint="http://bad"),
                                       req(3, "2026-01-01T10:06:00", endpoint="https://b", hour="99")], REQ)
    subscribe(spark, tmp_path)
    put(spark, tmp_path / "in", "b2", [req(4, "2026-01-02T10:00:00", hour="9"), req(5, "2026-01-02T11:00:00", "unsubscribe", "https://b")], REQ)
    subscribe(spark, tmp_path)
    now = state(spark, tmp_path)
    assert set(now) == {"https://a"}
    a = now["https://a"]
    assert (a.hour, a.calendar_id, str(a.created_at), str(a.updated_at)) == (9, "calendars/c1", "2026-01-01 10:00:00", "2026-01-02 10:00:00")
    put(spark, tmp_path / "in", "b3", [req(6, "2026-01-03T10:00:00", endpoint="https://b", hour="")], REQ)
    subscribe(spark, tmp_path)
    b = state(spark, tmp_path)["https://b"]
    assert (b.hour, str(b.created_at)) == (20, "2026-01-03 10:00:00")
    S.compact(spark, str(tmp_path / "state"), str(tmp_path / "folded"), 10)
    assert {r.key for r in S.read_state(spark, str(tmp_path / "folded")).collect()} == {r.key for r in state(spark, tmp_path).values()}


def test_a_repeated_batch_changes_nothing(spark, tmp_path):
    first = spark.createDataFrame([req(1, "2026-01-01T10:00:00", hour="7")], REQ)
    second = spark.createDataFrame([req(2, "2026-01-02T10:00:00", hour="8")], REQ)
    path = str(tmp_path / "state")
    S.apply_batch(first, path, 0)
    S.apply_batch(second, path, 1)
    before = S.read_state(spark, path).collect()
    S.apply_batch(second, path, 1)
    assert S.read_state(spark, path).collect() == before


CAL = [("calendars/c1", dt.date(2026, 3, 3), 1), ("calendars/c1", dt.date(2026, 3, 3), 4), ("calendars/c2", dt.date(2026, 5, 1), 1)]


def test_dispatch_plan_cases(spark):
    day = dt.date(2026, 3, 2)
    subs = spark.createDataFrame(
        [("due", "calendars/c1", "20", None), ("late", "calendars/c1", "22", None), ("done", "calendars/c1", "7", day),
         ("yesterday", "calendars/c1", "7", dt.date(2026, 3, 1)), ("empty", "calendars/c2", "7", None), ("gone", "calendars/x", "7", None),
         ("odd", "calendars/c1", "7.5", None)], "key string, calendar_id string, hour string, last_sent_date date")
    cal = spark.createDataFrame(CAL, "calendar_id string, date date, bin int")
    # 20:30 in Rome.
    plan = P.plan(subs, cal, F.lit("2026-03-02 19:30:00").cast("timestamp_ntz"), (2026, 2027))
    got = {r.key: r.status for r in plan.collect()}
    assert got == {"due": "send", "late": "not due", "done": "done today", "yesterday": "send", "empty": "empty day",
                   "gone": "no calendar", "odd": "not due"}
    outcomes = spark.createDataFrame([("due", 201), ("yesterday", 410)], "key string, status int")
    folded = {r.key: r for r in P.fold_outcomes(plan, outcomes).collect()}
    assert folded["due"].last_sent_date == day and folded["empty"].last_sent_date == day
    assert folded["gone"].last_sent_date is None and folded["yesterday"].deleted
    summary = P.summarise(P.fold_outcomes(plan, outcomes)).first()
    assert (summary.sent, summary.skipped, summary.removed, summary.errors, summary.total) == (1, 5, 1, 0, 7)


def test_at_most_one_send_a_day_with_catch_up(spark, tmp_path):
    put(spark, tmp_path / "in", "b1", [req(1, "2026-01-01T10:00:00", hour="20")], REQ)
    subscribe(spark, tmp_path)
    # The 20 o'clock tick is missed, the two later ones arrive, then the next evening.
    for i, t in enumerate(["2026-03-02T17:00:00", "2026-03-02T20:05:00", "2026-03-02T21:05:00", "2026-03-03T20:05:00"]):
        put(spark, tmp_path / "ticks", f"t{i}", [(ts(t),)], "ts timestamp_ntz")
    cal = spark.createDataFrame(CAL, "calendar_id string, date date, bin int")
    sent = []

    def send(planned):
        rows = [(r.key, str(r.pickup_date)) for r in planned.collect()]
        sent.extend(rows)
        return spark.createDataFrame([(k, 201) for k, _ in rows], "key string, status int")

    query = P.dispatch_stream(
        stream(spark, tmp_path / "ticks", "ts timestamp_ntz"), str(tmp_path / "state"), str(tmp_path / "marks"), cal, (2026, 2027), send, str(tmp_path / "cp2"))
    query.awaitTermination()
    assert [p for _, p in sent] == ["2026-03-03"]
    assert state(spark, tmp_path)["https://a"].last_sent_date == dt.date(2026, 3, 3)


def test_removed_subscription_can_come_back(spark, tmp_path):
    put(spark, tmp_path / "in", "b1", [req(1, "2026-01-01T10:00:00", hour="1")], REQ)
    subscribe(spark, tmp_path)
    put(spark, tmp_path / "ticks", "t0", [(ts("2026-03-02T17:00:00"),)], "ts timestamp_ntz")
    cal = spark.createDataFrame(CAL, "calendar_id string, date date, bin int")
    gone = lambda planned: planned.select("key", F.lit(410).alias("status"))
    P.dispatch_stream(stream(spark, tmp_path / "ticks", "ts timestamp_ntz"), str(tmp_path / "state"), str(tmp_path / "marks"), cal, (2026, 2027), gone,
                      str(tmp_path / "cp2")).awaitTermination()
    assert state(spark, tmp_path) == {}
    put(spark, tmp_path / "in", "b2", [req(2, "2026-03-02T18:00:00", hour="5")], REQ)
    subscribe(spark, tmp_path)
    back = state(spark, tmp_path)["https://a"]
    assert back.hour == 5 and back.last_sent_date is None and str(back.created_at) == "2026-03-02 18:00:00"


# Logs with a base and a pointer


def many_batches(folder, numbers, rows_of, schema):
    """Batch folders as files, without a Spark job for each."""
    for n in numbers:
        (folder / f"batch={n}").mkdir(parents=True)
        pq.write_table(pa.Table.from_pylist(rows_of(n), schema), folder / f"batch={n}" / "part-0.parquet")


MARKS = pa.schema([("key", pa.string()), ("tick_ts", pa.timestamp("us")), ("last_sent_date", pa.date32()), ("removed", pa.bool_())])


def mark_rows(n):
    day = dt.date(2026, 1, 1) + dt.timedelta(days=n // 24)
    return [{"key": f"k{n % 7}", "tick_ts": ts("2026-01-01T00:00:00") + dt.timedelta(hours=n), "last_sent_date": day, "removed": n % 50 == 3}]


def all_marks(spark, path, before=None):
    log = S.last_marks(L.read_log(spark, path, S.MARK_SCHEMA, before))
    return sorted(map(tuple, log.collect()))


def test_a_thousand_ticks_read_few_folders(spark, tmp_path):
    path = str(tmp_path / "marks")
    many_batches(tmp_path / "marks", range(1000), mark_rows, MARKS)
    whole = all_marks(spark, path)
    assert len(L.folders(spark, path)[1]) == 1000
    L.fold_if_long(spark, path, S.MARK_SCHEMA, S.last_marks, 960)
    assert L.folders(spark, path) == (959, list(range(960, 1000)))
    assert all_marks(spark, path) == whole
    assert all_marks(spark, path, before=500) != whole  # an earlier state is still there
    many_batches(tmp_path / "marks", range(1000, 1010), mark_rows, MARKS)
    L.fold_if_long(spark, path, S.MARK_SCHEMA, S.last_marks, 1010)
    assert L.folders(spark, path) == (1009, [])
    left = [p.name for p in (tmp_path / "marks").iterdir() if not p.name.startswith(".")]
    assert len(left) <= 2 * L.FOLD_FROM + 5
    L.fold_if_long(spark, path, S.MARK_SCHEMA, S.last_marks, 2000)  # nothing has come since
    assert L.pointers(spark, path) == [959, 1009]


def test_a_crash_before_the_switch_loses_nothing(spark, tmp_path):
    path = str(tmp_path / "marks")
    many_batches(tmp_path / "marks", range(20), mark_rows, MARKS)
    whole = all_marks(spark, path)
    rows = L.read_log(spark, path, S.MARK_SCHEMA)
    # the base is written half, and no pointer stands
    L.write_base(rows.where("batch < 5"), path, S.MARK_SCHEMA, S.last_marks, 19)
    assert L.folders(spark, path) == (None, list(range(20)))
    assert all_marks(spark, path) == whole
    L.fold(spark, path, S.MARK_SCHEMA, S.last_marks, 19)
    assert L.folders(spark, path) == (19, []) and all_marks(spark, path) == whole
    # after the switch, but before the clean-up, batches at or before the base count once
    assert (tmp_path / "marks" / "batch=7").exists()


def test_state_log_folds_while_batches_come(spark, tmp_path):
    short, long = str(tmp_path / "short"), str(tmp_path / "long")
    batches = [
        [req(i, f"2026-01-{1 + i:02d}T10:00:00", "unsubscribe" if i % 4 == 3 else "subscribe", f"https://{'ab'[i % 2]}", hour=str(1 + i))] for i in range(9)
    ]
    for i, rows in enumerate(batches):
        df = spark.createDataFrame(rows, REQ)
        S.apply_batch(df, short, i, fold_from=2)
        S.apply_batch(df, long, i)
    assert L.folders(spark, long)[0] is None and L.pointers(spark, short)[-1] >= 6
    assert len(L.folders(spark, short)[1]) <= 2
    assert sorted(S.read_state(spark, short).collect()) == sorted(S.read_state(spark, long).collect())
    S.apply_batch(spark.createDataFrame(batches[-1], REQ), short, len(batches) - 1, fold_from=2)  # repeated
    assert sorted(S.read_state(spark, short).collect()) == sorted(S.read_state(spark, long).collect())


def test_marks_are_folded_by_the_dispatch_stream(spark, tmp_path):
    put(spark, tmp_path / "in", "b1", [req(1, "2026-01-01T10:00:00", hour="20")], REQ)
    subscribe(spark, tmp_path)
    cal = spark.createDataFrame([("calendars/c1", dt.date(2026, 3, 1) + dt.timedelta(days=d), 1) for d in range(9)], "calendar_id string, date date, bin int")
    sent = []

    def send(planned):
        rows = [(r.key, str(r.pickup_date)) for r in planned.collect()]
        sent.extend(p for _, p in rows)
        return spark.createDataFrame([(k, 201) for k, _ in rows], "key string, status int")

    for day in range(1, 6):
        put(spark, tmp_path / "ticks", f"t{day}", [(ts(f"2026-03-{day:02d}T20:05:00"),), (ts(f"2026-03-{day:02d}T21:05:00"),)], "ts timestamp_ntz")
    P.dispatch_stream(
        stream(spark, tmp_path / "ticks", "ts timestamp_ntz"), str(tmp_path / "state"), str(tmp_path / "marks"), cal, (2026, 2027), send,
        str(tmp_path / "cp2"), fold_from=2).awaitTermination()
    assert sorted(sent) == [f"2026-03-{d:02d}" for d in range(2, 7)]
    assert len(L.pointers(spark, str(tmp_path / "marks"))) == 2
    assert state(spark, tmp_path)["https://a"].last_sent_date == dt.date(2026, 3, 5)
