from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from calendra.functions import rules as R
from calendra.functions.dates import free_street_day, parse_ymd, rome_time
from calendra.operators import calendars as C
from calendra.operators import overlay as O
from calendra.operators import recurrence as E
from calendra.sources import calendar_text as S
from calendra.sources import tables as B

CAL = "calendar_id string, date date, bin int"


def d(text):
    return dt.date.fromisoformat(text)


@pytest.fixture()
def cal(spark):
    return spark.createDataFrame(
        [("c1", d("2027-01-04"), 1), ("c1", d("2027-01-04"), 2), ("c1", d("2027-01-04"), 3), ("c1", d("2027-01-04"), 3),
         ("c1", d("2027-02-01"), 6), ("c2", d("2027-01-04"), -1), ("c2", d("2026-12-30"), 6)],
        CAL,
    )


def test_bins_of_a_day_and_the_next_day(spark, cal):
    assert [(r.calendar_id, r.bins) for r in C.bins_on(cal, F.lit(d("2027-01-04"))).collect()] == [("c1", [1, 2, 3])]
    asked = spark.createDataFrame([("c1", d("2027-01-31")), ("c2", d("2027-01-31"))], "calendar_id string, ref_date date")
    got = {r.calendar_id: (r.date, r.bins) for r in C.pickups_tomorrow(cal, asked).collect()}
    assert got == {"c1": (d("2027-02-01"), [6]), "c2": (d("2027-02-01"), [])}


def test_labels_use_a_question_mark_for_unknown_bins(spark, cal):
    labels = {(r.calendar_id, str(r.date)): r.initials for r in C.day_labels(cal.union(
        spark.createDataFrame([("c3", d("2027-01-04"), 9)], CAL))).collect()}
    assert labels["c1", "2027-01-04"] == "O.I.P" and labels["c3", "2027-01-04"] == "?"


def test_rome_clock(spark):
    times = ["2026-07-28 18:30:00", "2026-10-25 00:30:00", "2026-10-25 01:00:00"]
    df = spark.createDataFrame([(t,) for t in times], "t string").select(rome_time(F.col("t").cast("timestamp_ntz")).alias("r"))
    assert [str(r.r) for r in df.collect()] == ["2026-07-28 20:30:00", "2026-10-25 02:30:00", "2026-10-25 02:00:00"]


def test_free_street_days_of_2026(spark):
    days = spark.sql("SELECT explode(sequence(date'2026-01-01', date'2026-12-31')) AS d").where(free_street_day(F.col("d")))
    assert [str(r.d) for r in days.orderBy("d").collect()] == ["2026-03-02", "2026-05-04", "2026-07-06", "2026-09-07", "2026-11-02"]


def test_date_text_is_strict(spark):
    df = spark.createDataFrame([("2026-02-28",), ("2026-02-31",), ("2026-2-1",), ("x",), (None,)], "t string")
    assert [r.d and str(r.d) for r in df.select(parse_ymd(F.col("t")).alias("d")).collect()] == ["2026-02-28", None, None, None, None]


def profile(spark, rows):
    return spark.createDataFrame(rows, "calendar_id string, year int, entries bigint, months int, bins array<int>")


def test_severity_order(spark):
    rows = [("sweep", 2026, 13, 12, [6]), ("tiny", 2026, 9, 9, [6]), ("thin", 2026, 30, 3, [1, 2]),
            ("a", 2026, 160, 12, [1]), ("b", 2026, 165, 12, [1]), ("c", 2026, 170, 12, [1]), ("d", 2026, 171, 12, [1]),
            ("e", 2026, 172, 12, [1]), ("f", 2026, 173, 12, [1]), ("low", 2026, 100, 12, [1]), ("big", 2026, 900, 12, [1])]
    got = {r.calendar_id: r.severity for r in C.classify(profile(spark, rows)).collect()}
    assert got["sweep"] == "ok" and got["tiny"] == "broken" and got["thin"] == "critical" and got["big"] == "high"


def test_few_calendars_have_no_fences(spark):
    out = C.classify(profile(spark, [("x", 2026, 5, 1, [1]), ("y", 2026, 20, 1, [1])])).collect()
    assert {r.calendar_id: (r.severity, r.low) for r in out} == {"x": ("broken", None), "y": ("ok", None)}


def test_text_round_trip_has_no_difference(spark, cal, tmp_path):
    plain = cal.distinct()
    S.write(plain, str(tmp_path / "out"))
    lines = spark.read.text(str(tmp_path / "out"))
    back = S.parse_entries(lines.select("calendar_id", "value"))
    statuses = {r.status for r in C.diff(plain, back).collect()}
    assert statuses == {"both"}


def test_scan_of_whole_files(spark, tmp_path):
    (tmp_path / "town-z1-2026.h").write_text("// Town Zona 1 (P)\n\n  {2026, 3, 3, 1},  // x\n {2026,12,31,-1}, {2025,1,1,2},\n")
    rows = S.scan(spark, str(tmp_path)).orderBy("date").collect()
    assert [(r.calendar_id, str(r.date), r.bin) for r in rows] == [("town-z1", "2026-03-03", 1), ("town-z1", "2026-12-31", -1)]


def test_statistics_csv_skips_the_preamble_and_strips_tabs(spark, tmp_path):
    for year in (2023, 2024):
        (tmp_path / f"y{year}.csv").write_text(
            f"Rifiuti {year};;\n99;not;data\nIstatComune; Comune ;Totale RU (t)\n\t001;Agliè;1.234,5\n\t002;\"A;B\";-\n", encoding="utf-8"
        )
    df = B.read_statistics_csv(spark, str(tmp_path))
    name = B.resolve_column(df.columns, "Comune")
    assert name == " Comune "
    got = sorted((r.IstatComune, r[name], r["Totale RU (t)"]) for r in df.collect())
    assert got == [("001", "Agliè", "1.234,5")] * 2 + [("002", "A;B", "-")] * 2


def test_column_lookup_prefers_exact_then_trimmed_then_substring():
    cols = [" Carta (t)", "Totale RD (t)", "Carta e cartone (t)"]
    assert B.resolve_column(cols, "Carta (t)") == " Carta (t)"
    assert B.resolve_column(cols, "Totale") == "Totale RD (t)"
    assert B.resolve_column(cols, "Nope") is None


def dates(spark, weekday, rule, year=2026):
    df = spark.createDataFrame([(weekday, rule)], "w string, r string")
    return sorted(str(r.date) for r in E.expand_rules(df, "w", "r", F.lit(year)).collect())


def test_rule_texts(spark):
    assert dates(spark, "lunedì", "I e III lunedì del mese mesi di marzo") == ["2026-03-02", "2026-03-16"]
    assert len(dates(spark, "lunedì", "")) == 52
    assert dates(spark, "x", "V LUNEDI DEL MESE (MARZO GIUGNO)") == ["2026-03-30", "2026-06-29"]
    assert len(dates(spark, "martedì", "V MARTEDI DEL MESE (FEBBRAIO)")) == 4


def test_clause_semantics(spark):
    def expand(text):
        df = spark.createDataFrame([(text,)], "t string")
        return sorted(str(r.date) for r in E.expand_clauses(df, "t", F.lit(2026)).collect())

    assert expand("ultimo lunedì del mese (dicembre)") == ["2026-12-28"]
    assert len(expand("lunedì ogni due mesi")) == 6
    assert expand("lunedì ogni due settimane (marzo)") == ["2026-03-02", "2026-03-16", "2026-03-30"]
    assert expand("da definire lunedì") == []
    wrap = spark.createDataFrame([("DAL SABATO AL LUNEDI",)], "t string")
    assert sorted(wrap.select(R.weekdays_of(F.col("t")).alias("x")).first().x) == [0, 5, 6]


def test_overlay_is_idempotent_and_leaves_other_calendars(spark, cal):
    over = spark.createDataFrame([("c1", d("2027-03-01"))], "calendar_id string, date date")
    once = O.replace_category(cal, over)
    twice = O.replace_category(once, over)
    assert sorted(map(tuple, once.collect())) == sorted(map(tuple, twice.collect()))
    kept = {(r.calendar_id, str(r.date)) for r in once.where("bin = 6").collect()}
    assert kept == {("c1", "2027-03-01"), ("c2", "2026-12-30")}


def test_diff_only_compares_expected_years(spark):
    a = spark.createDataFrame([("c", d("2026-01-01"), 1), ("c", d("2026-01-02"), 1)], CAL)
    b = spark.createDataFrame([("c", d("2026-01-02"), 1), ("c", d("2026-01-03"), 1), ("c", d("2027-01-03"), 1)], CAL)
    row = C.diff_counts(C.diff(a, b)).first()
    assert (row.expected, row.extracted, row.missing, row.extra) == (2, 2, 1, 1)
