"""Joins whose sides grow with the tables, and rows that were lost or changed at size."""

from __future__ import annotations

import datetime as dt
import random
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from __spark_entry__ import queries
from calendra.functions.text import index_letter, strip_accents
from calendra.operators import layout as L
from calendra.operators import matching as M
from calendra.operators import overlay as O
from calendra.operators import page_grid as G
from calendra.operators import recurrence as E
from calendra.sources import html as H


def shown(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_labels_and_days_are_not_broadcast(spark):
    labels = spark.createDataFrame([(1, 7, 0.0, 0.0)], "page int, label int, x double, y double")
    days = spark.createDataFrame([(1, 9.0, 0.0, 3)], "page int, x double, y double, day int")
    out = L.label_then_day(labels, days, ["page"], "label")
    assert "Broadcast" not in shown(out) and [r.day for r in out.collect()] == [3]


def test_letters_meet_heights_of_days_without_broadcast(spark):
    letters = spark.createDataFrame([(1, 20.0, 4), (1, 26.0, 4), (1, 400.0, 2), (1, 20.0, None)], "page int, y double, bin int")
    days = spark.createDataFrame([(1, 1, 1, 20.0), (1, 2, 1, 20.0), (1, 2, 30, 20.0), (1, 3, 9, 90.0)], "page int, month int, day int, y double")
    out = L.letters_of_days(letters, days, ["page"], 2026)
    assert "Broadcast" not in shown(out)
    found = sorted(((r.date, r.bin) for r in out.collect()), key=repr)
    assert found == sorted([(dt.date(2026, m, 1), b) for m in (1, 2) for b in (4, None)], key=repr)


def test_zones_are_scored_once_a_token(spark):
    calendars = spark.createDataFrame([(1, i, "c-za") for i in range(400)] + [(1, 900, "c-zunica")], "comune int, calendar int, slug string")
    zones = spark.createDataFrame([(1, "Zona A"), (1, "Zona B")], "comune int, zone string")
    out = M.map_zones(calendars, zones)
    found = {(r.calendar, r.zone) for r in out.collect()}
    assert found == {(i, "Zona A") for i in range(400)} | {(900, "Zona A"), (900, "Zona B")}
    for aggregate in [line for line in shown(out).splitlines() if "Aggregate" in line]:
        assert "calendar" not in aggregate


def test_zones_and_calendars_meet_without_broadcast(spark):
    calendars = spark.createDataFrame([(1, i, "c-za") for i in range(40)] + [(1, 900, "c-zunica"), (1, 901, "c"), (2, 902, "c-zest")], "comune int, calendar int, slug string")
    zones = spark.createDataFrame([(1, "Zona A"), (1, "Porta A"), (1, "Zona B SMART 5"), (2, "Zona East"), (2, "Porta")], "comune int, zone string")
    out = M.map_zones(calendars, zones)
    assert "Broadcast" not in shown(out)
    assert out.rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))
    found = sorted(((r.calendar, r.zone, r.score) for r in out.collect()), key=repr)
    every = [(900, zone, None) for zone in ("Zona A", "Porta A", "Zona B SMART 5")]
    assert found == sorted([(i, "Zona A", 11) for i in range(40)] + [(901, "Porta A", 1), (902, "Zona East", 4)] + every, key=repr)


def test_features_of_zones_are_not_broadcast(spark):
    tokens = spark.createDataFrame([(1, "A"), (1, "")], "comune int, token string")
    zones = spark.createDataFrame([(1, "Zona A", "ZONA A", 0), (1, "Zona A", "ZONA A", 0), (2, "Zona A", "ZONA A", 0)], "comune int, zone string, zf string, own int")
    out = M.zone_scores(tokens, zones)
    assert "Broadcast" not in shown(out)
    assert {tuple(r) for r in out.collect()} == {(1, "A", "Zona A", 11)}


@pytest.mark.skipif(not Path("/root/testdata/sf0.001").exists(), reason="test data not present")
def test_words_of_pages_are_dealt_once(spark):
    text = shown(queries()["c07_header_rows"](spark, "/root/testdata/sf0.001"))
    dealt = [line.split("hashpartitioning(")[1] for line in text.splitlines() if "Exchange hash" in line]
    assert dealt and len(dealt) <= 40
    for name in ("col#", "_b#", "_run#", "cluster_y#", " d#"):
        assert not [keys for keys in dealt if name in keys]


def test_small_keys_are_scanned_as_a_whole(spark):
    rng = random.Random(9)
    rows = [(i % 3, i, rng.choice([float(rng.randint(0, 150)), rng.uniform(0, 150)]), rng.uniform(0, 90)) for i in range(240)] + [(0, 900, None, 1.0), (1, 901, 2000.0, 1.0)]
    df = spark.createDataFrame(rows, "page int, id int, y double, x double")
    for gap in (0.5, 1.5, 4.0):
        got, want = (L.token_clusters(df, ["page"], "y", "id", width, gap) for width in (None, 20.0))
        assert got.columns == want.columns
        assert sorted(map(repr, got.collect())) == sorted(map(repr, want.collect()))
        got, want = (L.token_runs(df.where("y IS NOT NULL"), ["page"], "y", "id", width, gap) for width in (None, 20.0))
        assert sorted(map(repr, got.collect())) == sorted(map(repr, want.collect()))
    rects = spark.createDataFrame([(i % 3, i, 7.0 * i, 7.0 * i + 30, 10.0 * i, 10.0 * i + 25) for i in range(9)] + [(0, 50, 5.0, 5.0, 0.0, 99.0)], "page int, rect int, x0 double, x1 double, y0 double, y1 double")
    points = df.withColumnRenamed("id", "point")
    got, want = (sorted((r.point, r.rect, r.x0, r.y1) for r in G.in_rectangles(points, rects, ["page"], cell).collect()) for cell in (None, 11.0))
    assert got == want and got


def test_nearest_anchor_brings_its_columns(spark):
    marks = spark.createDataFrame([(1, 5.0, "m"), (1, 50.0, "far")], "page int, y double, name string")
    anchors = spark.createDataFrame([(1, 3.0, 7, "near"), (1, 9.0, 8, "other")], "page int, y double, id int, phrase string")
    out = L.nearest_in_reach(marks, anchors, ["page"], "y", "id", 8.0, "anchor", ["phrase"])
    assert out.columns == ["page", "y", "name", "anchor", "dist", "phrase"]
    assert [tuple(r) for r in out.collect()] == [(1, 5.0, "m", 7, 2.0, "near")]


@pytest.mark.parametrize("text, letter", [
    ("  ßachzu", "ẞ"), ("1 ﬁne", "ﬁ"), ("ᾀ", "Α"), ("が", "か"), ("가", "가"), ("éa", "E"), ("é", "E"), ("12", "#"), ("", "#"),
])
def test_index_letter_is_one_letter(spark, text, letter):
    assert spark.range(1).select(index_letter(F.lit(text)).alias("l")).first().l == letter


def test_accents_of_all_scripts_are_stripped(spark):
    assert spark.range(1).select(strip_accents(F.lit("がきé़क़Ω̈")).alias("s")).first().s == "かきeकΩ"


def test_tagged_rows_are_put_together(spark):
    lines = spark.createDataFrame([("d", i, f"l{i}") for i in range(10)], "doc string, pos int, line string")
    parts = H.tagged_rows(lines, "doc", "pos", "line", F.when(F.col("pos") == 0, "Z"), F.col("pos").isin(1, 8), bucket=3)
    rows = {r.row_no: (r.zone, r.text) for r in H.whole_rows(parts, "doc").collect()}
    assert rows == {1: ("Z", ", ".join(f"l{i}" for i in range(1, 8))), 2: ("Z", "l8, l9")}


def test_pages_are_spread_before_their_rows_are_made(spark):
    pages = spark.createDataFrame([(1, "SETT 1–2 (lunedì) 1-15 2-16"), (1, "SETT 1 (lunedì) 1-15 2-16")], "page int, text string").coalesce(1)
    out = H.wide_month_rows(pages, "page", "text", 2026)
    assert shown(out).count("Exchange hash") == 1 and out.rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))
    days = [dt.date(2026, m, d) for m, d in ((3, 1), (3, 15), (4, 2), (4, 16))]
    labels = ("SETT 1-2 (lunedi)", "SETT 1-2 lunedi", "SETT 1 lunedi", "SETT 2 lunedi", "SETT 1 (lunedi)")
    assert sorted((r.label, r.date) for r in out.collect()) == sorted((label, day) for label in labels for day in days)


def test_weekly_tables_are_spread_and_read_once(spark):
    rows = [["Zona", "Lunedì", "Martedì", "Venerdì"], ["A", "Carta", "Vetro", ""], ["Utenze non domestiche", "Carta", "Carta", "Carta"]]
    tables = spark.createDataFrame([(1, rows), (2, [["Giorno", "Nord", ""], ["lunedì", "carta", "vetro"], [], ["nota", "carta", "x"]]), (3, [])], "page int, rows array<array<string>>")
    out = H.weekly_grid(tables, "page", "rows")
    assert shown(out).count("Scan ") == 1 and shown(out).count("Exchange hash") == 1
    assert {tuple(r) for r in out.collect()} == {(1, "A", 0, 0), (1, "A", 1, 5), (2, "Nord", 0, 0)}


def test_clauses_of_a_rule_are_united_without_a_shuffle_of_dates(spark):
    rules = spark.createDataFrame([(1, "dal lunedì al venerdì (marzo - giugno) dal lunedì al martedì (giugno - luglio)"), (2, "da definire"), (3, "")], "zone int, rule string")
    out = E.expand_clauses(rules, "rule", F.lit(2026))
    text = shown(out)
    assert text.index("Generate") < text.index("Exchange hash")
    found = [r.date for r in out.collect()]
    year = [dt.date(2026, 1, 1) + dt.timedelta(days=d) for d in range(365)]
    assert sorted(found) == [d for d in year if (3 <= d.month <= 6 and d.weekday() < 5) or (d.month == 7 and d.weekday() < 2)]


def test_streets_are_folded_after_they_are_made_distinct(spark):
    cells = spark.createDataFrame([(1, 0, ["Zona", "Toponimo", "Giorno di pulizia"]), (1, 1, ["S1", "Via Po", "lunedì"]), (1, 2, ["S1", "Via Po", "martedì"])], "table int, row_no int, cells array<string>")
    streets = H.sweep_tables(cells, "table", "manuale")[1]
    assert {tuple(r) for r in streets.collect()} == {("PO", "manuale:S1"), ("VIA PO", "manuale:S1")}
    for line in shown(streets).splitlines():
        assert "array_distinct" not in line or "Filter" not in line


def test_dates_of_codes_are_met_as_sets(spark):
    day = dt.date(2026, 1, 1)
    selected = spark.createDataFrame([(1, 10, 1), (1, 11, 2), (2, 11, 1), (3, 12, 1)], "grp int, code int, rank int")
    dated = spark.createDataFrame([(c, day + dt.timedelta(days=d)) for c in (10, 11) for d in range(c - 10, 5)], "code int, date date")
    coverage = spark.createDataFrame([(g, 5, 9) for g in (1, 2, 3)], "grp int, matched int, total int")
    plan = O.overlay_plan(coverage, selected, dated)
    assert {r.grp: (r.codes, r.days, r.status) for r in plan.collect()} == {1: (2, 5, "merged"), 2: (1, 4, "merged"), 3: (1, 0, "few days")}
    entries = O.overlay_entries(plan, selected, dated)
    assert sorted((r.calendar_id, r.date.day) for r in entries.collect()) == [(1, d) for d in range(1, 6)] + [(2, d) for d in range(2, 6)]
    assert not [line for line in shown(entries).splitlines() if "Aggregate" in line and "keys=[grp" in line and "date" in line.split("functions")[0]]


@pytest.mark.parametrize("name", ["c07_label_then_day", "c07_letters_of_days", "c07_month_grid", "c07_icon_grid"])
def test_exploded_tables_are_not_broadcast(spark, name):
    sf = "/root/testdata/sf0.001"
    if not Path(sf).exists():
        pytest.skip("test data not present")
    assert "BroadcastHashJoin" not in shown(queries()[name](spark, sf))
