"""Inputs on which earlier versions lost or changed data."""

from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from calendra.functions import rules as R
from calendra.functions.text import title_name
from calendra.operators import calendars as C
from calendra.operators import layout as L
from calendra.operators.distribution import distribution
from calendra.operators.scans import carry_last, previous_row, running_sum
from calendra.sources import html as H
from calendra.sources import tables as T
from calendra.streaming import dispatch as P


def test_every_file_is_read_by_its_own_header(spark, tmp_path):
    (tmp_path / "a.csv").write_text("x;;\nIstatComune;Comune;Popolazione\n1;Uno;10\n")
    (tmp_path / "b.csv").write_text("IstatComune;Popolazione;Comune;Extra\n2;20;Due;e\n")
    rows = {r.IstatComune: (r.Comune, r.Popolazione, r.Extra) for r in T.read_statistics_csv(spark, str(tmp_path)).collect()}
    assert rows == {"1": ("Uno", "10", None), "2": ("Due", "20", "e")}
    (tmp_path / "c.csv").write_text("no;header\n")
    with pytest.raises(ValueError, match="c.csv"):
        T.read_statistics_csv(spark, str(tmp_path))


def test_scans_keep_rows_with_null_keys_and_axes(spark):
    rows = [("a", 1, 10), ("a", 2, 20), (None, 1, 5), (None, 2, 6), ("b", None, 7)]
    df = spark.createDataFrame(rows, "k string, t int, v int")
    bucket = F.floor(F.col("t") / 2)
    before = {(r.k, r.t): r.prev and r.prev.v for r in previous_row(df, ["k"], ["t"], ["v"], bucket).collect()}
    assert before == {("a", 1): None, ("a", 2): 10, (None, 1): None, (None, 2): 5, ("b", None): None}
    sums = {(r.k, r.t): r.s for r in running_sum(df, ["k"], ["t"], {"v": "s"}, bucket).collect()}
    assert sums == {("a", 1): 10, ("a", 2): 30, (None, 1): 5, (None, 2): 11, ("b", None): 7}
    assert carry_last(df, ["k"], ["t"], "v", bucket, "c").count() == 5


def test_distribution_keeps_the_null_group(spark):
    df = spark.createDataFrame([("a", 1.0), (None, 2.0), (None, 3.0)], "g string, v double")
    found = {(r.g, r.value): (r.below, r.total) for r in distribution(df, ["g"], "v").collect()}
    assert found == {("a", 1.0): (0, 1), (None, 2.0): (0, 2), (None, 3.0): (1, 2)}


def test_label_takes_the_leftmost_day_of_its_window(spark):
    labels = spark.createDataFrame([(1, 0, 100.0, 0.0), (1, 1, 100.0, 9.0), (1, 2, 100.0, 60.0)], "page int, label int, x double, y double")
    days = spark.createDataFrame(
        [(1, 5, 97.0, 2.0), (1, 6, 120.0, 0.0), (1, 7, 94.0, 0.0), (1, 8, 150.0, 18.0), (1, 9, 181.0, 60.0), (2, 1, 101.0, 0.0)],
        "page int, day int, x double, y double",
    )
    rows = {r.label: r.day for r in L.label_then_day(labels, days, ["page"], "label").collect()}
    assert rows == {0: 5, 1: 5}


def test_stop_clauses_end_at_their_own_words(spark):
    texts = ["INTERROTTO NEL MESE DI AGOSTO OFFERTA SETTEMBRE", "SERVIZIO INTERROTTO NEI MESI DI AGOSTO OFFERTA SETTEMBRE"]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select(R.stopped_months_of(F.col("t")).alias("m"))
    assert [r.m for r in df.collect()] == [[8, 9], [8]]


def test_options_come_from_the_named_or_first_select(spark):
    one = "<option data-zona='Z'>Via A</option>"
    pages = [
        (1, f"<select>{one.replace('Z', 'X')}</select><select id='vie'>{one}</select>"),
        (2, f"<select name=a>{one}</select><select>{one.replace('Z', 'Y')}</select>"), (3, "none"),
    ]
    df = spark.createDataFrame(pages, "page int, html string")
    rows = H.tagged_labels(df, "page", H.first_block(F.col("html"), "select", "vie"), "option", "data-zona").collect()
    assert [(r.page, r["data-zona"]) for r in rows] == [(1, "Z"), (2, "Z")]


def test_long_zones_and_rules_stay_apart(spark):
    zone = "Via " + "molto " * 30
    page = [(1, f"<h3>{zone}</h3><p>Date spazzamento 2026: 03/04, 05/06</p>")]
    df = spark.createDataFrame(page, "page int, html string")
    assert H.heading_dates(df, "page", "html", 2026).count() == 2
    assert H.heading_dates(df, "page", "html", 2026, longest_zone=100).count() == 0
    rule = "OGNI PRIMO LUNEDI DEL MESE NEI MESI DI " + "GENNAIO " * 8
    cells = [(1, 0, ["Zona", "Toponimo", "Giorno"]), (1, 1, ["", "Via Roma", rule + "A"]), (1, 2, ["", "Via Po", rule + "B"])]
    table = spark.createDataFrame(cells, "page int, row_no int, cells array<string>")
    rules, streets = H.sweep_tables(table, "page", "m")
    assert rules.select("code").distinct().count() == 2


def test_unknown_bins_are_question_marks(spark):
    cal = spark.createDataFrame([("c", dt.date(2026, 1, 1), b) for b in (1, 250, -7)], "calendar_id string, date date, bin int")
    assert C.day_labels(cal).first().initials.count("?") == 2


def test_long_names_are_kept_whole(spark):
    df = spark.createDataFrame([("via " + "x" * 3000,)], "n string").select(title_name(F.col("n")).alias("n"))
    assert len(df.first().n) == 3004


def test_backlog_of_ticks_uses_a_folder_for_each(spark, tmp_path):
    """Two batches; every tick's marks lie under its own instant."""
    from test_streaming import CAL, REQ, put, req, stream, subscribe

    put(spark, tmp_path / "in", "b1", [req(1, "2026-01-01T10:00:00", hour="1")], REQ)
    subscribe(spark, tmp_path)
    cal = spark.createDataFrame(CAL, "calendar_id string, date date, bin int")
    start = dt.datetime(2026, 2, 1)
    for name, hours in (("t0", (0, 1, 2)), ("t1", (3,))):
        put(spark, tmp_path / "ticks", name, [(start + dt.timedelta(hours=h),) for h in hours], "ts timestamp_ntz")
        P.dispatch_stream(
            stream(spark, tmp_path / "ticks", "ts timestamp_ntz"), str(tmp_path / "state"), str(tmp_path / "marks"), cal,
            (2026, 2027), lambda planned: planned.select("key", F.lit(201).alias("status")), str(tmp_path / "cp2"),
        ).awaitTermination()
    folders = sorted(int(p.name.split("=")[1]) for p in (tmp_path / "marks").iterdir() if p.name.startswith("batch="))
    first = int(start.replace(tzinfo=dt.timezone.utc).timestamp())
    assert folders == [first + 3600 * h for h in range(4)]


def test_clusters_are_measured_from_their_first_token(spark):
    tokens = spark.createDataFrame([(1, i, float(y)) for i, y in enumerate((0, 2, 4, 6, 20, 23, 26))], "page int, id int, y double")
    rows = {r.y: r.cluster_y for r in L.token_clusters(tokens, ["page"], "y", "id", 10.0).collect()}
    assert rows == {0: 0, 2: 0, 4: 4, 6: 4, 20: 20, 23: 20, 26: 26}
