"""Import of dated zones: zone, union and collection calendars, and their second run."""

from __future__ import annotations

import datetime as dt

from calendra.operators import overlay as O

RULES = (("CENTRO", "calendars/t-centro"), ("NORD", "calendars/t-nord"), ("EST", "calendars/t-est"))


def day(n):
    return dt.date(2026, 1, n)


def test_import_and_second_run(spark):
    schedules = spark.createDataFrame(
        [(1, "Centro storico", day(1)), (1, "Centro storico", day(8)), (2, "Nord", day(2)), (3, "Est", day(3)), (4, "Ovest", None)],
        "key int, zone string, date date")
    options = spark.createDataFrame(
        [(1, "VIA A", "centro storico"), (2, "VIA B", "Nord, Centro storico"), (3, "VIA C", "boh"), (4, "VIA D", "NORD, centro storico"), (5, "VIA E", "Ovest")],
        "option_id int, street string, zone string")
    entries = spark.createDataFrame(
        [("calendars/t-centro", day(5), 6), ("calendars/t-centro", day(5), 1), ("calendars/t-nord", day(9), 2), ("calendars/t-spa-nord", day(30), 6), ("calendars/o", day(4), 6)],
        "calendar_id string, date date, bin int")
    index = spark.createDataFrame([("t", "VIA A", "calendars/t-spa-gone"), ("t", "VIA A", "calendars/t-centro")], "comune string, name string, calendar string")
    out = O.zone_import(schedules, options, entries, index, RULES, "t")
    got = sorted(map(tuple, out["entries"].collect()))
    spa = "calendars/t-spa-"
    assert got == sorted([
        ("calendars/o", day(4), 6),  # not of this import
        ("calendars/t-centro", day(5), 1), ("calendars/t-centro", day(1), 6), ("calendars/t-centro", day(8), 6),  # its old sweep day is gone
        ("calendars/t-nord", day(9), 2), ("calendars/t-nord", day(2), 6),
        (f"{spa}centro-storico", day(1), 6), (f"{spa}centro-storico", day(8), 6), (f"{spa}nord", day(2), 6), (f"{spa}est", day(3), 6),
        (f"{spa}nord-centro-storico", day(1), 6), (f"{spa}nord-centro-storico", day(8), 6), (f"{spa}nord-centro-storico", day(2), 6),
    ])  # there is no calendar of the east, and none is made
    rows = sorted(map(tuple, out["index"].collect()))
    assert rows == sorted([
        ("t", "VIA A", "calendars/t-centro"), ("t", "VIA A", f"{spa}centro-storico"), ("t", "VIA B", f"{spa}nord-centro-storico"),
        ("t", "VIA D", f"{spa}nord-centro-storico"), ("t", "VIA E", f"{spa}ovest"),
        *[("t", f"Zona {z}", f"{spa}{s}") for z, s in (("Centro storico", "centro-storico"), ("Nord", "nord"), ("Est", "est"), ("Ovest", "ovest"))],
    ])
    assert {r.found: r.streets for r in out["report"].collect()} == {True: 4, False: 1}
    again = O.zone_import(schedules, options, out["entries"], out["index"], RULES, "t")
    assert sorted(map(tuple, again["entries"].collect())) == got and sorted(map(tuple, again["index"].collect())) == rows
