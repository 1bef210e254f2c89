"""Pages read by geometry: columns under header rows, phrases of days, chips of days."""

from __future__ import annotations

import datetime as dt
import random

from pyspark.sql import functions as F

from calendra.operators import page_grid as G

MONTHS = {"GENNAIO": 1, "FEBBRAIO": 2, "MARZO": 3, "APRILE": 4}
WORDS = "page int, seq bigint, x double, y double, text string"
PAGES = "page int, width double, height double"


def test_points_meet_every_rectangle_that_holds_them(spark):
    rng = random.Random(4)
    points = [(i % 2, i, rng.uniform(-100, 400), float(rng.randint(-100, 400))) for i in range(300)]
    rects = []
    for i in range(40):
        x0, y0 = rng.uniform(-100, 350), float(rng.randint(-100, 350))
        rects.append((i % 2, i, x0, x0 + rng.uniform(-5, 200), y0, y0 + rng.choice([0.0, 3.0, 180.0])))
    p = spark.createDataFrame(points, "page int, id int, x double, y double")
    r = spark.createDataFrame(rects, "page int, rect int, x0 double, x1 double, y0 double, y1 double")
    got = sorted((t.id, t.rect) for t in G.in_rectangles(p, r, ["page"], 37.0).collect())
    assert got == sorted((i, k) for a, i, x, y in points for b, k, x0, x1, y0, y1 in rects if a == b and x0 <= x < x1 and y0 <= y <= y1)


def headers(page):
    return [
        (page, 0, 100.0, 50.0, "Gennaio"), (page, 1, 250.0, 52.0, " FEBBRAIO "), (page, 2, 90.0, 60.0, "2025"), (page, 3, 300.0, 62.0, "2026"),
        (page, 4, 100.0, 400.0, "marzo"), (page, 5, 260.0, 418.0, "aprile"), (page, 6, 120.0, 405.0, "2026"), (page, 7, 100.0, 900.0, "gennaio"),
        (page, 8, 200.0, 1300.0, "2027"), (page, 9, 100.0, 1300.0, "marzo"),
    ]


def test_headers_take_the_nearest_year_of_their_row(spark):
    df = spark.createDataFrame(headers(1), WORDS)
    got = sorted((r.month, r.year, r.y) for r in G.paired_headers(df, MONTHS).collect())
    # the header at 900 has no year in reach, those below the limit are not read
    assert got == [(1, 2025, 50.0), (2, 2026, 52.0), (3, 2026, 400.0), (4, 2026, 418.0)]


def test_columns_of_two_rows_and_the_page_edge(spark):
    pages = spark.createDataFrame([(1, 500.0, 800.0)], PAGES)
    heads = G.paired_headers(spark.createDataFrame(headers(1), WORDS), MONTHS)
    got = {r.month: (r.x0, r.x1, r.y0, r.y1) for r in G.month_columns(heads, pages).collect()}
    # a row is as high as its highest header, and ends ten units above the next one's
    assert got == {1: (85.0, 245.0, 60.0, 390.0), 2: (235.0, 490.0, 60.0, 390.0), 3: (85.0, 255.0, 410.0, 720.0), 4: (245.0, 490.0, 410.0, 720.0)}


def bins(text):
    return F.array_compact(F.array(*[F.when(F.contains(F.lower(text), F.lit(w)), F.lit(b)) for w, b in (("carta", 1), ("non rec", 7), ("vetro", 5))]))


def test_days_take_the_nearest_phrase(spark):
    words = headers(1) + [
        (1, 20, 95.0, 100.0, "3"), (1, 21, 140.0, 102.0, "vetro"), (1, 22, 130.0, 104.0, "carta"),  # one line: both
        (1, 23, 95.0, 120.0, "4"), (1, 24, 130.0, 128.0, "carta"),  # eight away: too far
        (1, 25, 95.0, 140.0, "31"), (1, 26, 130.0, 133.0, "LUN"), (1, 27, 130.0, 141.0, "non"), (1, 28, 150.0, 142.0, "rec"),
        (1, 29, 150.0, 160.0, "5"), (1, 30, 130.0, 160.0, "carta"),  # the number is too far from the column's edge
        (1, 31, 255.0, 105.0, "30"), (1, 32, 300.0, 104.0, "carta"),  # the thirtieth of February
        (1, 33, 95.0, 450.0, "7"), (1, 34, 95.0, 470.0, "7"), (1, 35, 130.0, 471.0, "vetro"),  # the later number counts
    ]
    df = spark.createDataFrame(words, WORDS).withColumn("other", F.lit(1))
    pages = spark.createDataFrame([(1, 500.0, 800.0), (2, 500.0, 800.0)], PAGES)
    got = sorted((r.page, r.date, r.bin) for r in G.page_entries(df, pages, MONTHS, ("LUN",), bins, ("non", "rec")).collect())
    day = lambda *a: dt.date(*a)
    # "non" stands before "rec" in its line, so their phrase names a bin that neither names alone
    assert got == [(1, day(2025, 1, 3), 1), (1, day(2025, 1, 3), 5), (1, day(2025, 1, 31), 7), (1, day(2026, 3, 7), 5)]
    assert G.page_entries(df.where("false"), pages, MONTHS, (), bins).count() == 0


def test_chips_right_of_the_number_or_below_it(spark):
    rng = random.Random(6)
    pages = [(1, True), (2, False)]
    anchors = [(p, 1 + i % 12, 1 + i % 28, float(rng.randint(0, 300)), float(rng.randint(0, 300))) for i in range(60) for p in (1, 2)]
    fills = [(p, float(rng.randint(0, 360)), float(rng.randint(0, 360)), rng.randrange(4), float(rng.randint(25, 200))) for _ in range(200) for p in (1, 2)]
    want = {}
    for p, m, d, ax, ay in anchors:
        for q, cx, cy, b, area in fills:
            along, off = (cx - ax, cy - ay) if p == 1 else (cy - ay, cx - ax)
            if p == q and abs(off) <= 9 and 8 < along < 58:
                want[p, m, d, b] = max(want.get((p, m, d, b), 0), area)
    got = G.chips_of_days(
        spark.createDataFrame(anchors, "page int, month int, day int, x double, y double"),
        spark.createDataFrame(fills, "page int, x double, y double, bin int, area double"), spark.createDataFrame(pages, "page int, landscape boolean"),
    )
    assert want and {(r.page, r.month, r.day, r.bin): r.area for r in got.collect()} == want
