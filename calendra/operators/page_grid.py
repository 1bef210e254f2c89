"""Calendar pages read by geometry: month columns under several header rows, and colour chips.

Points meet windows through cells of a grid, by equality: a window lists the cells it covers,
a point its own. Headers of a page and the columns under them are a few dozen at most; only
they are gathered per page. Words are dealt by page once, and all that is made of them stays
where its page is; of words only those of a run of lines are gathered.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from calendra.operators.layout import nearest_in_reach, token_clusters

# Rows and columns of a calendar page, reach of its labels, window of its chips.
HEADERS_ABOVE, YEAR_BAND, ROW_BAND, ROW_SORT = 1200.0, 20.0, 40.0, 20.0
LEFT_OF_HEADER, RIGHT_GAP, PAGE_EDGE = 15.0, 5.0, 10.0
BELOW_HEADER, ABOVE_NEXT, ROW_HEIGHT, PAGE_FOOT = 10.0, 10.0, 340.0, 80.0
DAY_INDENT, LABEL_CLUSTER, LABEL_NEAR = 45.0, 3.0, 8.0
CHIP_FROM, CHIP_TO, CHIP_BAND = 8.0, 58.0, 9.0

CELL = 60.0


def in_rectangles(points: DataFrame, rectangles: DataFrame, keys: Sequence[str], cell: float | None = CELL) -> DataFrame:
    """Points (x, y) with every rectangle [x0, x1) x [y0, y1] of their key that holds them.

    Without a cell the rectangles of a key are a few: they become one array a key, which its
    points meet by key alone, unsorted, and points which are dealt by key stay where they are.
    """
    keys = list(keys)

    def cells(low: str, high: str) -> Column:
        return F.sequence(F.floor(F.col(low) / cell), F.floor(F.col(high) / cell))

    open_ = rectangles.where("x0 < x1 AND y0 <= y1")
    if cell is None:
        few = open_.groupBy(*keys).agg(F.collect_list(F.struct(*[c for c in open_.columns if c not in keys])).alias("_few"))
        x, y = F.col("x"), F.col("y")
        holding = F.filter("_few", lambda r: (x >= r["x0"]) & (x < r["x1"]) & (y >= r["y0"]) & (y <= r["y1"]))
        return points.join(few.hint("shuffle_hash"), keys).select(*points.columns, F.inline(holding))
    tiles = open_.withColumn("_cx", F.explode(cells("x0", "x1"))).withColumn("_cy", F.explode(cells("y0", "y1")))
    placed = points.withColumns({"_cx": F.floor(F.col("x") / cell), "_cy": F.floor(F.col("y") / cell)})
    return placed.join(tiles, [*keys, "_cx", "_cy"]).where("x >= x0 AND x < x1 AND y >= y0 AND y <= y1").drop("_cx", "_cy")


def paired_headers(words: DataFrame, months: Mapping[str, int]) -> DataFrame:
    """Month headers with the nearest year of their row: page, seq, x, y, month, year.

    A year belongs to the row within ``YEAR_BAND``; the nearest in x wins, then the first word.
    """
    top = words.where(F.col("y") < HEADERS_ABOVE).withColumn("text", F.upper(F.trim("text")))
    number = F.coalesce(*[F.when(F.col("text") == name, F.lit(no)) for name, no in months.items()])
    heads = top.where(F.col("text").isin(*months)).select("page", "seq", "x", "y", number.alias("month"))
    years = top.where(F.col("text").rlike(r"^20\d{2}$")).select(
        "page", F.col("text").cast("int").alias("year"), F.col("x").alias("yx"), F.col("y").alias("yy"), F.col("seq").alias("yseq"),
        F.floor(F.col("y") / YEAR_BAND).alias("_band"),
    )
    band = F.floor(F.col("y") / YEAR_BAND)
    near = heads.withColumn("_band", F.explode(F.array(band - 1, band, band + 1))).join(years, ["page", "_band"])
    distance = F.struct(F.abs(F.col("yx") - F.col("x")), F.col("yseq"))
    return near.where(F.abs(F.col("yy") - F.col("y")) <= YEAR_BAND).groupBy("page", "seq", "x", "y", "month").agg(
        F.min_by("year", distance).alias("year")
    )


def month_columns(headers: DataFrame, pages: DataFrame) -> DataFrame:
    """Rectangles of the months: page, col, x0, x1, y0, y1, month and year.

    Headers are read by lines, then x; a row is opened by a header more than ``ROW_BAND`` from
    the first of the row before. ``pages`` has page, width and height.
    """
    head = F.struct(F.bround(F.col("y") / ROW_SORT).alias("line"), "x", "y", "seq", "month", "year")
    step = "struct<row: int, first: double, x: double, y: double, seq: bigint, month: int, year: int>"

    def placed(done: Column, h: Column) -> Column:
        last = F.element_at(done, -1)
        start = F.size(done) == 0
        opens = start | (F.abs(h["y"] - F.try_element_at(done, F.lit(-1))["first"]) > ROW_BAND)
        row = F.when(start, F.lit(0)).when(opens, F.try_element_at(done, F.lit(-1))["row"] + 1).otherwise(last["row"])
        first = F.when(opens, h["y"]).otherwise(last["first"])
        own = F.struct(
            row.alias("row"), first.alias("first"), h["x"].alias("x"), h["y"].alias("y"), h["seq"].cast("bigint").alias("seq"),
            h["month"].alias("month"), h["year"].alias("year"),
        )
        return F.concat(done, F.array(own.cast(step)))

    rows = headers.groupBy("page").agg(F.array_sort(F.collect_list(head)).alias("heads")).select(
        "page", F.inline(F.aggregate("heads", F.array().cast(f"array<{step}>"), placed))
    )
    in_row = W.partitionBy("page", "row")
    # rows are numbered without a hole, so the next one is that of the next number
    next_row = W.partitionBy("page").orderBy("row").rangeBetween(1, 1)
    tops = rows.withColumns({"top": F.min("y").over(in_row), "next_top": F.min("y").over(next_row)})
    spread = tops.withColumn("next_x", F.lead("x").over(in_row.orderBy("x", "seq"))).join(pages.hint("merge"), "page")
    y0 = F.col("top") + BELOW_HEADER
    return spread.select(
        "page", F.col("seq").alias("col"), (F.col("x") - LEFT_OF_HEADER).alias("x0"),
        F.coalesce(F.col("next_x") - RIGHT_GAP, F.col("width") - PAGE_EDGE).alias("x1"), y0.alias("y0"),
        F.coalesce(F.col("next_top") - ABOVE_NEXT, F.least(F.col("height") - PAGE_FOOT, y0 + ROW_HEIGHT)).alias("y1"), "month", "year",
    )


def page_entries(
    words: DataFrame, pages: DataFrame, months: Mapping[str, int], weekdays: Sequence[str], bins_of: Callable[[Column], Column],
    fillers: Sequence[str] = (),
) -> DataFrame:
    """Dated bins of pages whose months stand in rows of columns: page, date and bin.

    ``words`` has page, seq, x, y and text. A column's numbers near its left edge are days (the
    last of equal numbers counts); its words that name bins, or are ``fillers`` of such names,
    are clustered by line into phrases, and a day takes the nearest phrase.
    """
    columns = month_columns(paired_headers(words, months), pages)
    text = F.regexp_replace(F.trim("text"), r"\s+", " ")
    inside = in_rectangles(words.withColumn("text", text).where("text <> ''"), columns, ["page"], None)
    keys = ["page", "col"]
    number = F.col("text").rlike(r"^\d{1,2}$")
    day = F.col("text").try_cast("int")
    days = inside.where(number & day.between(1, 31) & (F.col("x") - F.col("x0") < DAY_INDENT)).groupBy(*keys, "month", "year", day.alias("day")).agg(
        F.max_by("y", "seq").alias("y")
    )
    upper = F.upper("text")
    plain = ~number & ~upper.isin(*months, *weekdays) & ~F.col("text").rlike(r"^20\d{2}$")
    named = (F.size(bins_of(F.col("text"))) > 0) | F.lower("text").isin(*fillers)
    labels = inside.where(plain & named).select(*keys, "seq", "y", "text")
    phrases = token_clusters(labels, keys, "y", "seq", None, LABEL_CLUSTER).groupBy(*keys, "cluster_y").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("y", "text"))), lambda t: t["text"]), " ").alias("phrase")
    )
    met = nearest_in_reach(
        days, phrases.withColumn("y", F.col("cluster_y")), keys, "y", "cluster_y", LABEL_NEAR, "cluster_y", ["phrase"]
    ).where(F.col("dist") < LABEL_NEAR)
    dated = met.withColumn("date", F.try_to_date(F.format_string("%04d-%02d-%02d", "year", "month", "day")))
    return dated.where("date IS NOT NULL").select("page", "date", F.explode(bins_of(F.col("phrase"))).alias("bin")).distinct()


def chips_of_days(anchors: DataFrame, fills: DataFrame, pages: DataFrame) -> DataFrame:
    """The largest fill of each bin in the window of a day: page, month, day, bin and area.

    ``anchors`` has page, month, day, x and y; ``fills`` page, x, y, bin and area; ``pages``
    page and landscape. The window lies right of the number on landscape pages and below it
    on others, where both coordinates are exchanged first.
    """

    def turned(df: DataFrame) -> DataFrame:
        across, down = F.when(F.col("landscape"), F.col("x")).otherwise(F.col("y")), F.when(F.col("landscape"), F.col("y")).otherwise(F.col("x"))
        return df.join(pages.select("page", "landscape"), "page").withColumns({"_a": across, "_d": down}).drop("x", "y", "landscape").withColumnsRenamed({"_a": "x", "_d": "y"})

    windows = turned(anchors).select(
        "page", "month", "day", (F.col("x") + CHIP_FROM).alias("x0"), (F.col("x") + CHIP_TO).alias("x1"),
        (F.col("y") - CHIP_BAND).alias("y0"), (F.col("y") + CHIP_BAND).alias("y1"),
    )
    met = in_rectangles(turned(fills), windows, ["page"]).where("x > x0")
    return met.groupBy("page", "month", "day", "bin").agg(F.max("area").alias("area"))
