"""Layout queries: the generic nearest, as-of and interval joins over event sequences."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from calendra.functions.lineage import spread
from calendra.operators import layout as L
from calendra.operators import page_grid as G
from calendra.plans import views as V
from calendra.plans.registry import query


def typed(spark: SparkSession, sf: str, kind: str) -> DataFrame:
    return V.table(spark, sf, "events").where(F.col("event_type") == kind).select(
        F.col("user_id").alias("page"), F.col("event_id").alias("id"), F.col("value").alias("x")
    )


@query(
    "c01_nearest_anchor",
    """WITH m AS (SELECT user_id AS page, event_id AS id, value AS x FROM events WHERE event_type = 'click'),
    a AS (SELECT user_id AS page, event_id AS aid, value AS ax FROM events WHERE event_type = 'purchase'),
    j AS (SELECT m.*, aid, abs(x - ax) AS d, row_number() OVER (PARTITION BY id ORDER BY abs(x - ax), ax, aid) AS rn FROM m JOIN a USING (page))
    SELECT page, id, x, aid AS anchor FROM j WHERE rn = 1 AND d <= 20""",
)
def c01(spark: SparkSession, sf: str) -> DataFrame:
    out = L.nearest(typed(spark, sf, "click"), typed(spark, sf, "purchase"), ["page"], "x", "id", "id", 20.0, 40.0)
    return out.select("page", "id", "x", "anchor")


def clock(spark: SparkSession, sf: str, kinds: tuple[str, ...]) -> DataFrame:
    """Events on a time axis in minutes of the month."""
    minutes = (F.unix_micros(F.col("ts").cast("timestamp")) / F.lit(60e6)).alias("y")
    return V.table(spark, sf, "events").where(F.col("event_type").isin(*kinds)).select(
        F.col("user_id").alias("page"), F.col("event_id").alias("id"), minutes, "value", "event_type"
    )


CLOCK = "ck AS (SELECT user_id AS page, event_id AS id, epoch_us(ts) / 60e6 AS y, event_type, value FROM events)"
DAY = 1440.0


@query(
    "c02_row_intervals",
    f"""WITH {CLOCK}, h AS (SELECT page, id AS hid, y AS y0, lead(y) OVER (PARTITION BY page ORDER BY y) - 5e0 AS y1 FROM ck WHERE event_type = 'signup')
    SELECT ck.page, ck.id, hid AS row FROM ck JOIN h ON ck.page = h.page AND y >= y0 AND (y1 IS NULL OR y < y1) WHERE event_type IN ('click', 'view')""",
)
def c02(spark: SparkSession, sf: str) -> DataFrame:
    marks, heads = clock(spark, sf, ("click", "view")), clock(spark, sf, ("signup",))
    return L.in_rows(marks, heads, ["page"], "y", "id", "id", DAY).select("page", "id", "row")


@query(
    "c02_leftmost_in_row",
    f"""WITH {CLOCK}, h AS (SELECT page, id AS hid, y AS y0, lead(y) OVER (PARTITION BY page ORDER BY y) - 5e0 AS y1 FROM ck WHERE event_type = 'signup'),
    i AS (SELECT ck.page, hid AS row, value, ck.id FROM ck JOIN h ON ck.page = h.page AND y >= y0 AND (y1 IS NULL OR y < y1) WHERE event_type IN ('click', 'view'))
    SELECT page, row, min(value) AS value, arg_min(id, (value, id)) AS id FROM i GROUP BY 1, 2""",
)
def c02_leftmost(spark: SparkSession, sf: str) -> DataFrame:
    marks, heads = clock(spark, sf, ("click", "view")), clock(spark, sf, ("signup",))
    inside = L.in_rows(marks, heads, ["page"], "y", "id", "id", DAY).select("page", "row", "value", "id")
    return L.keep_leftmost(inside, ["page", "row"], "value")


@query(
    "c03_last_header_above",
    f"""WITH {CLOCK}, m AS (SELECT * FROM ck WHERE event_type = 'view'), h AS (SELECT page, id AS hid, y AS hy FROM ck WHERE event_type = 'signup'),
    a AS (SELECT m.id, arg_max(hid, hy) AS header FROM m JOIN h ON m.page = h.page AND hy <= y GROUP BY 1),
    b AS (SELECT m.id, arg_min(hid, hy) AS header FROM m JOIN h ON m.page = h.page AND hy > y GROUP BY 1)
    SELECT m.page, m.id, CAST(coalesce(a.header, b.header) AS DOUBLE) AS header FROM m LEFT JOIN a ON a.id = m.id LEFT JOIN b ON b.id = m.id""",
)
def c03(spark: SparkSession, sf: str) -> DataFrame:
    out = L.last_above(clock(spark, sf, ("view",)), clock(spark, sf, ("signup",)), ["page"], "y", "id", "id", DAY)
    return out.select("page", "id", F.col("header").cast("double").alias("header"))


KINDS = ("view", "signup", "click", "error", "purchase")


RUNS = f"""{CLOCK}, s AS (SELECT *, CASE WHEN y - lag(y) OVER w > 360 OR lag(y) OVER w IS NULL THEN 1 ELSE 0 END AS st FROM ck WINDOW w AS (PARTITION BY page ORDER BY y, id)),
r AS (SELECT *, CAST(sum(st) OVER (PARTITION BY page ORDER BY y, id) AS BIGINT) AS run FROM s)"""


def runs(spark: SparkSession, sf: str) -> DataFrame:
    return L.token_runs(clock(spark, sf, KINDS), ["page"], "y", "id", DAY, gap=360.0)


@query("c04_token_runs", f"WITH {RUNS} SELECT page, id, run FROM r")
def c04(spark: SparkSession, sf: str) -> DataFrame:
    return runs(spark, sf).select("page", "id", "run")


@query(
    "c04_token_clusters",
    f"""WITH RECURSIVE {CLOCK}, st AS (
      SELECT page, min(y) AS s FROM ck GROUP BY 1
      UNION ALL SELECT st.page, (SELECT min(y) FROM ck WHERE ck.page = st.page AND ck.y > st.s + 360) FROM st WHERE st.s IS NOT NULL)
    SELECT ck.page, id, max(s) AS cluster_y FROM ck JOIN st ON ck.page = st.page AND s <= y GROUP BY 1, 2""",
)
def c04_clusters(spark: SparkSession, sf: str) -> DataFrame:
    return L.token_clusters(clock(spark, sf, KINDS), ["page"], "y", "id", DAY, 360.0).select("page", "id", "cluster_y")


@query(
    "c04_run_extents",
    f"""WITH {RUNS} SELECT page, run, min(y) AS y0, count(*) AS tokens, arg_min(event_type, (y, id)) AS first_text, arg_max(event_type, (y, id)) AS last_text FROM r GROUP BY 1, 2""",
)
def c04_extents(spark: SparkSession, sf: str) -> DataFrame:
    return L.group_extents(runs(spark, sf), ["page", "run"], ["y", "id"], "y", "event_type")


@query(
    "c04_line_bins",
    """SELECT user_id AS page, CAST(round_even(value / 20e0, 0) AS BIGINT) AS row, string_agg(DISTINCT length(event_type)::VARCHAR, ',' ORDER BY length(event_type)::VARCHAR) AS bins FROM events GROUP BY 1, 2""",
)
def c04_bins(spark: SparkSession, sf: str) -> DataFrame:
    tokens = V.table(spark, sf, "events").select(F.col("user_id").alias("page"), F.col("value").alias("y"), "event_type")
    bins = L.group_bins(L.token_rows(tokens, "y"), ["page", "row"], F.array(F.length("event_type")))
    return bins.withColumn("bins", F.array_join(F.col("bins").cast("array<string>"), ","))


PALETTE = ((0, 0.2, 0.0, 0.0), (1, 0.0, 0.2, 0.0), (2, 0.0, 0.0, 0.2), (3, -0.2, -0.1, 0.0), (4, 0.1, -0.2, -0.1))


def dist_sql(p) -> str:
    return " + ".join(f"(e{i} - ({c}e0)) * (e{i} - ({c}e0))" for i, c in enumerate(p[1:]))


@query(
    "c05_nearest_colour",
    f"""WITH e AS (SELECT vec_id, embedding[1]::DOUBLE AS e0, embedding[2]::DOUBLE AS e1, embedding[3]::DOUBLE AS e2 FROM embeddings),
    d AS (SELECT vec_id, unnest([{', '.join(dist_sql(p) for p in PALETTE)}]) AS d, unnest([0, 1, 2, 3, 4]) AS bin FROM e)
    SELECT vec_id, CAST(CASE WHEN min(d) <= 0.08e0 THEN arg_min(bin, (d, bin)) END AS DOUBLE) AS bin FROM d GROUP BY 1""",
)
def c05(spark: SparkSession, sf: str) -> DataFrame:
    r, g, b = (F.col("embedding")[i].cast("double") for i in range(3))
    bin_no = L.nearest_colour(r, g, b, PALETTE, L.COLOUR_LIMITS["tight"])
    return V.table(spark, sf, "embeddings").select("vec_id", bin_no.cast("double").alias("bin"))


@query(
    "c06_header_strip",
    """WITH t AS (SELECT l_suppkey AS page, CAST(month(l_shipdate) AS INTEGER) AS month, l_quantity AS y, l_orderkey * 10 + l_linenumber AS x, round_even(l_quantity / 5e0, 0) * 5 AS strip FROM lineitem),
    s AS (SELECT page, strip, count(DISTINCT month) AS months, min(y) AS start FROM t GROUP BY 1, 2),
    b AS (SELECT page, arg_max(strip, (months, -start)) AS strip FROM s GROUP BY 1)
    SELECT page, month, min(x) AS x, arg_min(y, (x, y)) AS y FROM t JOIN b USING (page, strip) GROUP BY 1, 2""",
)
def c06(spark: SparkSession, sf: str) -> DataFrame:
    heads = V.table(spark, sf, "lineitem").select(
        F.col("l_suppkey").alias("page"), F.month("l_shipdate").alias("month"), F.col("l_quantity").alias("y"),
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("x"),
    )
    return L.header_strip(heads, "page", "y", "x")


# Grids: pages are suppliers, month columns every 100 units, day rows every 20.
def grid_marks(spark: SparkSession, sf: str) -> DataFrame:
    q = F.col("l_quantity")
    return V.table(spark, sf, "lineitem").select(
        F.col("l_suppkey").alias("page"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"),
        (q * 24.0 + F.col("l_linenumber")).alias("x"), ((F.col("l_partkey") % 640) + 0.25).alias("y"),
        (F.col("l_linenumber") % 6).alias("bin"), (F.col("l_extendedprice")).alias("area"),
    )


def grid_axes(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    pages = V.table(spark, sf, "supplier").select(F.col("s_suppkey").alias("page"))
    months = pages.select("page", F.explode(F.sequence(F.lit(1), F.lit(12))).alias("month")).withColumn("x", F.col("month") * 100.0)
    days = months.select("page", "month", F.explode(F.sequence(F.lit(1), F.lit(31))).alias("day")).withColumn("y", F.col("day") * 20.0)
    return months, days


GRID = """g AS (SELECT l_suppkey AS page, l_quantity * 24e0 + l_linenumber AS x, (l_partkey % 640) + 0.25e0 AS y, CAST(l_linenumber % 6 AS INTEGER) AS bin, l_extendedprice AS area FROM lineitem),
n AS (SELECT *, least(12, greatest(1, CAST(ceil(x / 100e0 - 0.5e0) AS INTEGER))) AS month, least(31, greatest(1, CAST(ceil(y / 20e0 - 0.5e0) AS INTEGER))) AS day FROM g)"""


@query(
    "c07_month_grid",
    f"""WITH {GRID} SELECT page, make_date(2026, month, 1) + (day - 1) AS date, bin, max(area) AS area FROM n
    WHERE abs(y - day * 20e0) <= 20 AND day <= day(last_day(make_date(2026, month, 1))) GROUP BY ALL""",
)
def c07(spark: SparkSession, sf: str) -> DataFrame:
    return L.month_grid(grid_marks(spark, sf), *grid_axes(spark, sf), ["page"], 2026)


@query(
    "c07_letters_of_days",
    """WITH l AS (SELECT DISTINCT l_suppkey AS page, round_even((l_partkey % 640) / 6e0, 0) * 6 AS ky, CAST(l_linenumber % 6 AS INTEGER) AS bin FROM lineitem),
    d AS (SELECT s_suppkey AS page, m, unnest(range(1, 32)) AS day FROM supplier, range(1, 13) r(m))
    SELECT DISTINCT page, make_date(2026, CAST(m AS INTEGER), 1) + CAST(day - 1 AS INTEGER) AS date, bin FROM d JOIN l USING (page)
    WHERE abs(ky - day * 20) <= 14 AND day <= day(last_day(make_date(2026, CAST(m AS INTEGER), 1)))""",
)
def c07_letters(spark: SparkSession, sf: str) -> DataFrame:
    letters = V.table(spark, sf, "lineitem").select(
        F.col("l_suppkey").alias("page"), (F.col("l_partkey") % 640).cast("double").alias("y"), (F.col("l_linenumber") % 6).alias("bin")
    )
    return L.letters_of_days(letters, grid_axes(spark, sf)[1], ["page"], 2026)


@query(
    "c07_split_columns",
    """WITH s AS (SELECT l_suppkey AS page, l_orderkey, l_linenumber, CASE WHEN l_suppkey % 2 = 0 THEN l_quantity ELSE least(l_quantity, 30) END * 3e0 + l_suppkey AS x FROM lineitem),
    m AS (SELECT page, min(x) AS lo, max(x) AS hi FROM s GROUP BY 1)
    SELECT page, l_orderkey, l_linenumber, CASE WHEN hi - lo > 120 AND x >= (lo + hi) / 2e0 THEN 'c2' ELSE 'c1' END AS "column" FROM s JOIN m USING (page)""",
)
def c07_split(spark: SparkSession, sf: str) -> DataFrame:
    spread = F.when(F.col("l_suppkey") % 2 == 0, F.col("l_quantity")).otherwise(F.least("l_quantity", F.lit(30.0)))
    letters = V.table(spark, sf, "lineitem").select(
        F.col("l_suppkey").alias("page"), "l_orderkey", "l_linenumber", (spread * 3.0 + F.col("l_suppkey")).alias("x")
    )
    return L.split_columns(letters, ["page"]).select("page", "l_orderkey", "l_linenumber", "column")


@query(
    "c07_icon_grid",
    """WITH i AS (SELECT l_suppkey AS page, l_quantity * 14e0 AS x, (l_partkey % 640) + 0.25e0 AS y FROM lineitem),
    n AS (SELECT page, x, y, least(6, greatest(0, CAST(ceil(x / 100e0 - 0.5e0) AS INTEGER))) AS weekday, least(5, greatest(0, CAST(ceil(y / 100e0 - 0.5e0) AS INTEGER))) AS bin FROM i)
    SELECT DISTINCT page, weekday, bin FROM n WHERE abs(x - weekday * 100e0) <= 48 AND abs(y - bin * 100e0) <= 40""",
)
def c07_icons(spark: SparkSession, sf: str) -> DataFrame:
    icons = grid_marks(spark, sf).select("page", "id", F.col("y"), icon_x().alias("x"))
    pages = V.table(spark, sf, "supplier").select(F.col("s_suppkey").alias("page"))
    cols = pages.select("page", F.explode(F.sequence(F.lit(0), F.lit(6))).alias("weekday")).withColumn("x", F.col("weekday") * 100.0)
    rows = pages.select("page", F.explode(F.sequence(F.lit(0), F.lit(5))).alias("bin")).withColumn("y", F.col("bin") * 100.0)
    return L.icon_grid(icons, cols, rows, ["page"])


def icon_x() -> Column:
    return (F.col("x") - F.col("id") % 10) / 24.0 * 14.0


@query(
    "c07_label_then_day",
    """WITH b AS (SELECT p_partkey AS page, unnest([0, 1, 2]) AS k, p_size FROM part),
    l AS (SELECT page, k, p_size + k * 50 AS x, k * 9e0 AS y FROM b),
    d AS (SELECT page, 1 + (p_size + k) % 28 AS day, p_size + k * 50 + CASE WHEN p_size <= 30 OR k = 0 THEN 60 ELSE 200 END AS x, k * 9e0 + 3 AS y FROM b
      UNION ALL SELECT page, 31, p_size + k * 50 - CASE WHEN p_size % 4 = 0 THEN 3 ELSE 9 END, k * 9e0 - 4 FROM b)
    SELECT l.page, CAST(k AS BIGINT) AS label, CAST(min_by(day, (d.x - l.x) * 1000000 + d.y * 1000 + day) AS INTEGER) AS day
    FROM l JOIN d ON l.page = d.page AND abs(d.y - l.y) <= 10 AND d.x - l.x BETWEEN -5 AND 80 GROUP BY ALL""",
)
def c07_labels(spark: SparkSession, sf: str) -> DataFrame:
    """Three lines nine units apart per part: a label, its number to the right (near or too
    far), and one to the left, three units away or too far."""
    k, size = F.col("k"), F.col("p_size")
    lines = V.table(spark, sf, "part").select(
        F.col("p_partkey").alias("page"), "p_size", F.explode(F.array(*[F.lit(i) for i in range(3)])).alias("k")
    )
    labels = lines.select("page", k.cast("bigint").alias("label"), (size + k * 50.0).alias("x"), (k * 9.0).alias("y"))
    reach = F.when((size <= 30) | (k == 0), 60.0).otherwise(200.0)
    right = lines.select("page", (1 + (size + k) % 28).alias("day"), (size + k * 50.0 + reach).alias("x"), (k * 9.0 + 3).alias("y"))
    left = lines.select("page", F.lit(31).alias("day"), (size + k * 50.0 - F.when(size % 4 == 0, 3.0).otherwise(9.0)).alias("x"), (k * 9.0 - 4).alias("y"))
    return L.label_then_day(labels, right.unionByName(left), ["page"], "label").select(
        "page", "label", F.col("day").cast("int").alias("day")
    )


MONTH_NAMES = ("GENNAIO", "FEBBRAIO", "MARZO", "APRILE", "MAGGIO", "GIUGNO", "LUGLIO", "AGOSTO", "SETTEMBRE", "OTTOBRE", "NOVEMBRE", "DICEMBRE")
PAGE_BINS = {"organico": 0, "carta": 1, "vetro": 5}
# A header per month, three in a row; a year left of each row and one right of it, nearer to the third month.
PAGE_SQL = """it AS (SELECT l_suppkey AS page, CAST(month(l_shipdate) AS INTEGER) AS m, CAST(day(l_shipdate) AS INTEGER) AS d, l_linenumber AS k FROM lineitem),
dy AS (SELECT DISTINCT page, m, d FROM it),
lb AS (SELECT DISTINCT page, m, d, [0, 1, 5][k % 4 + 1] AS bin FROM it WHERE k % 4 < 3),
ph AS (SELECT dy.*, CASE WHEN EXISTS (SELECT 1 FROM lb WHERE lb.page = dy.page AND lb.m = dy.m AND lb.d = dy.d) THEN d ELSE d - 1 END AS ld FROM dy)"""


def page_words(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """Words of a page per supplier: headers in four rows, days seven units apart, labels two
    and three units below their day. Every fourth line has a day and no label. All words and
    pages are dealt by page; the lines are read and dealt once, and both words made of a line."""
    items = spread(V.table(spark, sf, "lineitem").select(
        F.col("l_suppkey").alias("page"), F.month("l_shipdate").alias("m"), F.dayofmonth("l_shipdate").alias("d"), F.col("l_linenumber").alias("k")
    ), "page").distinct()
    suppliers = V.table(spark, sf, "supplier").select(F.col("s_suppkey").alias("page"), F.lit(480.0).alias("width"), F.lit(1500.0).alias("height"))
    pages = spread(suppliers, "page")

    def word(seq: Column, x: Column, y: Column, text: Column) -> Column:
        return F.struct(seq.cast("bigint").alias("seq"), x.alias("x"), y.alias("y"), text.alias("text"))

    heads = [word(F.lit(i), F.lit(100.0 + (i % 3) * 120.0), F.lit(60.0 + (i // 3) * 300.0), F.lit(n)) for i, n in enumerate(MONTH_NAMES)]
    years = [
        word(F.lit(100 + r * 2 + (x > 100)), F.lit(x), F.lit(65.0 + r * 300.0), F.lit(str(year)))
        for r in range(4) for x, year in ((50.0, 2024 + r), (590.0, 2031))
    ]
    i = F.col("m") - 1
    hx, hy = 100.0 + (i % 3) * 120.0, 60.0 + F.floor(i / 3) * 300.0
    down = hy + 20.0 + F.col("d") * 7.0
    at = 1000 + F.col("m") * 10_000 + F.col("d") * 100 + F.col("k")
    day = word(at, hx - 10.0, down, F.col("d").cast("string"))
    name = F.try_element_at(F.array(F.lit("Organico"), F.lit("carta"), F.lit("VETRO")), (F.col("k") % 4 + 1).cast("int"))
    label = word(at + 50, hx + 20.0 + F.col("k"), down + F.when(F.col("k") % 4 == 2, 3.0).otherwise(2.0), name)
    of_lines = items.select("page", F.inline(F.array(day, F.when(F.col("k") % 4 < 3, label)))).where("seq IS NOT NULL")
    return pages.select("page", F.inline(F.array(*heads, *years))).unionByName(of_lines), pages


def page_bins(text: Column) -> Column:
    low = F.lower(text)
    return F.array_compact(F.array(*[F.when(F.contains(low, F.lit(word)), F.lit(bin_no)) for word, bin_no in PAGE_BINS.items()]))


@query(
    "c07_header_rows",
    f"""WITH {PAGE_SQL}, x AS (SELECT ph.*, bin, CASE WHEN (ph.m - 1) % 3 = 2 THEN 2031 ELSE 2024 + (ph.m - 1) // 3 END AS year FROM ph JOIN lb ON lb.page = ph.page AND lb.m = ph.m AND lb.d = ld)
    SELECT DISTINCT page, make_date(year, m, d) AS date, bin FROM x WHERE d <= day(last_day(make_date(year, m, 1)))""",
)
def c07_headers(spark: SparkSession, sf: str) -> DataFrame:
    words, pages = page_words(spark, sf)
    months = {name: i + 1 for i, name in enumerate(MONTH_NAMES)}
    return G.page_entries(words, pages, months, ("LUN", "MAR", "MER", "GIO", "VEN", "SAB", "DOM"), page_bins)


@query(
    "c07_chips",
    """WITH it AS (SELECT l_suppkey AS page, CAST(month(l_shipdate) AS INTEGER) AS month, CAST(day(l_shipdate) AS INTEGER) AS day, l_linenumber AS k, l_partkey % 3 AS o, l_quantity AS area FROM lineitem),
    a AS (SELECT DISTINCT page, month, day FROM it),
    f AS (SELECT page, month, day + CASE WHEN o = 2 THEN 1 ELSE 0 END AS day, CAST(k % 5 AS INTEGER) AS bin, area FROM it WHERE k < 7)
    SELECT page, month, day, bin, max(area) AS area FROM f JOIN a USING (page, month, day) GROUP BY ALL""",
)
def c07_chips(spark: SparkSession, sf: str) -> DataFrame:
    """Numbers a hundred units apart by month and twenty by day; fills right of them or, on the
    pages of odd suppliers, below them; every third fill lies nearer to the next day."""
    items = V.table(spark, sf, "lineitem").select(
        F.col("l_suppkey").alias("page"), F.month("l_shipdate").alias("month"), F.dayofmonth("l_shipdate").alias("day"),
        F.col("l_linenumber").alias("k"), (F.col("l_partkey") % 3).alias("o"), F.col("l_quantity").alias("area"),
    )
    landscape = F.col("page") % 2 == 0
    along, across = F.col("month") * 100.0, F.col("day") * 20.0

    def at(df: DataFrame, a: Column, b: Column) -> DataFrame:
        return df.withColumns({"x": F.when(landscape, a).otherwise(b), "y": F.when(landscape, b).otherwise(a)})

    anchors = at(items.select("page", "month", "day").distinct(), along, across)
    fills = at(items, along + 10.0 + F.col("k") * 7.0, across + F.col("o") * 6.0).select("page", "x", "y", (F.col("k") % 5).cast("int").alias("bin"), "area")
    pages = V.table(spark, sf, "supplier").select(F.col("s_suppkey").alias("page"), (F.col("s_suppkey") % 2 == 0).alias("landscape"))
    return G.chips_of_days(anchors, fills, pages)


@query(
    "c08_page_carry",
    """WITH p AS (SELECT conv_id, turn, CASE WHEN turn % 3 = 0 THEN md5(text) END AS own FROM conversations)
    SELECT conv_id, turn, coalesce(own, lag(own) OVER (PARTITION BY conv_id ORDER BY turn)) AS title FROM p""",
)
def c08(spark: SparkSession, sf: str) -> DataFrame:
    pages = V.table(spark, sf, "conversations").select(
        "conv_id", "turn", F.when(F.col("turn") % 3 == 0, F.md5("text")).alias("own")
    )
    return L.carry_to_next_page(pages, "conv_id", "turn", "own", F.floor(F.col("turn") / 2)).select("conv_id", "turn", "title")


STRATEGY = """r AS (SELECT c_nationkey AS doc, o_custkey AS page, CASE WHEN o_orderpriority < '4' THEN 'color' ELSE 'weekday' END AS strategy FROM orders JOIN customer ON o_custkey = c_custkey),
c AS (SELECT doc, page, count(*) FILTER (strategy = 'color') AS a, count(*) FILTER (strategy = 'weekday') AS b FROM r GROUP BY 1, 2),
y AS (SELECT doc, page, CASE WHEN a >= 20 OR b <= a THEN 'color' ELSE 'weekday' END AS strategy, CASE WHEN a >= 20 OR b <= a THEN a ELSE b END AS n FROM c)"""


def yields(spark: SparkSession, sf: str) -> DataFrame:
    results = V.table(spark, sf, "orders").select(
        F.col("o_custkey").alias("page"),
        F.when(F.col("o_orderpriority") < "4", F.lit("color")).otherwise(F.lit("weekday")).alias("strategy"),
    )
    docs = V.table(spark, sf, "customer").select(F.col("c_custkey").alias("page"), F.col("c_nationkey").alias("doc"))
    return L.choose_by_yield(results, "page", "color", "weekday").join(docs, "page")


@query("c09_choose_by_yield", f"WITH {STRATEGY} SELECT doc, page, strategy, n FROM y")
def c09(spark: SparkSession, sf: str) -> DataFrame:
    return yields(spark, sf)


@query(
    "c09_keep_pages",
    f"""WITH {STRATEGY}, m AS (SELECT *, max(n) OVER (PARTITION BY doc) AS mx FROM y)
    SELECT doc, page, strategy, n FROM m WHERE n >= CASE WHEN mx >= 20 THEN 20 WHEN mx >= 12 THEN 12 ELSE 0 END""",
)
def c09_keep(spark: SparkSession, sf: str) -> DataFrame:
    return L.keep_pages(yields(spark, sf), "doc")
