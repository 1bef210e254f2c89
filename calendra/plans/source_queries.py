"""Scan, sink and page-parsing queries over the given tables and texts derived from them."""

from __future__ import annotations

import datetime
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from calendra.functions.lineage import shared_folder
from calendra.plans import views as V
from calendra.plans.registry import query
from calendra.plans.views import CAL, STREET
from calendra.sources import calendar_text as S
from calendra.sources import html as H
from calendra.sources import tables as B


def run_folder(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


CAL2 = f"""{CAL}, ev AS (SELECT DISTINCT user_id AS calendar_id, CAST(ts AS DATE) AS date, CAST(length(event_type) % 7 AS INTEGER) AS bin FROM events)"""


def event_cal(spark: SparkSession, sf: str) -> DataFrame:
    return V.table(spark, sf, "events").select(
        F.col("user_id").alias("calendar_id"), F.to_date("ts").alias("date"), (F.length("event_type") % 7).alias("bin")
    ).distinct()


@query("a01_calendar_text_scan", f"WITH {CAL} SELECT calendar_id, CAST(year(date) AS INTEGER) AS year, date, bin FROM cal")
def a01(spark: SparkSession, sf: str) -> DataFrame:
    lines = S.format_lines(V.cal(spark, sf)).select("calendar_id", F.col("line").alias("value"))
    return S.parse_entries(lines).select("calendar_id", "year", "date", "bin")


@query(
    "a02_calendar_base",
    """SELECT page_id, regexp_replace(url, '[?#].*$', '') AS base, CAST(2020 + page_id % 9 AS INTEGER) AS year FROM pages""",
)
def a02(spark: SparkSession, sf: str) -> DataFrame:
    path = F.concat(F.regexp_replace("url", r"[?#].*$", ""), F.lit("-"), 2020 + F.col("page_id") % 9, F.lit(".H"))
    return V.table(spark, sf, "pages").select(
        "page_id", S.calendar_base(path).alias("base"), S.calendar_year(path).alias("year")
    )


@query(
    "a03_active_entries",
    f"""WITH {CAL2}, u AS (SELECT * FROM cal UNION SELECT * FROM ev)
    SELECT * FROM u WHERE year(date) IN (SELECT DISTINCT year(date) AS y FROM u WHERE year(date) > 2000 ORDER BY y DESC LIMIT 2)""",
)
def a03(spark: SparkSession, sf: str) -> DataFrame:
    parts = [V.cal(spark, sf), event_cal(spark, sf)]
    years = S.latest_years(parts[0].unionByName(parts[1]), 2026)
    return S.merge_years(parts, years).select("calendar_id", "date", "bin")


@query(
    "a04_active_years",
    f"""WITH {CAL2}, u AS (SELECT * FROM cal UNION SELECT * FROM ev)
    SELECT DISTINCT CAST(year(date) AS INTEGER) AS year FROM u WHERE year(date) > 2000 ORDER BY year DESC LIMIT 2""",
)
def a04(spark: SparkSession, sf: str) -> DataFrame:
    return S.latest_years(V.cal(spark, sf).unionByName(event_cal(spark, sf)), 2026)


@query(
    "a05_calendar_text_sink",
    f"""WITH {CAL} SELECT calendar_id, CAST(year(date) AS INTEGER) AS year, date, bin,
      printf('  {{%d, %d, %d, %d}},  // %02d/%02d/%d %s', year(date), month(date), day(date), bin, day(date), month(date), year(date),
        ['Carta', 'Organico', 'Indifferenziata', 'Plastica', 'Verde', 'Vetro', 'Spazzamento'][bin + 1]) AS line FROM cal""",
)
def a05(spark: SparkSession, sf: str) -> DataFrame:
    return S.format_lines(V.cal(spark, sf))


@query(
    "a06_statistics_csv",
    """SELECT CAST(c_custkey AS VARCHAR) AS "IstatComune", c_name AS "Comune", CAST(floor(c_acctbal) AS BIGINT) AS pop FROM customer""",
)
def a06(spark: SparkSession, sf: str) -> DataFrame:
    """Customers written as files with a preamble, header and tabs, then scanned back."""
    folder = run_folder(spark, "csv")
    part = F.pmod(F.xxhash64("c_custkey"), F.lit(4)).alias("part")
    customer = V.table(spark, sf, "customer")
    # every other file has its columns in another order
    pop, swapped = F.floor("c_acctbal").cast("string"), F.col("part") % 2 == 1
    code = F.concat(F.lit("\t"), "c_custkey")
    rows = customer.withColumn("part", part).select(
        "part", F.col("c_custkey").alias("pos"),
        F.when(swapped, F.concat_ws(";", code, pop, "c_name")).otherwise(F.concat_ws(";", code, "c_name", pop)).alias("value"),
    )
    preamble = F.array(
        F.lit("Rifiuti urbani;;"), F.lit("1;anno;2024"),
        F.when(swapped, F.lit("IstatComune; Popolazione;Comune")).otherwise(F.lit("IstatComune;Comune; Popolazione")),
    )
    top = customer.select(part).distinct().select(
        "part", F.posexplode(preamble).alias("i", "value")
    ).select("part", (F.col("i") - 3).cast("bigint").alias("pos"), "value")
    (
        rows.unionByName(top).repartition("part").sortWithinPartitions("part", "pos")
        .select("part", "value").write.partitionBy("part").text(folder)
    )
    parsed = B.read_statistics_csv(spark, folder)
    pop = B.resolve_column(parsed.columns, "Popolazione")
    return parsed.select("IstatComune", "Comune", F.col(pop).try_cast("bigint").alias("pop"))


@query("a07_column_lookup", "SELECT c_custkey AS code, c_name AS label, c_acctbal AS amount FROM customer")
def a07(spark: SparkSession, sf: str) -> DataFrame:
    raw = V.table(spark, sf, "customer").select(
        "c_custkey", F.col("c_name").alias(" Nome comune "), F.col("c_acctbal").alias("Totale RU (t) 2024")
    )
    wanted = {"code": ("c_custkey",), "label": ("Nome", "Nome comune"), "amount": ("Totale RU",)}
    return raw.select(*[F.col(f"`{B.resolve_column(raw.columns, *names)}`").alias(a) for a, names in wanted.items()])


@query(
    "a08_per_capita_costs",
    """SELECT CAST(c_custkey AS VARCHAR) AS id, abs(c_acctbal) AS cost FROM customer WHERE c_custkey % 11 <> 0 AND c_acctbal >= 0""",
)
def a08(spark: SparkSession, sf: str) -> DataFrame:
    number = F.translate(F.format_number(F.abs("c_acctbal"), 2), ",.", ".,")
    base = V.table(spark, sf, "customer").select(
        F.concat(F.lit(" "), "c_custkey").alias("key"),
        F.when(F.col("c_custkey") % 11 == 0, F.lit("3")).otherwise(F.lit("1")).alias("places"),
        F.when(F.col("c_acctbal") < 0, F.lit("-")).otherwise(number).alias("text"),
    )
    versions = F.explode(F.array(
        F.struct(F.lit(0).alias("pos"), F.when(F.col("text") != "-", F.lit("1,00")).otherwise(F.lit("-")).alias("t")),
        F.struct(F.lit(1).alias("pos"), F.col("text").alias("t")),
    ))
    rows = base.select("key", "places", versions.alias("v")).select("key", "places", "v.*")
    return B.per_capita_costs(rows, "key", "places", "t", "pos")


@query(
    "a09_record_directory",
    """SELECT c_custkey AS id, c_name AS name, c_acctbal AS rd FROM customer WHERE c_acctbal >= 0
    UNION ALL SELECT c_custkey, c_name, NULL FROM customer WHERE c_acctbal < 0""",
)
def a09(spark: SparkSession, sf: str) -> DataFrame:
    """Records written as partitioned JSON (the sink), read back by key (the scan)."""
    folder = run_folder(spark, "records")
    records = V.table(spark, sf, "customer").select(
        F.col("c_custkey").alias("id"), F.col("c_name").alias("name"),
        F.when(F.col("c_acctbal") >= 0, F.col("c_acctbal")).alias("rd"), F.col("c_mktsegment").alias("segment"),
    )
    B.write_records(records, folder, "segment", "id")
    return B.read_records(spark, folder, "id bigint, name string, rd double", "id")


@query(
    "a10_partitioned_json_sink",
    """SELECT c_mktsegment AS segment, count(*) AS records, CAST(sum(c_custkey) AS BIGINT) AS keys FROM customer GROUP BY 1""",
)
def a10(spark: SparkSession, sf: str) -> DataFrame:
    folder = run_folder(spark, "segments")
    records = V.table(spark, sf, "customer").select(F.col("c_custkey").alias("id"), F.col("c_mktsegment").alias("segment"))
    B.write_records(records, folder, "segment", "id")
    back = spark.read.schema("id bigint, segment string").json(folder)
    return back.groupBy("segment").agg(F.count(F.lit(1)).alias("records"), F.sum("id").alias("keys"))


@query(
    "a11_zone_index",
    f"""WITH {STREET} SELECT comune || '-' || street_id AS comune_id, comune, street, CAST(calendar_id AS VARCHAR) AS calendar FROM street
    UNION ALL SELECT comune || '-' || street_id, comune, street || ' bis', code FROM street""",
)
def a11(spark: SparkSession, sf: str) -> DataFrame:
    def via(name: Column, calendar: Column) -> Column:
        return F.struct(name.alias("name"), calendar.alias("calendar"))

    s = V.street(spark, sf)
    town = F.struct(
        F.concat_ws("-", "comune", "street_id").alias("id"), F.col("comune").alias("name"),
        F.array(
            via(F.col("street"), F.col("calendar_id").cast("string")),
            via(F.concat("street", F.lit(" bis")), F.col("code")),
        ).alias("vie"),
    )
    return B.explode_zone_index(s.select(F.array(town).alias("comuni")))


@query(
    "a12_lite_catalog",
    """SELECT source AS id, CASE WHEN lang = 'en' THEN '' ELSE lang END AS provider, CAST(n_chars AS VARCHAR) AS page FROM documents WHERE source <> 'src1'""",
)
def a12(spark: SparkSession, sf: str) -> DataFrame:
    raw = V.table(spark, sf, "documents").select(
        F.when(F.col("source") != "src1", F.col("source")).alias("id"),
        F.when(F.col("lang") != "en", F.col("lang")).alias("provider"),
        F.col("n_chars").cast("string").alias("page"),
    )
    return B.lite_catalog(raw)


@query(
    "a13_date_matrix",
    f"""WITH {CAL} SELECT DISTINCT 'C' || calendar_id AS calendar_id, date, CAST(6 AS INTEGER) AS bin FROM cal
    WHERE year(date) = 1998""",
)
def a13(spark: SparkSession, sf: str) -> DataFrame:
    days = [(datetime.date(1998, 1, 1) + datetime.timedelta(days=d)).isoformat() for d in range(365)]
    # the days of a year are few: one set a calendar instead of 365 running maxima
    marked = V.cal(spark, sf).groupBy("calendar_id").agg(F.collect_set(F.when(F.year("date") == 1998, F.col("date"))).alias("on"))
    marks = [F.when(F.array_contains("on", F.to_date(F.lit(d))), F.lit(" X ")).alias(d) for d in days]
    sheet = marked.select(F.concat(F.lit("C"), "calendar_id").alias("zona"), *marks)
    return B.unpivot_date_matrix(sheet, "zona", 6)


@query(
    "a14_street_codes",
    """SELECT DISTINCT p_name AS street, unnest(['A' || p_size, upper(p_name[1]) || (p_size % 10) || 'B']) AS code FROM part""",
)
def a14(spark: SparkSession, sf: str) -> DataFrame:
    cell = F.concat(F.lit("a"), "p_size", F.lit(" / "), F.left("p_name", F.lit(1)), F.col("p_size") % 10, F.lit("b; zona"))
    sheet = V.table(spark, sf, "part").select(F.concat(F.lit(" "), "p_name").alias("street"), cell.alias("zona"))
    return B.split_street_codes(sheet, "street", "zona")


@query(
    "a15_header_metadata",
    """WITH x AS (SELECT doc_id, source, CASE doc_id % 3 WHEN 0 THEN '// Torino Zona ' || source || ' (' || lang || '): ' WHEN 1 THEN '// torino ' || source || ' (' ELSE '// (' END AS h FROM documents)
    SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN 'Zona ' || source WHEN 1 THEN source ELSE source || '-slug' END AS zone_label FROM x""",
)
def a15(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("doc_id") % 3
    head = (
        F.when(k == 0, F.concat(F.lit("// Torino Zona "), "source", F.lit(" ("), "lang", F.lit("): ")))
        .when(k == 1, F.concat(F.lit("// torino "), "source", F.lit(" (")))
        .otherwise(F.lit("// ("))
    )
    texts = V.table(spark, sf, "documents").select(
        "doc_id", F.concat(head, F.lit(")\n"), "text").alias("value"), F.lit("Torino").alias("place"),
        F.concat("source", F.lit("-slug")).alias("slug"),
    )
    return S.header_metadata(texts, "value", "place", "slug").select("doc_id", "zone_label")


# --- pages --------------------------------------------------------------------------

LINKS = r"""lk0 AS (SELECT page_id, url, unnest(range(len(regexp_extract_all(html, '<a\b[^>]*\bhref="([^"]+)"[^>]*>(.*?)</a>', 1, 'is')))) AS pos,
    unnest(regexp_extract_all(html, '<a\b[^>]*\bhref="([^"]+)"[^>]*>(.*?)</a>', 1, 'is')) AS href,
    unnest(regexp_extract_all(html, '<a\b[^>]*\bhref="([^"]+)"[^>]*>(.*?)</a>', 2, 'is')) AS inner_html FROM pages),
lk AS (SELECT page_id, CAST(pos AS INTEGER) AS pos, trim(regexp_replace(replace(inner_html, '&amp;', '&'), '\s+', ' ', 'g')) AS label,
    CASE WHEN starts_with(href, '/') THEN regexp_extract(url, '^(https?://[^/?#]*)', 1) || replace(href, '&amp;', '&') ELSE href END AS link FROM lk0)"""


def page_links(spark: SparkSession, sf: str) -> DataFrame:
    return H.links(V.table(spark, sf, "pages"), "page_id", "url", "html")


@query("b01_links", f"WITH {LINKS} SELECT page_id, pos, label, link FROM lk")
def b01(spark: SparkSession, sf: str) -> DataFrame:
    return page_links(spark, sf)


KINDS = (("the", (("the", "http:"),)), ("der", (("der",), ("des", "https"))), ("any", (("example", "n"),)))


@query(
    "b02_link_kinds",
    f"""WITH {LINKS}, k AS (SELECT *, lower(label || ' ' || link) AS b FROM lk),
    t AS (SELECT *, CASE WHEN contains(b, 'the') AND contains(b, 'http:') THEN 'the' WHEN contains(b, 'der') OR (contains(b, 'des') AND contains(b, 'https')) THEN 'der'
      WHEN contains(b, 'example') AND contains(b, 'n') THEN 'any' END AS kind FROM k)
    SELECT page_id, link, arg_min(kind, pos) AS kind, arg_min(label, pos) AS label FROM t WHERE kind IS NOT NULL GROUP BY 1, 2""",
)
def b02(spark: SparkSession, sf: str) -> DataFrame:
    return H.link_kinds(page_links(spark, sf), "page_id", KINDS)


@query(
    "b03_markup_rows",
    r"""WITH l AS (SELECT page_id, unnest(regexp_extract_all(html, '<li\b[^>]*>(.*?)</li>', 1, 'is')) AS li,
        unnest(range(len(regexp_extract_all(html, '<li\b[^>]*>(.*?)</li>', 1, 'is')))) AS i FROM pages),
    c AS (SELECT page_id, i, trim(regexp_replace(replace(regexp_extract(li, '<a\b[^>]*>(.*?)</a>', 1, 'is'), '&amp;', '&'), '\s+', ' ', 'g')) AS cells FROM l)
    SELECT page_id, CAST(0 AS INTEGER) AS table_no, CAST(row_number() OVER (PARTITION BY page_id ORDER BY i) - 1 AS INTEGER) AS row_no, cells FROM c WHERE cells <> ''""",
)
def b03(spark: SparkSession, sf: str) -> DataFrame:
    rows = H.table_cells(V.table(spark, sf, "pages"), "page_id", "html", "ul", "li", "a")
    return rows.withColumn("cells", F.array_join("cells", " | "))


@query(
    "b03_table_rows",
    """SELECT p_partkey AS page, CAST(0 AS INTEGER) AS table_no, CAST(0 AS INTEGER) AS row_no, 'Zona | Marca' AS cells FROM part
    UNION ALL SELECT p_partkey, 0, 1, p_name || ' | ' || p_brand FROM part UNION ALL SELECT p_partkey, 1, 0, p_type FROM part""",
)
def b03_tables(spark: SparkSession, sf: str) -> DataFrame:
    doc = F.concat(
        F.lit("<table class='x'><tr><th>Zona</th><th> Marca </th></tr><tr><td></td><td> </td></tr><tr><td><b>"), "p_name",
        F.lit("</b></td>\n<td>"), "p_brand", F.lit("</td></tr></table><TABLE><TR><TD>"), "p_type", F.lit("</TD></TR></TABLE>"),
    )
    pages = V.table(spark, sf, "part").select(F.col("p_partkey").alias("page"), doc.alias("html"))
    return H.table_cells(pages, "page", "html").withColumn("cells", F.array_join("cells", " | "))


@query(
    "b04_heading_dates",
    """SELECT p_partkey AS page, 'Zona ' || p_brand || ' ' || p_name AS zone, unnest([make_date(2026, 1 + p_partkey % 12, 1 + p_size % 28), DATE '2026-03-05']) AS date FROM part
    WHERE NOT (p_partkey % 12 = 2 AND p_size % 28 = 4) UNION ALL SELECT p_partkey, 'Zona ' || p_brand || ' ' || p_name, DATE '2026-03-05' FROM part WHERE p_partkey % 12 = 2 AND p_size % 28 = 4""",
)
def b04(spark: SparkSession, sf: str) -> DataFrame:
    doc = F.concat(
        F.lit("<script>var a='<h3>no</h3>';</script><h2>Tutto</h2><h3 class=z>Zona "), "p_brand", F.lit(" – "), "p_name",
        F.lit(" — Ogni lunedì</h3><p>Date spazzamento 2026: "), 1 + F.col("p_size") % 28, F.lit("/"), 1 + F.col("p_partkey") % 12,
        F.lit(", 5/03, 31/02 &nbsp;</p><h3>Altra</h3><p>Date spazzamento 2025: 1/1</p><h2>Fine 7/7</h2>"),
    )
    pages = V.table(spark, sf, "part").select(F.col("p_partkey").alias("page"), doc.alias("html"))
    return H.heading_dates(pages, "page", "html", 2026)


@query(
    "b05_wide_month_rows",
    """WITH d AS (SELECT p_partkey AS page, p_size % 4 + 1 AS s, unnest(range(3, 13)) AS m, 1 + p_size % 14 AS a FROM part),
    x AS (SELECT page, s, unnest([make_date(2026, m, a), make_date(2026, m, a + 14)]) AS date FROM d)
    SELECT page, unnest(['SETT ' || s || '-9 (lunedi)', 'SETT ' || s || '-9 lunedi', 'SETT ' || s || ' lunedi', 'SETT 9 lunedi']) AS label, date FROM x""",
)
def b05(spark: SparkSession, sf: str) -> DataFrame:
    a = 1 + F.col("p_size") % 14
    cell = F.concat(a, F.lit("-"), a + 14, F.lit(" "))
    doc = F.concat(
        F.lit("<p>Mesi</p> SETT "), F.col("p_size") % 4 + 1, F.lit("–9 (lunedì) 1 2 "), F.repeat(cell, 10), F.lit("")
    )
    pages = V.table(spark, sf, "part").select(F.col("p_partkey").alias("page"), doc.alias("html"))
    return H.wide_month_rows(pages, "page", "html", 2026)


@query(
    "b06_option_labels",
    r"""WITH a AS (SELECT page_id, unnest(range(len(regexp_extract_all(html, '<a\b([^>]*)>(.*?)</a>', 1, 'is')))) AS pos,
      unnest(regexp_extract_all(html, '<a\b([^>]*)>(.*?)</a>', 1, 'is')) AS attrs, unnest(regexp_extract_all(html, '<a\b([^>]*)>(.*?)</a>', 2, 'is')) AS inner_html FROM pages),
    b AS (SELECT page_id, CAST(pos AS INTEGER) AS pos, trim(regexp_replace(replace(inner_html, '&amp;', '&'), '\s+', ' ', 'g')) AS label, replace(regexp_extract(attrs, 'href="([^"]*)"', 1), '&amp;', '&') AS href FROM a)
    SELECT * FROM b WHERE label NOT IN ('', '-', '–') AND href NOT IN ('', '-', '–')""",
)
def b06(spark: SparkSession, sf: str) -> DataFrame:
    return H.tagged_labels(V.table(spark, sf, "pages"), "page_id", "html", "a", "href")


@query(
    "b06_street_options",
    """SELECT p_partkey AS page, CAST(0 AS INTEGER) AS pos, p_name AS label, p_brand AS zona, CASE WHEN p_size % 2 = 0 THEN 'Settimana ' || p_size END AS settimana FROM part WHERE p_type <> 'PROMO'""",
)
def b06_options(spark: SparkSession, sf: str) -> DataFrame:
    zona = F.when(F.col("p_type") == "PROMO", F.lit("-")).otherwise(F.col("p_brand"))
    sett = F.when(F.col("p_size") % 2 == 0, F.concat(F.lit('" data-settimana="Settimana '), "p_size")).otherwise(F.lit(""))
    other = F.lit('<select name=other><option data-zona="other">Altra via</option></select>')
    doc = F.concat(
        F.when(F.col("p_size") % 3 == 0, other).otherwise(F.lit("")),
        F.when(F.col("p_size") % 3 == 0, F.lit('<select class=s id="vie">')).otherwise(F.lit("<select>")),
        F.lit('<option value=1 data-zona="'), zona, sett, F.lit('"> <b>'), "p_name",
        F.lit('</b></option><option data-zona="x">–</option></select>'), other,
    )
    pages = V.table(spark, sf, "part").select(F.col("p_partkey").alias("page"), doc.alias("html"))
    options = H.first_block(F.col("html"), "select", "vie")
    out = H.tagged_labels(pages, "page", options, "option", "data-zona", ["data-settimana"])
    return out.withColumnsRenamed({"data-zona": "zona", "data-settimana": "settimana"})


@query(
    "b07_weekly_grid",
    """SELECT p_partkey AS page, p_name AS zone, unnest([0, 1, 1, 4])::INTEGER AS weekday, unnest([0, 5, 3, 1])::INTEGER AS bin FROM part WHERE p_size % 2 = 0
    UNION ALL SELECT p_partkey, unnest(['Nord', 'Sud', p_brand]), CAST(p_size % 7 AS INTEGER), unnest([2, 4, 4])::INTEGER FROM part WHERE p_size % 2 = 1""",
)
def b07(spark: SparkSession, sf: str) -> DataFrame:
    day = F.element_at(
        F.array(*[F.lit(d) for d in ("LUNEDÌ", "martedì", "Mercoledì", "giovedì", "venerdì", "sabato", "domenica")]),
        (F.col("p_size") % 7 + 1).cast("int"),
    )

    def row(*cells: Column | str) -> Column:
        return F.array(*[c if isinstance(c, Column) else F.lit(c) for c in cells])

    zones = F.array(
        row("Calendario", "", "", ""), row("Zona", "Lunedì", "Martedì", "Venerdì"),
        row(F.col("p_name"), "Carta", "vetro e plastica", "Umido"), row("Utenze non domestiche", "Carta", "Carta", "Carta"),
    )
    days = F.array(
        row("Giorno", "Nord", "Sud", F.col("p_brand")), row(day, "secco", "sfalci", "verde"), row("nota", "carta", "carta", "carta")
    )
    tables = V.table(spark, sf, "part").select(
        F.col("p_partkey").alias("page"), F.when(F.col("p_size") % 2 == 0, zones).otherwise(days).alias("rows")
    )
    return H.weekly_grid(tables, "page", "rows")


WORDS = ((0, "the|les"), (1, "und"), (2, "que|ción"), (3, "xyzzy"), (5, "ing"))


@query(
    "b08_bin_words",
    """WITH x AS (SELECT doc_id, lower(text) AS t FROM documents)
    SELECT doc_id, CASE WHEN contains(t, 'password') THEN '' ELSE array_to_string(list_filter([CASE WHEN regexp_matches(t, 'the|les') THEN 0 END, CASE WHEN regexp_matches(t, 'und') THEN 1 END,
      CASE WHEN regexp_matches(t, 'que|ción') THEN 2 END, CASE WHEN regexp_matches(t, 'ing') THEN 5 END], lambda v: v IS NOT NULL), ',') END AS bins FROM x""",
)
def b08(spark: SparkSession, sf: str) -> DataFrame:
    bins = H.bin_words(F.col("text"), WORDS, ("password",))
    return V.table(spark, sf, "documents").select(
        "doc_id", F.array_join(bins.cast("array<string>"), ",").alias("bins")
    )


@query("b09_facet_options", "SELECT DISTINCT lower(n_name) || ' ' || s_suppkey % 7 AS label, CAST(n_nationkey AS BIGINT) AS id FROM supplier JOIN nation ON s_nationkey = n_nationkey")
def b09(spark: SparkSession, sf: str) -> DataFrame:
    doc = F.concat(
        F.lit('<a data-drupal-facet-item-value="'), "n_nationkey", F.lit('" href="#"><i></i>\n<span class="facet-item__value"> Comune di  '),
        "n_name", F.lit("  "), F.col("s_suppkey") % 7, F.lit(" </span></a>"),
    )
    nation = V.table(spark, sf, "nation")
    pages = V.table(spark, sf, "supplier").join(
        F.broadcast(nation), F.col("s_nationkey") == F.col("n_nationkey")
    ).select(doc.alias("html"))
    return H.facet_options(pages, "html", "data-drupal-facet-item-value", "Comune di")


@query(
    "b09_facet_values",
    r"""SELECT DISTINCT regexp_extract(url, '^https?://([^/?#]*)', 1) || ' & Co' AS value FROM pages""",
)
def b09_values(spark: SparkSession, sf: str) -> DataFrame:
    host = F.regexp_extract("url", r"^https?://([^/?#]*)", 1)
    link = F.concat(F.lit('<a href="?f=vie_piazze_localita%3A'), F.url_encode(F.concat(host, F.lit(" & Co"))), F.lit('">x</a>'))
    pages = V.table(spark, sf, "pages").select(link.alias("html"))
    return H.facet_values(pages, "html", "vie_piazze_localita")


@query(
    "b10_file_metadata",
    r"""WITH x AS (SELECT page_id, regexp_extract(url, '^https?://([^/?#.]*)', 1) AS h FROM pages)
    SELECT page_id, h || CASE WHEN page_id % 2 = 0 THEN '-alta' ELSE '' END AS comune_id,
      CASE WHEN page_id % 2 = 0 THEN 'z' || page_id || '-nord' WHEN page_id % 2 = 1 THEN 'z1' END AS zone_slug,
      CASE WHEN page_id % 2 = 0 THEN 'Zona ' || page_id || '-Nord' WHEN page_id % 4 = 1 THEN 'Zona unica' ELSE 'Centro' END AS zone_label FROM x""",
)
def b10(spark: SparkSession, sf: str) -> DataFrame:
    host = F.regexp_extract("url", r"^https?://([^/?#.]*)", 1)
    name = F.when(
        F.col("page_id") % 2 == 0,
        F.concat(F.lit("Calendario%20Rifiuti%202026%20"), host, F.lit("%20Alta%20ZONA%20"), "page_id", F.lit("-Nord_2.pdf?v=1")),
    ).otherwise(F.concat(host, F.lit(".PDF")))
    files = V.table(spark, sf, "pages").select(
        "page_id", F.concat(F.lit("https://x.example/docs/"), name).alias("url"),
        F.when(F.col("page_id") % 4 == 1, F.lit("ZONA 1")).otherwise(F.lit("Centro")).alias("label"),
    )
    return H.file_metadata(files, "url", "label").select("page_id", "comune_id", "zone_slug", "zone_label")


@query(
    "b11_address_lines",
    r"""WITH l AS (SELECT doc_id, unnest(range(len(string_split(text, chr(10))))) AS pos, trim(regexp_replace(unnest(string_split(text, chr(10))), '\s+', ' ', 'g')) AS line FROM documents)
    SELECT doc_id, line, CAST(min(pos) AS INTEGER) AS pos FROM l WHERE regexp_matches(line, '^(The |La |Les |De |Und |Que )') GROUP BY 1, 2""",
)
def b11(spark: SparkSession, sf: str) -> DataFrame:
    texts = V.table(spark, sf, "documents").select("doc_id", "text")
    return H.address_lines(texts, "doc_id", "text", ("The ", "La ", "Les ", "De ", "Und ", "Que "))


@query(
    "b12_tagged_rows",
    """WITH l AS (SELECT conv_id, turn, role, md5(text) AS line, CASE WHEN turn % 4 = 0 THEN 'Z' || length(text) % 5 END AS tag FROM conversations),
    t AS (SELECT *, arg_max(tag, turn) FILTER (tag IS NOT NULL) OVER (PARTITION BY conv_id ORDER BY turn) AS zone FROM l),
    g AS (SELECT *, sum(CASE WHEN role = 'assistant' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn) AS row_no FROM t WHERE tag IS NULL AND zone IS NOT NULL)
    SELECT conv_id, CAST(row_no AS BIGINT) AS row_no, arg_min(zone, turn) AS zone, string_agg(line, ', ' ORDER BY turn) AS text FROM g WHERE row_no > 0 GROUP BY 1, 2""",
)
def b12(spark: SparkSession, sf: str) -> DataFrame:
    lines = V.table(spark, sf, "conversations").select(
        "conv_id", "turn", "role", F.length("text").alias("size"), F.md5("text").alias("line")
    )
    tag = F.when(F.col("turn") % 4 == 0, F.concat(F.lit("Z"), F.col("size") % 5))
    parts = H.tagged_rows(lines, "conv_id", "turn", "line", tag, F.col("role") == "assistant", bucket=2)
    return H.whole_rows(parts, "conv_id")


def sweep_cells(spark: SparkSession, sf: str) -> DataFrame:
    """A table per order: header and body cells in an order that depends on the key."""
    turn = F.col("table") % 3

    def rotated(a: Column, b: Column, c: Column) -> Column:
        return F.when(turn == 0, F.array(a, b, c)).when(turn == 1, F.array(c, a, b)).otherwise(F.array(b, c, a))

    head = V.table(spark, sf, "orders").select(F.col("o_orderkey").alias("table")).select(
        "table", F.lit(0).alias("row_no"),
        rotated(F.lit("Codice zona"), F.lit("Toponimo"), F.lit("Giorno di pulizia")).alias("cells"),
    )
    day = F.when(F.col("l_returnflag") == "R", F.lit("da definire")).otherwise(F.concat(F.lit("lunedì "), "l_linestatus"))
    zone = F.when(F.col("l_suppkey") % 2 == 0, F.concat(F.lit(" S"), "l_suppkey")).otherwise(F.lit(""))
    body = V.table(spark, sf, "lineitem").withColumn("table", F.col("l_orderkey")).select(
        "table", F.col("l_linenumber").alias("row_no"),
        rotated(zone, F.concat(F.lit("Via P."), "l_partkey"), day).alias("cells"),
    )
    return head.unionByName(body)


SWEEP = """b AS (SELECT CASE WHEN l_suppkey % 2 = 0 THEN 'manuale:S' || l_suppkey ELSE 'manuale:rule:LUNEDI ' || l_linestatus END AS code,
  'lunedì ' || l_linestatus AS day, l_partkey FROM lineitem WHERE l_returnflag <> 'R')"""


@query("b13_sweep_rules", f"WITH {SWEEP} SELECT DISTINCT code, day FROM b")
def b13_rules(spark: SparkSession, sf: str) -> DataFrame:
    return H.sweep_tables(sweep_cells(spark, sf), "table", "manuale")[0]


@query("b13_sweep_streets", f"WITH {SWEEP} SELECT DISTINCT unnest(['P' || l_partkey, 'VIA P.' || l_partkey]) AS street, code FROM b")
def b13_streets(spark: SparkSession, sf: str) -> DataFrame:
    return H.sweep_tables(sweep_cells(spark, sf), "table", "manuale")[1]
