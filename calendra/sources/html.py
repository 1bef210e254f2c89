"""Page text to rows: links, tables, headings, options, labels and address lines.

Every parser is a per-row expression over a text column followed by explode; pages are
never gathered.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from calendra.functions import rules as R
from calendra.functions.grams import NO_TEXTS
from calendra.functions.lineage import spread
from calendra.functions.text import collapse, fold_street, slug_ascii, strip_accents, title_name
from calendra.operators.scans import carry_last, running_sum

# An anchor with its address and content.
LINK = r"""(?is)<a\b[^>]*\bhref=["']([^"']+)["'][^>]*>(.*?)</a>"""

# Common entities, category words, blocking words and street prefixes.
ENTITIES = (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"),
            ("&rsquo;", "’"), ("&egrave;", "è"), ("&eacute;", "é"), ("&agrave;", "à"),
            ("&ograve;", "ò"), ("&ugrave;", "ù"), ("&igrave;", "ì"), ("&amp;", "&"))
BIN_WORDS = ((0, "carta"), (1, "organico|umido"), (2, "indifferenziat|secco"), (3, "plastica"),
             (4, "sfalc|verde|potatur"), (5, "vetro|lattine"))
BLOCK_WORDS = ("tagliando", "sacchi", "fornitura", "modalita' di ritiro", "modalita di ritiro",
               "sapevi", "tonnellata", "bottiglia", "riciclare")
ADDRESS_PREFIXES = ("VIA ", "VIALE ", "VICOLO ", "CORSO ", "PIAZZA ", "STRADA ", "LARGO ",
                    "BORGATA ", "CASCINA ", "FRAZIONE ", "LOCALITA ")
LINK_KINDS = (
    ("manuale", (("spazzamento", "manual", "stradario"),)),
    ("meccanizzato", (("spazzamento", "meccanizz", "stradario"),)),
    ("mercati", (("pulizia", "mercat"),)),
    ("zone_elenco", (("elenco vie",), ("/images/zone/", ".pdf"))),
)
ZONE_HEADERS = ("zona", "utenze non domestiche", "giorno")


def unescape(c: Column) -> Column:
    for entity, char in ENTITIES:
        c = F.replace(c, F.lit(entity), F.lit(char))
    return c


def plain(c: Column) -> Column:
    """Tags to spaces, entities decoded, whitespace collapsed."""
    return collapse(unescape(F.regexp_replace(c, r"(?s)<[^>]+>", " ")))


def groups(text: Column, pattern: str, *names: str) -> Column:
    """All matches of a pattern as an array of structs with its capture groups."""
    found = [
        F.regexp_extract_all(text, F.lit(pattern), F.lit(i)).alias(n) for i, n in enumerate(names, 1)
    ]
    return F.arrays_zip(*found)


def _normal_path(path: Column) -> Column:
    start = F.expr(NO_TEXTS)

    def step(done: Column, part: Column) -> Column:
        return (
            F.when(part == ".", done)
            .when(part == "..", F.slice(done, F.lit(1), F.greatest(F.size(done) - 1, F.lit(1))))
            .otherwise(F.concat(done, F.array(part)))
        )

    dotted = path.rlike(r"/\.\.?(/|$)")
    return F.when(dotted, F.array_join(F.aggregate(F.split(path, "/"), start, step), "/")).otherwise(path)


def resolve_url(base: Column, href: Column) -> Column:
    """Absolute form of a link on a page."""
    page = F.regexp_replace(base, r"#.*$", "")
    bare = F.regexp_replace(page, r"\?.*$", "")
    origin = F.regexp_extract(base, r"^([a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*)", 1)
    scheme = F.regexp_extract(base, r"^([a-zA-Z][a-zA-Z0-9+.-]*:)", 1)
    path = F.substring(bare, F.length(origin) + 1, F.length(bare))
    folder = F.coalesce(F.nullif(F.regexp_extract(path, r"^(.*/)", 1), F.lit("")), F.lit("/"))
    return (
        F.when(href.rlike(r"^[a-zA-Z][a-zA-Z0-9+.-]*:"), href)
        .when(href.startswith("//"), F.concat(scheme, href))
        .when(href.startswith("/"), F.concat(origin, _normal_path(href)))
        .when(href.startswith("#"), F.concat(page, href))
        .when(href.startswith("?"), F.concat(bare, href))
        .otherwise(F.concat(origin, _normal_path(F.concat(folder, href))))
    )


def links(pages: DataFrame, page: str, url: str, html: str, extension: str | None = None) -> DataFrame:
    """(page, pos, label, url) of every anchor, optionally only of one file extension."""
    out = pages.select(page, F.col(url).alias("_base"), F.posexplode(groups(F.col(html), LINK, "href", "inner")).alias("pos", "a"))
    if extension:
        out = out.where(F.col("a.href").rlike(rf"(?i)\.{extension}(\?[^\"']*)?$"))
    return out.select(
        page, "pos", plain(F.col("a.inner")).alias("label"),
        resolve_url(F.col("_base"), unescape(F.col("a.href"))).alias("link"),
    )


def keyword_kind(blob: Column, kinds=LINK_KINDS) -> Column:
    """First kind of which one word group is completely contained in the text."""
    out = F.lit(None).cast("string")
    for kind, options in reversed(list(kinds)):
        hit = F.lit(False)
        for words in options:
            every = F.lit(True)
            for w in words:
                every = every & F.contains(blob, F.lit(w))
            hit = hit | every
        out = F.when(hit, F.lit(kind)).otherwise(out)
    return out


def link_kinds(found: DataFrame, page: str, kinds=LINK_KINDS) -> DataFrame:
    """Classified links, the first of each url per page; links of no kind are dropped."""
    blob = F.lower(F.concat_ws(" ", "label", "link"))
    tagged = found.withColumn("kind", keyword_kind(blob, kinds)).where("kind IS NOT NULL")
    first = F.min(F.struct("pos", "kind", "label"))
    return tagged.groupBy(page, "link").agg(first.alias("f")).select(page, "link", "f.kind", "f.label")


def markup_rows(html: Column, table: str, row: str, cell: str) -> Column:
    """Cleaned cells of every row of every table: array of array of array of text."""

    def blocks(text: Column, tag: str) -> Column:
        return F.regexp_extract_all(text, F.lit(rf"(?is)<(?:{tag})\b[^>]*>(.*?)</(?:{tag})>"), F.lit(1))

    def cells(r: Column) -> Column:
        return F.transform(blocks(r, cell), plain)

    def rows(t: Column) -> Column:
        filled = F.transform(blocks(t, row), cells)
        return F.filter(filled, lambda r: F.exists(r, lambda c: c != ""))

    return F.transform(blocks(html, table), rows)


def table_cells(pages: DataFrame, page: str, html: str, table="table", row="tr", cell="td|th") -> DataFrame:
    """(page, table_no, row_no, cells) without empty rows."""
    tables = pages.select(page, F.posexplode(markup_rows(F.col(html), table, row, cell)).alias("table_no", "rows"))
    return tables.select(page, "table_no", F.posexplode("rows").alias("row_no", "cells"))


# Dashes in headings, weekday words and the words before the dates.
DASH = r"\s*[—–\-]\s*"
WORKDAY = r"(luned\S*|marted\S*|mercoled\S*|gioved\S*|venerd\S*|sabato)"
DATES_OF = r"Date spazzamento\s*"


def heading_dates(
    pages: DataFrame, page: str, html: str, year: int, longest_zone: int | None = None,
) -> DataFrame:
    """(page, zone, date): ``dd/mm`` dates of the year listed in the body of an h3 heading.

    Frequency and weekday behind the last dash of a heading are not part of the zone. With
    ``longest_zone``, longer headings are taken for prose and left out.
    """
    clean = F.regexp_replace(F.col(html), r"(?is)<(script|style)\b.*?</\1>", " ")
    pieces = F.split(clean, r"(?i)<h3\b[^>]*>")
    blocks = F.slice(pieces, F.lit(2), F.size(pieces))
    parts = pages.select(page, F.explode(blocks).alias("b")).select(
        page,
        plain(F.substring_index(F.regexp_replace("b", "(?i)</h3>", "</h3>"), "</h3>", 1)).alias("title"),
        plain(F.regexp_replace(F.regexp_extract("b", r"(?is)</h3>(.*)$", 1), r"(?is)<h2.*$", "")).alias("body"),
    )
    title = F.regexp_replace("title", rf"(?i){DASH}Ogni\b.*$", "")
    title = F.regexp_replace(title, rf"(?i){DASH}{WORKDAY}\s*$", "")
    zone = collapse(F.regexp_replace(title, DASH, " "))
    listed = F.regexp_extract("body", rf"(?i){DATES_OF}{year}\s*:\s*(.+)", 1)
    days = groups(listed, r"(\d{1,2})/(\d{1,2})", "dd", "mm")
    iso = F.concat_ws("-", F.lit(str(year)), F.lpad("d.mm", 2, "0"), F.lpad("d.dd", 2, "0"))
    return (
        parts.select(page, zone.alias("zone"), F.explode(days).alias("d"))
        .where((F.col("zone") != "") & (F.lit(longest_zone is None) | (F.length("zone") <= F.lit(longest_zone or 0))))
        .select(page, "zone", F.try_to_date(iso, "yyyy-MM-dd").alias("date"))
        .where("date IS NOT NULL")
        .distinct()
    )


# One row of the wide month table, its first month and its number of months.
WIDE_ROW = (
    r"SETT\s*([0-9][-–0-9]*)\s*\(\s*(\S+)\s*\)\s*((?:\d{1,2}(?:\s*[-–]\s*\d{1,2})?\s*)+?)(?=\s*SETT\s|\s*$)"
)
FIRST_MONTH, MONTHS_SHOWN = 3, 10


def wide_month_rows(pages: DataFrame, page: str, text: str, year: int) -> DataFrame:
    """Rows «SETT n (weekday) cells…» to (page, label, date) with one row per alias.

    The last ten cells are March to December; a cell holds one day or two. Pages are spread
    before their rows are made, so that these are made distinct where they are.
    """
    rows = spread(pages.select(page, text), page).select(page, F.explode(groups(plain(F.col(text)), WIDE_ROW, "sett", "wd", "cells")).alias("r"))
    sett = F.replace(F.col("r.sett"), F.lit("–"), F.lit("-"))
    wd = F.lower(strip_accents(F.col("r.wd")))
    cells = F.regexp_extract_all("r.cells", F.lit(r"\d{1,2}(?:\s*[-–]\s*\d{1,2})?"), F.lit(0))
    last = F.slice(cells, F.greatest(F.size(cells) - MONTHS_SHOWN + 1, F.lit(1)), F.lit(MONTHS_SHOWN))
    numbers = F.array_union(F.array(sett), F.split(sett, "-"))
    aliases = F.array_union(
        F.array(F.concat(F.lit("SETT "), sett, F.lit(" ("), wd, F.lit(")"))),
        F.transform(numbers, lambda n: F.concat(F.lit("SETT "), n, F.lit(" "), wd)),
    )
    month_cells = rows.select(page, aliases.alias("aliases"), F.posexplode(last).alias("i", "cell"))
    days = F.regexp_extract_all("cell", F.lit(r"\d{1,2}"), F.lit(0))
    iso = F.concat_ws(
        "-", F.lit(str(year)), F.lpad((F.col("i") + FIRST_MONTH).cast("string"), 2, "0"), F.lpad("d", 2, "0")
    )
    return (
        month_cells.select(page, "aliases", "i", F.explode(days).alias("d"))
        .select(page, "aliases", F.try_to_date(iso, "yyyy-MM-dd").alias("date"))
        .where("date IS NOT NULL")
        .select(page, F.explode("aliases").alias("label"), "date")
        .distinct()
    )


def attribute(attrs: Column, name: str) -> Column:
    return unescape(F.trim(F.regexp_extract(attrs, rf"""(?i)\b{name}=["']([^"']*)["']""", 1)))


def first_block(html: Column, tag: str, ident: str) -> Column:
    """Content of the page's first ``tag`` with this id, else of its first ``tag``."""
    named = F.regexp_extract(html, rf"""(?is)<{tag}\b[^>]*\bid=["']{ident}["'][^>]*>(.*?)</{tag}>""", 1)
    first = F.regexp_extract(html, rf"(?is)<{tag}\b[^>]*>(.*?)</{tag}>", 1)
    return F.coalesce(F.nullif(named, F.lit("")), first)


def tagged_labels(
    pages: DataFrame, page: str, html: Column | str, tag: str, required: str, optional: Sequence[str] = (),
) -> DataFrame:
    """(page, pos, label, attributes) of a tag; blank or dash-only labels and values dropped."""
    found = groups(F.col(html) if isinstance(html, str) else html, rf"(?is)<{tag}\b([^>]*)>(.*?)</{tag}>", "attrs", "inner")
    rows = pages.select(page, F.posexplode(found).alias("pos", "o"))
    attrs = F.col("o.attrs")
    out = rows.select(
        page, "pos", plain(F.col("o.inner")).alias("label"), attribute(attrs, required).alias(required),
        *[F.nullif(attribute(attrs, a), F.lit("")).alias(a) for a in optional],
    )
    blank = ("", "-", "–")
    return out.where(~F.col("label").isin(*blank) & ~F.col(required).isin(*blank))


def bin_words(text: Column, words=BIN_WORDS, blocked=BLOCK_WORDS) -> Column:
    """Sorted bins whose words occur; blocking words give none."""
    low = F.lower(text)
    hits = F.array_compact(F.array(*[F.when(low.rlike(w), F.lit(b)) for b, w in words]))
    if not blocked:
        return F.array_sort(F.array_distinct(hits))
    stop = low.rlike("|".join(blocked))
    return F.when(stop, F.expr(R.NO_INTS)).otherwise(F.array_sort(F.array_distinct(hits)))


def weekday_hits(row: Column) -> Column:
    """Per cell the weekday it names (Mon=0) or null."""

    def named(c: Column) -> Column:
        word = F.regexp_extract(R.fold_rule(c), "(" + "|".join(R.WEEKDAYS) + ")", 1)
        return R.stem_position(word, R.WEEKDAYS, 0)

    return F.transform(row, named)


def weekly_grid(tables: DataFrame, page: str, rows: str) -> DataFrame:
    """(page, zone, weekday, bin) of weekly tables in either orientation.

    ``rows`` is one table as an array of cell arrays. Zones × weekdays is taken when some
    row names three weekdays and gives any bin; otherwise weekdays × zones below a row
    whose first cell says «giorno».
    """
    r = F.col(rows)
    no_words: tuple[str, ...] = ()

    def bins(c: Column) -> Column:
        return bin_words(c, blocked=no_words)

    def zone_name(row: Column) -> Column:
        return collapse(F.coalesce(F.try_element_at(row, F.lit(1)), F.lit("")))

    base = spread(tables.select(page, rows), page).select(
        page,
        r.alias("rows"),
        F.array_position(
            F.transform(r, lambda row: F.size(F.filter(weekday_hits(row), lambda d: d.isNotNull())) >= 3), True
        ).alias("ha"),
        F.array_position(
            F.transform(r, lambda row: F.contains(F.lower(F.coalesce(F.try_element_at(row, F.lit(1)), F.lit(""))), F.lit("giorno"))),
            True,
        ).alias("hb"),
    )
    rest, days = F.slice("rows", F.col("ha").cast("int") + 1, F.size("rows")), weekday_hits(F.get("rows", F.col("ha").cast("int") - 1))

    def gives(row: Column) -> Column:
        z = zone_name(row)
        real = (z != "") & ~F.lower(z).isin(*ZONE_HEADERS)
        return real & F.exists(
            F.arrays_zip(row.alias("c"), F.col("days").alias("d")),
            lambda p: p["d"].isNotNull() & (F.size(bins(F.coalesce(p["c"], F.lit("")))) > 0),
        )

    def cells(rows: Column, entry) -> Column:
        return F.flatten(F.transform(rows, lambda row: F.transform(row, lambda cell, i: entry(row, cell, i))))

    def of_zone(row: Column, cell: Column, i: Column) -> Column:
        return F.struct(zone_name(row).alias("zone"), F.get("days", i).alias("weekday"), cell.alias("cell"))

    def of_day(row: Column, cell: Column, i: Column) -> Column:
        named = collapse(F.coalesce(F.get("head", i), F.lit("")))
        # the first column names the days
        zone = F.when((i > 0) & (named != ""), named)
        return F.struct(zone.alias("zone"), row["day"].alias("weekday"), cell.alias("cell"))

    below = F.filter(
        F.transform(
            F.slice("rows", F.col("hb").cast("int") + 1, F.size("rows")),
            lambda row: F.struct(row.alias("row"), F.get(weekday_hits(F.slice(row, 1, 1)), 0).alias("day")),
        ),
        lambda row: row["day"].isNotNull(),
    )
    by_zone = cells(F.col("given"), of_zone)
    by_day = F.flatten(F.transform(below, lambda row: F.transform(row["row"], lambda cell, i: of_day(row, cell, i))))
    # one pass without a filter, which would be met before the tables are spread
    return (
        base.withColumn("days", days)
        .withColumns({"given": F.filter(F.when(F.col("ha") > 0, rest), gives), "head": F.get("rows", F.col("hb").cast("int") - 1)})
        .select(page, F.inline_outer(F.when(F.size("given") > 0, by_zone).when(F.col("hb") > 0, by_day)))
        .where("zone IS NOT NULL AND weekday IS NOT NULL")
        .select(page, "zone", "weekday", F.explode(bins(F.col("cell"))).alias("bin"))
        .distinct()
    )


def facet_options(pages: DataFrame, html: str, attribute_name: str, prefix: str) -> DataFrame:
    """Distinct (label, id) of facet links whose label starts with a prefix."""
    pattern = rf"""(?is){attribute_name}="(\d+)"[^>]*>.*?<span[^>]*>\s*{prefix}\s+([^<]+)"""
    found = pages.select(F.explode(groups(F.col(html), pattern, "id", "label")).alias("f"))
    return found.select(
        F.lower(collapse(F.col("f.label"))).alias("label"), F.col("f.id").cast("bigint").alias("id")
    ).distinct()


def facet_values(pages: DataFrame, html: str, facet: str) -> DataFrame:
    """Distinct decoded values of a facet in the page's links."""
    raw = F.regexp_extract_all(F.col(html), F.lit(rf'{facet}(?:%3A|:)([^"&<]+)'), F.lit(1))
    return pages.select(F.explode(raw).alias("v")).select(F.url_decode("v").alias("value")).distinct()


def file_metadata(files: DataFrame, url: str, label: str, aliases: dict[str, str] | None = None) -> DataFrame:
    """Municipality id and name, zone slug and zone label from a document's url and label."""
    name = F.url_decode(F.substring_index(F.regexp_replace(F.col(url), r"[?#].*$", ""), "/", -1))
    name = F.regexp_replace(name, r"(?i)\.(pdf|html?).*$", "")
    name = F.trim(F.regexp_replace(name, r"(?i)^Calendario\s+\S+\s+\d{4}\s+", ""))
    df = files.withColumn("_n", name)
    zone_raw = F.regexp_replace(F.regexp_extract("_n", r"(?i)\bZONA\s+(.+)$", 1), r"_\d+$", "")
    place = F.trim(F.regexp_replace("_n", r"(?i)\bZONA\s+.+$", ""))
    known = F.lit(None).cast("string")
    if aliases:
        lookup = F.create_map(*[F.lit(x) for pair in aliases.items() for x in pair])
        known = F.try_element_at(lookup, F.upper(place))
    has_zone = zone_raw != ""
    return df.select(
        *files.columns,
        F.coalesce(known, slug_ascii(place)).alias("comune_id"),
        title_name(place).alias("comune"),
        F.when(has_zone, slug_ascii(F.concat(F.lit("z"), F.replace(zone_raw, F.lit(" "), F.lit("")))))
        .otherwise(F.lit("z1")).alias("zone_slug"),
        F.when(has_zone, F.concat(F.lit("Zona "), zone_raw))
        .when(F.lower(label) == "zona 1", F.lit("Zona unica"))
        .otherwise(F.col(label)).alias("zone_label"),
    )


def text_lines(texts: DataFrame, doc: str, text: str) -> DataFrame:
    """(doc, pos, line) of the non-blank lines."""
    lines = texts.select(doc, F.posexplode(F.split(text, "\n")).alias("pos", "line"))
    return lines.withColumn("line", collapse(F.col("line"))).where("line <> ''")


def address_lines(texts: DataFrame, doc: str, text: str, prefixes: Sequence[str] = ADDRESS_PREFIXES) -> DataFrame:
    """Lines that start with a street prefix, each once per text at its first position."""
    hit = F.lit(False)
    for p in prefixes:
        hit = hit | F.col("line").startswith(p)
    return text_lines(texts, doc, text).where(hit).groupBy(doc, "line").agg(F.min("pos").alias("pos"))


def tagged_rows(
    lines: DataFrame, doc: str, pos: str, line: str, tag: Column, is_start: Column, bucket: int = 4096
) -> DataFrame:
    """State scan of lines: each start line with its continuation lines, under the last tag.

    ``tag`` is non-null on tag lines; ``is_start`` marks lines that open a row. Lines before
    the first tag or before the first start of a text are dropped. A row is cut at the borders
    of the buckets: its lines in each are one ``part``, so a row of any length is many rows.
    """
    cut = F.floor(F.col(pos) / bucket)
    marked = lines.withColumn("_tag", tag).withColumn(
        "_start", (is_start & F.col("_tag").isNull()).cast("int")
    )
    zoned = carry_last(marked, [doc], [pos], "_tag", cut, "zone")
    counted = running_sum(zoned.where("_tag IS NULL AND zone IS NOT NULL"), [doc], [pos], {"_start": "row_no"}, cut)
    opened = carry_last(counted.withColumn("_own", F.when(F.col("_start") == 1, F.struct("zone", pos))), [doc], [pos], "_own", cut, "_row")
    texts = F.array_sort(F.collect_list(F.struct(pos, line)))
    return (
        opened.where("row_no > 0")
        .groupBy(doc, "row_no", (cut - F.floor(F.col(f"_row.{pos}") / bucket)).alias("part"))
        .agg(F.min("_row.zone").alias("zone"), F.array_join(F.transform(texts, lambda t: t[line]), ", ").alias("text"))
    )


def whole_rows(parts: DataFrame, doc: str) -> DataFrame:
    """The parts of ``tagged_rows`` put together: one row a start line, with its whole text."""
    texts = F.array_sort(F.collect_list(F.struct("part", "text")))
    return parts.groupBy(doc, "row_no").agg(
        F.min("zone").alias("zone"), F.array_join(F.transform(texts, lambda t: t["text"]), ", ").alias("text")
    )


def header_columns(cells: DataFrame, table: str, wanted: dict[str, Sequence[str]]) -> DataFrame:
    """Per table the 1-based position of the first header cell with any keyword, 0 if none."""

    def position(words: Sequence[str]) -> Column:
        return F.array_position(F.transform("_f", lambda c: c.rlike("|".join(words))), True)

    # tables share a few layouts, so each distinct one is folded once
    heads = cells.where("row_no = 0").select(table, "cells")
    layouts = heads.select("cells").distinct().withColumn("_f", F.transform("cells", R.fold_rule)).select(
        F.col("cells").alias("_cells"), *[position(words).cast("int").alias(f"_{name}") for name, words in wanted.items()]
    )
    return heads.join(layouts, F.col("cells").eqNullSafe(F.col("_cells"))).drop("cells", "_cells")


def project_by_header(cells: DataFrame, table: str, wanted: dict[str, Sequence[str]], required: Sequence[str]) -> DataFrame:
    """Body rows as named columns found by header keywords; undefined and short rows dropped."""
    heads = header_columns(cells, table, wanted)
    for name in required:
        heads = heads.where(F.col(f"_{name}") > 0)

    def cell(name: str) -> Column:
        i = F.col(f"_{name}")
        text = F.when(i > 0, F.try_element_at("cells", F.greatest(i, F.lit(1))))
        return collapse(F.coalesce(text, F.lit(""))).alias(name)

    out = cells.where("row_no > 0").join(heads, table).select(table, "row_no", *[cell(n) for n in wanted])
    for name in required:
        out = out.where((F.col(name) != "") & ~F.contains(F.lower(name), F.lit("definir")))
    return out


SWEEP_COLUMNS = {"zone": ("ZONA", "CODICE"), "street": ("TOPONIMO",), "day": ("GIORNO",)}


def sweep_tables(cells: DataFrame, table: str, kind: str) -> tuple[DataFrame, DataFrame]:
    """Header-detected sweeping tables to (code, day) rules and (street, code) rows."""
    rows = project_by_header(cells, table, SWEEP_COLUMNS, ["street", "day"]).where(F.length("street") >= 3)
    rows = rows.select("zone", "day", "street").distinct()
    # days and streets recur in many rows: each distinct text is folded once (the inner explode
    # would be met by a filter on the folded names before the texts are made distinct)
    days = rows.select(F.col("day").alias("_day")).distinct().withColumn("_rule", R.fold_rule(F.col("_day")))
    code = F.when(F.col("zone") != "", F.concat(F.lit(f"{kind}:"), "zone")).otherwise(F.concat(F.lit(f"{kind}:rule:"), "_rule"))
    coded = rows.join(days, F.col("day") == F.col("_day")).select("street", "day", code.alias("code"))
    names = F.array_distinct(
        F.array(fold_street(F.col("_street")), F.replace(R.fold_rule(F.col("_street")), F.lit("'"), F.lit("")))
    )
    named = rows.select(F.col("street").alias("_street")).distinct().withColumn("_names", names)
    return (
        coded.select("code", "day").distinct(),
        coded.join(named, F.col("street") == F.col("_street")).select(F.explode_outer("_names").alias("street"), "code").distinct(),
    )
