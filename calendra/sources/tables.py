"""Statistics files, record directories, zone index and sheet tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from calendra.functions.numbers import parse_italian_number, round_to

# The text that marks a header row, accepted cell marks and zone codes.
HEADER_MARK = "IstatComune"
MARKS = ("x", "1", "sì", "si", "true")
ZONE_CODE = r"[A-Z]\d{1,3}[A-Z]?"


def resolve_column(columns: list[str], *names: str) -> str | None:
    """Column by exact name, then trimmed name, then substring; the first name wins."""
    for name in names:
        if name in columns:
            return name
        for c in columns:
            if c.strip() == name:
                return c
    for name in names:
        for c in columns:
            if name in c:
                return c
    return None


def read_statistics_csv(spark: SparkSession, path: str, header_mark: str = HEADER_MARK) -> DataFrame:
    """``;``-separated text with a preamble; all columns STRING, tabs stripped.

    A row counts when it lies after its file's header row, judged by the block offset of
    the split and the row's position in it, so large files can be split. Every file is read by
    its own header: columns may stand in another order or be missing (null). Only the
    distinct header lines reach the driver; a file without one is an error.
    """
    lines = spark.read.text(path).select(
        F.col("_metadata.file_path").alias("file"),
        F.struct(
            F.col("_metadata.file_block_start").alias("block"),
            F.monotonically_increasing_id().alias("row"),
        ).alias("at"),
        "value",
    )
    heads = (
        lines.where(F.contains("value", F.lit(header_mark)))
        .groupBy("file")
        .agg(F.min(F.struct("at", "value")).alias("head"))
    )
    bare = lines.select("file").distinct().join(heads, "file", "left_anti").first()
    layouts = [row[0] for row in heads.select("head.value").distinct().collect()]
    if bare is not None or not layouts:
        raise ValueError(f"no header row with {header_mark!r} in {bare[0] if bare else path}")
    headers = {line: [h.strip('"') for h in line.lstrip("﻿").split(";")] for line in sorted(layouts)}
    names = list(dict.fromkeys(n for header in headers.values() for n in header))
    rows = lines.join(heads, "file").where((F.col("at") > F.col("head.at")) & (F.trim("value") != ""))
    wide = ", ".join(f"c{i} string" for i in range(max(map(len, headers.values()))))
    parsed = rows.select("file", F.col("head.value").alias("header"), F.from_csv("value", wide, {"sep": ";"}).alias("r"))

    def column(name: str) -> Column:
        places = [(line, header.index(name)) for line, header in headers.items() if name in header]
        found = F.coalesce(*[F.when(F.col("header") == line, F.col(f"r.c{i}")) for line, i in places])
        return F.trim(F.regexp_replace(found, "^\t+", "")).alias(name)

    return parsed.select("file", *[column(n) for n in names])


def per_capita_costs(rows: DataFrame, key: str, places: str, cost: str, pos: str) -> DataFrame:
    """Key to cost, two decimals; rows of several places and empty costs skipped; last wins."""
    value = round_to(parse_italian_number(cost), 2)
    single = F.trim(places).isin("", "1") | F.col(places).isNull()
    usable = rows.where(single & (F.trim(key) != "")).select(
        F.trim(key).alias("id"), value.alias("cost"), F.col(pos).alias("_pos")
    ).where("cost IS NOT NULL")
    return usable.groupBy("id").agg(F.max_by("cost", "_pos").alias("cost"))


def read_records(spark: SparkSession, path: str, schema: str, key: str) -> DataFrame:
    """Directory of JSON records with an explicit schema; one record per non-empty key."""
    rows = (
        spark.read.schema(schema)
        .option("recursiveFileLookup", "true")
        .json(path)
        .where(F.trim(F.coalesce(F.col(key).cast("string"), F.lit(""))) != "")
    )
    rest = [c for c in rows.columns if c != key]
    return rows.groupBy(key).agg(F.max(F.struct(*rest)).alias("r")).select(key, "r.*")


def write_records(records: DataFrame, path: str, partition: str, key: str) -> None:
    """JSON lines partitioned by area; null fields are left out.

    Ranges of (area, key) keep the files few and split a large area over several tasks.
    """
    records.repartitionByRange(partition, key).write.partitionBy(partition).json(path)


def explode_zone_index(index: DataFrame) -> DataFrame:
    """Nested municipality → streets → calendar to flat rows."""
    towns = index.select(F.explode("comuni").alias("c"))
    return towns.select(
        F.col("c.id").alias("comune_id"), F.col("c.name").alias("comune"), F.explode("c.vie").alias("v")
    ).select("comune_id", "comune", F.col("v.name").alias("street"), F.col("v.calendar").alias("calendar"))


def lite_catalog(catalog: DataFrame) -> DataFrame:
    """Id, provider and page with blanks for nulls; rows without id dropped."""

    def text(c: str) -> Column:
        return F.coalesce(F.col(c), F.lit(""))

    return catalog.where(F.trim(text("id")) != "").select(
        "id", text("provider").alias("provider"), text("page").alias("page")
    )


def unpivot_date_matrix(sheet: DataFrame, zone: str, bin_no: int) -> DataFrame:
    """Zone rows × ISO-date columns with marks to (calendar_id, date, bin)."""
    dates = [c for c in sheet.columns if c[:4].isdigit() and c[4:5] == "-"]
    cells = sheet.unpivot([zone], dates, "day", "mark")
    wanted = F.lower(F.trim(F.col("mark"))).isin(*MARKS)
    is_zone = F.col(zone).isNotNull() & ~F.upper(F.trim(F.col(zone))).isin("ZONA", "ZONE")
    return cells.where(wanted & is_zone).select(
        F.trim(F.col(zone)).alias("calendar_id"),
        F.try_to_date(F.left("day", F.lit(10)), "yyyy-MM-dd").alias("date"),
        F.lit(bin_no).alias("bin"),
    )


def split_street_codes(sheet: DataFrame, street: str, zone: str) -> DataFrame:
    """Multi-code cells to distinct (street, code)."""
    codes = F.regexp_extract_all(F.upper(F.col(zone)), F.lit(ZONE_CODE), F.lit(0))
    return sheet.where(F.trim(street) != "").select(
        F.trim(street).alias("street"), F.explode(codes).alias("code")
    ).distinct()
