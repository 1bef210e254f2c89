"""Calendar text files: scan, path metadata, active years and the sink."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from calendra.operators.calendars import bin_text

# One entry of a calendar file, and the year suffix of its name.
ENTRY = r"\{\s*(\d{4})\s*,\s*(\d{1,2})\s*,\s*(\d{1,2})\s*,\s*(-?\d+)\s*\}"
YEAR_SUFFIX = r"(?i)-(\d{4})\.h$"
LINE = "  {%d, %d, %d, %d},  // %02d/%02d/%d %s"


def calendar_base(path: Column) -> Column:
    return F.regexp_replace(F.trim(path), YEAR_SUFFIX, "")


def calendar_year(path: Column) -> Column:
    return F.nullif(F.regexp_extract(path, YEAR_SUFFIX, 1), F.lit("")).cast("int")


def parse_entries(texts: DataFrame, text: str = "value") -> DataFrame:
    """Every ``{y, m, d, b}`` of a text as year, date and bin; impossible dates are null."""
    groups = [F.regexp_extract_all(text, F.lit(ENTRY), F.lit(i)) for i in (1, 2, 3, 4)]
    zipped = F.arrays_zip(*[g.alias(n) for g, n in zip(groups, ("y", "m", "d", "b"))])
    iso = F.concat_ws("-", F.col("e.y"), F.lpad("e.m", 2, "0"), F.lpad("e.d", 2, "0"))
    rest = [c for c in texts.columns if c != text]
    return texts.select(*rest, F.explode(zipped).alias("e")).select(
        *rest,
        F.col("e.y").cast("int").alias("year"),
        F.try_to_date(iso, "yyyy-MM-dd").alias("date"),
        F.col("e.b").cast("int").alias("bin"),
    )


def scan(spark: SparkSession, path: str) -> DataFrame:
    """Calendar files below a path as calendar_id, year, date and bin.

    Files hold one zone and year each, so whole-file rows stay small; years can be pruned
    by the file name before a file is parsed.
    """
    name = F.col("_metadata.file_name")
    files = spark.read.option("recursiveFileLookup", "true").text(path, wholetext=True)
    tagged = files.select(calendar_base(name).alias("calendar_id"), calendar_year(name).alias("file_year"), "value")
    return parse_entries(tagged).where("file_year IS NULL OR file_year = year").drop("file_year")


def latest_years(cal: DataFrame, this_year: int) -> DataFrame:
    """The two latest years after 2000, or this and the next year where none occurs."""
    years = cal.select(F.year("date").alias("year")).where("year > 2000").distinct()
    top = years.orderBy(F.col("year").desc()).limit(2)
    default = cal.sparkSession.createDataFrame([(this_year,), (this_year + 1,)], "year int")
    some = top.agg(F.count(F.lit(1)).alias("n"))
    return top.unionByName(default.where(some.scalar() == 0))


def merge_years(parts: list[DataFrame], years: DataFrame) -> DataFrame:
    """Distinct entries of several year tables, limited to the given (at most two) years."""
    merged = parts[0]
    for part in parts[1:]:
        merged = merged.unionByName(part)
    keep = merged.withColumn("year", F.year("date")).join(F.broadcast(years), "year", "left_semi")
    return keep.distinct()


def format_lines(cal: DataFrame) -> DataFrame:
    """One data line per entry, with the date and the bin's name as a comment."""
    y, m, d, b = F.year("date"), F.month("date"), F.dayofmonth("date"), F.col("bin")
    name = F.when(b.between(0, 6), bin_text(b, 2)).otherwise(F.concat(F.lit("bin"), b))
    return cal.select(
        "calendar_id", y.alias("year"), "date", "bin",
        F.format_string(LINE, y, m, d, b, d, m, y, name).alias("line"),
    )


def write(cal: DataFrame, path: str) -> None:
    """Sorted text files partitioned by calendar and year; a very large one is split by date."""
    (
        format_lines(cal)
        .repartitionByRange("calendar_id", "year", "date", "bin")
        .sortWithinPartitions("calendar_id", "year", "date", "bin")
        .select("calendar_id", "year", F.col("line").alias("value"))
        .write.mode("errorifexists")
        .partitionBy("calendar_id", "year")
        .text(path)
    )


def header_metadata(texts: DataFrame, text: str, place: str, slug: str) -> DataFrame:
    """Zone label from the first line: «Zona …», else the text before a bracket, else the slug."""
    first = F.substring_index(text, "\n", 1)
    zone = F.nullif(F.trim(F.regexp_extract(first, r"(?i)(Zona\s+[^(]+)", 1)), F.lit(""))
    plain = F.trim(F.replace(F.substring_index(first, "(", 1), F.lit("//"), F.lit("")))
    prefix = F.concat(F.col(place), F.lit(" "))
    has_prefix = F.lower(F.left(plain, F.length(prefix))) == F.lower(prefix)
    rest = F.when(has_prefix, F.ltrim(F.substring(plain, F.length(prefix) + 1, F.length(plain)))).otherwise(plain)
    provider = F.nullif(F.regexp_extract(first, r"\(([^)]+)\)", 1), F.lit(""))
    return texts.withColumn(
        "zone_label", F.coalesce(zone, F.nullif(rest, F.lit("")), F.col(slug))
    ).withColumn("provider", provider)
