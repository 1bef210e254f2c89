"""Calendar lookups, views, comparison and quality checks.

A calendar table has ``calendar_id``, ``date`` and ``bin``. Nothing here orders or
collects a whole calendar: per-day results gather at most one value per bin.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from calendra.functions.dates import free_street_day
from calendra.functions.numbers import round_to
from calendra.operators.distribution import (
    at_index, distribution, half_even_index, median_agg,
)
from calendra.operators.scans import numbered, previous_row

# Bin numbers with initial and name.
BINS = (
    (0, "C", "Carta"),
    (1, "O", "Organico"),
    (2, "I", "Indifferenziata"),
    (3, "P", "Plastica"),
    (4, "V", "Verde"),
    (5, "G", "Vetro"),
    (6, "S", "Spazzamento"),
)
CORE_BINS = (0, 1, 2, 3, 4, 5)
DEVICE_BINS = (0, 1, 2, 3, 4, 5)
EVENING_FROM, EVENING_TO = 18, 23
DAY_BINS = tuple(b for b, _, _ in BINS)


def bin_text(bin_col: Column, field: int, unknown: str = "?") -> Column:
    out = F.lit(unknown)
    for row in BINS:
        out = F.when(bin_col == row[0], F.lit(row[field])).otherwise(out)
    return out


def bins_per_day(cal: DataFrame, domain: tuple[int, ...] | None = DAY_BINS) -> DataFrame:
    """Distinct bins of each calendar day as a sorted array; only those of ``domain``, if given."""
    return (
        cal.where("bin IS NOT NULL" if domain is None else F.col("bin").isin(*domain))
        .groupBy("calendar_id", "date")
        .agg(F.array_sort(F.collect_set("bin")).alias("bins"))
    )


def bins_on(cal: DataFrame, date: Column, domain: tuple[int, ...] = DAY_BINS) -> DataFrame:
    """Bins of one date; the date filter reaches the scan."""
    return bins_per_day(cal.where(F.col("date") == date), domain).select("calendar_id", "bins")


def pickups_tomorrow(cal: DataFrame, requests: DataFrame) -> DataFrame:
    """Bins on the civil day after each request's ``ref_date``; empty array if none."""
    wanted = requests.withColumn("date", F.date_add("ref_date", 1))
    # The calendar is narrowed to asked days before it is grouped.
    asked = wanted.select("calendar_id", "date").distinct()
    found = bins_per_day(cal.join(asked, ["calendar_id", "date"], "left_semi"))
    none = F.expr("cast(array() as array<int>)")
    return wanted.join(found, ["calendar_id", "date"], "left").withColumn(
        "bins", F.coalesce("bins", none)
    )


def day_labels(cal: DataFrame) -> DataFrame:
    """Initials joined by ``.`` and names by ``, `` per calendar day; ``?`` for unknown bins."""
    return bins_per_day(cal, None).select(
        "calendar_id",
        "date",
        F.array_join(F.transform("bins", lambda b: bin_text(b, 1)), ".").alias("initials"),
        F.array_join(F.transform("bins", lambda b: bin_text(b, 2)), ", ").alias("names"),
    )


def calendar_days(calendars: DataFrame, first: Column, last: Column) -> DataFrame:
    """One row per calendar and day of the span."""
    return calendars.withColumn("date", F.explode(F.sequence(first, last)))


def with_bins(days: DataFrame, cal: DataFrame, first: Column, last: Column) -> DataFrame:
    span = cal.where((F.col("date") >= first) & (F.col("date") <= last))
    none = F.expr("cast(array() as array<int>)")
    return days.join(bins_per_day(span), ["calendar_id", "date"], "left").withColumn(
        "bins", F.coalesce("bins", none)
    )


def month_grid(cal: DataFrame, calendars: DataFrame, year: int, month: int) -> DataFrame:
    """All days of a month with weekday lead, bins (empty days kept) and free-street flag."""
    first = F.make_date(F.lit(year), F.lit(month), F.lit(1))
    last = F.last_day(first)
    return with_bins(calendar_days(calendars, first, last), cal, first, last).select(
        "calendar_id",
        "date",
        F.dayofmonth("date").alias("day"),
        F.weekday(first).alias("lead"),
        ((F.weekday(first) + F.dayofmonth("date") - 1) % 7).alias("grid_col"),
        F.floor((F.weekday(first) + F.dayofmonth("date") - 1) / 7).cast("int").alias("grid_row"),
        "bins",
        free_street_day(F.col("date")).alias("free_street"),
    )


def week_strip(cal: DataFrame, requests: DataFrame) -> DataFrame:
    """Seven days from each request's ``ref_date`` with today and month flags."""
    ref = F.col("ref_date")
    days = calendar_days(requests, ref, F.date_add(ref, 6))
    asked = days.select("calendar_id", "date").distinct()
    found = bins_per_day(cal.join(asked, ["calendar_id", "date"], "left_semi"))
    before = F.date_add("date", -1)
    return days.join(found, ["calendar_id", "date"], "left").select(
        "calendar_id",
        "ref_date",
        "date",
        F.coalesce("bins", F.expr("cast(array() as array<int>)")).alias("bins"),
        (F.col("date") == ref).alias("is_today"),
        (F.trunc("date", "month") != F.trunc(ref, "month")).alias("other_month"),
        ((F.col("date") != ref) & (F.month("date") != F.month(before))).alias("month_start"),
    )


def month_coverage(cal: DataFrame, requests: DataFrame, today: Column) -> DataFrame:
    """State of each requested (calendar, year, month): data, past without data, missing."""
    have = cal.select(
        "calendar_id", F.year("date").alias("year"), F.month("date").alias("month")
    ).distinct().withColumn("has_data", F.lit(True))
    asked = F.col("year") * 12 + F.col("month")
    now = F.year(today) * 12 + F.month(today)
    return requests.join(have, ["calendar_id", "year", "month"], "left").select(
        "calendar_id",
        "year",
        "month",
        F.when(F.col("has_data"), F.lit("data"))
        .when(asked < now, F.lit("past"))
        .otherwise(F.lit("missing"))
        .alias("state"),
    )


def present_categories(cal: DataFrame) -> DataFrame:
    """Core bins always, further known bins only where a calendar has them."""
    core = cal.select("calendar_id").distinct().select(
        "calendar_id", F.explode(F.array(*[F.lit(b) for b in CORE_BINS])).alias("bin")
    )
    extra = cal.where(F.col("bin").isin(*DAY_BINS) & ~F.col("bin").isin(*CORE_BINS))
    both = core.unionByName(extra.select("calendar_id", "bin").distinct())
    return both.withColumn("initial", bin_text(F.col("bin"), 1))


def evening_activation(cal: DataFrame, ticks: DataFrame) -> DataFrame:
    """Whether a device lights up at a tick, and for which bins.

    Ticks carry ``calendar_id`` and civil ``ts``. Lit in the evening hours when tomorrow
    has device bins or a free street; a free street suppresses the bins.
    """
    hour = F.hour("ts")
    asked = ticks.withColumn("ref_date", F.to_date("ts"))
    found = pickups_tomorrow(cal.where(F.col("bin").isin(*DEVICE_BINS)), asked)
    free = free_street_day(F.col("date"))
    evening = (hour >= EVENING_FROM) & (hour < EVENING_TO)
    lit = evening & ((F.size("bins") > 0) | free)
    none = F.expr("cast(array() as array<int>)")
    return found.withColumn("lit", lit).withColumn(
        "lit_bins", F.when(F.col("lit") & ~free, F.col("bins")).otherwise(none)
    )


def first_unsorted(entries: DataFrame, pos: str, key: str, bucket_rows: int = 65536) -> DataFrame:
    """First position per calendar whose key is smaller than the key before it."""
    bucket = F.floor(F.col(pos) / bucket_rows)
    stepped = previous_row(entries, ["calendar_id"], [pos], [key], bucket)
    return (
        stepped.where(F.col(key) < F.col(f"prev.{key}"))
        .groupBy("calendar_id")
        .agg(F.min(pos).alias("first_unsorted"))
    )


def calendar_profile(cal: DataFrame) -> DataFrame:
    """Entries, distinct months and distinct bins per calendar and year."""
    return cal.groupBy("calendar_id", F.year("date").alias("year")).agg(
        F.count(F.lit(1)).alias("entries"),
        F.size(F.collect_set(F.month("date"))).alias("months"),
        F.array_sort(F.collect_set("bin")).alias("bins"),
    )


# Quality limits; sparse designs as (bin, min and max entries, min months).
BROKEN_BELOW, CRITICAL_BELOW, MIN_FOR_FENCES = 10, 50, 4
SPARSE_DESIGNS = ((2, 20, 60, 10), (4, 8, 30, 7), (6, 10, 60, 8))
SEVERITIES = ("broken", "critical", "alert", "high")
BUCKETS = (("0–9", 0, 10), ("10–49", 10, 50), ("50–99", 50, 100), ("100–149", 100, 150),
           ("150–199", 150, 200), ("200–299", 200, 300), ("300+", 300, None))


def severity_rank(severity: Column) -> Column:
    out = F.lit(9)
    for i, s in enumerate(SEVERITIES):
        out = F.when(severity == s, i).otherwise(out)
    return out


def entry_fences(profile: DataFrame) -> DataFrame:
    """Per year the interquartile fences of entries, null below four calendars."""
    dist = distribution(profile, ["year"], "entries", digits=0)
    q1, q3 = at_index(half_even_index(0.25)), at_index(half_even_index(0.75))
    enough = F.sum("n") >= MIN_FOR_FENCES
    return dist.groupBy("year").agg(
        F.sum("n").alias("calendars"),
        median_agg().alias("median_entries"),
        F.when(enough, q1 - F.lit(1.5) * (q3 - q1)).alias("low"),
        F.when(enough, q3 + F.lit(1.5) * (q3 - q1)).alias("high"),
    )


def classify(profile: DataFrame) -> DataFrame:
    """Severity of each calendar; the order of the cases matters."""
    e = F.col("entries")
    sparse = F.lit(False)
    for bin_no, lo, hi, months in SPARSE_DESIGNS:
        sparse = sparse | (
            (F.col("bins") == F.array(F.lit(bin_no))) & e.between(lo, hi) & (F.col("months") >= months)
        )
    severity = (
        F.when(e < BROKEN_BELOW, F.lit("broken"))
        .when(F.col("low").isNull() | sparse, F.lit("ok"))
        .when(e < CRITICAL_BELOW, F.lit("critical"))
        .when(e < F.col("low"), F.lit("alert"))
        .when(e > F.col("high"), F.lit("high"))
        .otherwise(F.lit("ok"))
    )
    return profile.join(entry_fences(profile), "year").withColumn("severity", severity)


def anomaly_report(classified: DataFrame) -> DataFrame:
    """Per year totals, entry statistics, severity counts and the fixed entry buckets."""
    e = F.col("entries")
    buckets = [
        F.count_if((e >= lo) if hi is None else (e >= lo) & (e < hi)).alias(f"b_{lo}")
        for _, lo, hi in BUCKETS
    ]
    return classified.groupBy("year").agg(
        F.count(F.lit(1)).alias("total"),
        F.first("median_entries").alias("median_entries"),
        round_to(F.avg(e), 1).alias("mean_entries"),
        F.min(e).alias("min_entries"),
        F.max(e).alias("max_entries"),
        *[F.count_if(F.col("severity") == s).alias(s) for s in (*SEVERITIES, "ok")],
        *buckets,
    )


def alert_order() -> list[Column]:
    return [severity_rank(F.col("severity")), F.col("entries"), F.col("calendar_id")]


def gate(classified: DataFrame, fail_on: str) -> DataFrame:
    """Per year whether the worst severity reaches the threshold."""
    limit = SEVERITIES.index(fail_on)
    return classified.groupBy("year").agg(
        (F.min(severity_rank(F.col("severity"))) <= limit).alias("failed")
    )


def reference_errors(streets: DataFrame, cal: DataFrame, years: list[int]) -> DataFrame:
    """Streets whose calendar is blank or has no entry in the active years."""
    path = F.coalesce(F.trim(F.col("calendar_id").cast("string")), F.lit(""))
    streets = streets.withColumn("calendar_id", path)
    active = (
        cal.where(F.year("date").isin(*years))
        .select(F.col("calendar_id").cast("string").alias("calendar_id"))
        .distinct()
    )
    return streets.join(active, "calendar_id", "left_anti").withColumn(
        "error",
        F.when(F.col("calendar_id") == "", F.lit("blank calendar")).otherwise(
            F.lit("no entries in active years")
        ),
    )


def without_streets(municipalities: DataFrame, streets: DataFrame) -> DataFrame:
    return municipalities.join(streets.select("comune").distinct(), "comune", "left_anti")


#: Municipalities in one row of a digest.
PLACES_A_ROW = 100


def failure_digest(errors: DataFrame, samples: int = 5, places: int = PLACES_A_ROW) -> DataFrame:
    """Per failing calendar: error, streets, municipalities and the first samples.

    The list of municipalities is cut into rows of at most ``places``, numbered by ``part``, so
    that a calendar that fails in very many is many rows. Counts come from combined (calendar,
    municipality) rows; samples are limited per calendar before they are shuffled.
    """
    per_place = errors.groupBy("calendar_id", "comune").agg(
        F.count(F.lit(1)).alias("n"), F.min("error").alias("error")
    )
    head = per_place.groupBy("calendar_id").agg(F.min("error").alias("error"), F.sum("n").alias("streets"))
    listed = (
        numbered(per_place.where("comune IS NOT NULL").select("calendar_id", "comune"), ["calendar_id"], ["comune"])
        .groupBy("calendar_id", F.floor((F.col("number") - 1) / places).alias("part"))
        .agg(F.array_join(F.array_sort(F.collect_list("comune")), ", ").alias("places"))
    )
    label = F.concat_ws(" / ", "comune", "street")
    first = (
        errors.select("calendar_id", label.alias("label"), "street_id")
        .withColumn(
            "rn", F.row_number().over(W.partitionBy("calendar_id").orderBy("label", "street_id"))
        )
        .where(F.col("rn") <= samples)
        .groupBy("calendar_id")
        .agg(F.array_join(F.array_sort(F.collect_list("label")), "; ").alias("samples"))
    )
    return listed.join(head, "calendar_id").join(first, "calendar_id")


def diff(expected: DataFrame, extracted: DataFrame) -> DataFrame:
    """Full outer comparison of two entry sets, limited to the expected years.

    One row per entry with status ``both``, ``missing`` or ``extra``.
    """
    keys = ["calendar_id", "date", "bin"]
    years = expected.select("calendar_id", F.year("date").alias("_y")).distinct()
    right = (
        extracted.select(*keys)
        .distinct()
        .withColumn("_y", F.year("date"))
        .join(years, ["calendar_id", "_y"], "left_semi")
        .select(*keys, F.lit(True).alias("_r"))
    )
    left = expected.select(*keys).distinct().withColumn("_l", F.lit(True))
    return left.join(right, keys, "full").select(
        *keys,
        F.when(F.col("_r").isNull(), F.lit("missing"))
        .when(F.col("_l").isNull(), F.lit("extra"))
        .otherwise(F.lit("both"))
        .alias("status"),
    )


def diff_counts(compared: DataFrame) -> DataFrame:
    is_ = F.col("status")
    return compared.groupBy("calendar_id").agg(
        F.count_if(is_ != "extra").alias("expected"),
        F.count_if(is_ != "missing").alias("extracted"),
        F.count_if(is_ == "missing").alias("missing"),
        F.count_if(is_ == "extra").alias("extra"),
    )


def sole_members(rows: DataFrame, group: str, member: str) -> DataFrame:
    """Groups with exactly one member, and that member."""
    return (
        rows.groupBy(group)
        .agg(F.count(F.lit(1)).alias("n"), F.min(member).alias(member))
        .where(F.col("n") == 1)
        .drop("n")
    )


def active_years(cal: DataFrame, default_year: int) -> list[int]:
    """The two latest years after 2000 that occur; this and the next year if none does.

    At most two values reach the driver, where they become a partition filter.
    """
    found = (
        cal.select(F.year("date").alias("year"))
        .where(F.col("year") > 2000)
        .distinct()
        .orderBy(F.col("year").desc())
        .limit(2)
        .collect()
    )
    return sorted(r["year"] for r in found) or [default_year, default_year + 1]


def active_entries(cal: DataFrame, years: list[int]) -> DataFrame:
    """Entries of the active years; both date bounds reach the scan as filters."""
    lo, hi = min(years), max(years)
    span = F.col("date").between(F.make_date(F.lit(lo), F.lit(1), F.lit(1)),
                                 F.make_date(F.lit(hi), F.lit(12), F.lit(31)))
    return cal.where(span & F.year("date").isin(*years)).distinct()
