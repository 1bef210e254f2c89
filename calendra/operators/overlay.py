"""Merging schedules into calendars: overlays, composites, gap filling, index upkeep."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from calendra.functions.lineage import cut, spread
from calendra.functions.text import collapse, slug_unicode
from calendra.operators import matching as M

# The overlay bin and the guards of the overlay driver.
SWEEP_BIN = 6
MIN_MATCHED, MIN_DAYS, MAX_DAYS = 2, 4, 120
GENERATED = "-spa-"

ENTRY = ["calendar_id", "date", "bin"]


def replace_category(cal: DataFrame, overlay: DataFrame, bin_no: int = SWEEP_BIN) -> DataFrame:
    """Old entries of a category out, the overlay's dates in, for calendars it covers.

    Only rows of that category meet the covered calendars in an anti join. All are spread by
    calendar before they are made distinct, so that no task holds the keys of a larger share.
    """
    fresh = overlay.select("calendar_id", "date", F.lit(bin_no).alias("bin"))
    covered = overlay.select("calendar_id").distinct()
    other = cal.where(F.col("bin") != bin_no).select(*ENTRY)
    kept = cal.where(F.col("bin") == bin_no).join(covered, "calendar_id", "left_anti").select(*ENTRY)
    return spread(other.unionByName(kept).unionByName(fresh), "calendar_id").distinct()


def category_counts(before: DataFrame, after: DataFrame, bin_no: int = SWEEP_BIN) -> DataFrame:
    """Entries of the category per calendar before and after a merge."""
    both = before.select(*ENTRY, F.lit(0).alias("side")).unionByName(
        after.select(*ENTRY, F.lit(1).alias("side"))
    )
    mine = F.col("bin") == bin_no
    return both.groupBy("calendar_id").agg(
        F.count_if(mine & (F.col("side") == 0)).alias("before"),
        F.count_if(mine & (F.col("side") == 1)).alias("after"),
    )


def _days_of(selected: DataFrame, dated: DataFrame) -> DataFrame:
    """Choices with the dates of their code as one array: the days of a code are few, and rows
    of (group, date) are many. Both sides are sorted, as Spark takes expanded rules for few."""
    return selected.join(dated.groupBy("code").agg(F.collect_set("date").alias("_days")).hint("merge"), "code")


def _united(days: Column) -> Column:
    return F.array_distinct(F.flatten(F.collect_list(days)))


def overlay_plan(coverage: DataFrame, selected: DataFrame, dated: DataFrame) -> DataFrame:
    """Guarded choice per calendar: codes used, days and status.

    ``coverage`` has grp, matched and total, ``selected`` grp, code and rank, ``dated`` code
    and date. Too many days with two codes are retried with the better one alone.
    """
    days = _days_of(selected, dated).groupBy("grp").agg(
        F.size(_united(F.col("_days"))).cast("bigint").alias("days_all"),
        F.size(_united(F.when(F.col("rank") == 1, F.col("_days")))).cast("bigint").alias("days_first"),
    )
    codes = selected.groupBy("grp").agg(F.max("rank").alias("codes"))
    plan = coverage.join(codes, "grp", "left").join(days, "grp", "left")
    both = F.coalesce("days_all", F.lit(0))
    retry = (both > MAX_DAYS) & (F.col("codes") > 1)
    used = F.when(retry, F.coalesce("days_first", F.lit(0))).otherwise(both)
    status = (
        F.when((F.col("matched") < MIN_MATCHED) | F.col("codes").isNull(), F.lit("few matches"))
        .when(both < MIN_DAYS, F.lit("few days"))
        .when(used > MAX_DAYS, F.lit("too dense"))
        .otherwise(F.lit("merged"))
    )
    return plan.select(
        "grp", "matched", "total", F.when(retry, 1).otherwise(F.coalesce("codes", F.lit(0))).alias("codes"),
        used.alias("days"), status.alias("status"),
    )


def overlay_entries(plan: DataFrame, selected: DataFrame, dated: DataFrame) -> DataFrame:
    """Overlay dates of the calendars whose plan says merged."""
    going = plan.where("status = 'merged'").select("grp", "codes")
    used = selected.join(going, "grp").where(F.col("rank") <= F.col("codes"))
    united = _days_of(used, dated).groupBy("grp").agg(_united(F.col("_days")).alias("_days"))
    return united.select(F.col("grp").alias("calendar_id"), F.explode("_days").alias("date"))


def composite_ids(street_keys: DataFrame, prefix: str) -> DataFrame:
    """Per street its sorted keys and one composite calendar id for the set of keys.

    A street has only a handful of zone keys.
    """
    keys = F.array_sort(F.collect_set("key"))
    return street_keys.groupBy("street").agg(keys.alias("keys")).withColumn(
        "calendar_id",
        F.concat(F.lit(prefix), F.array_join(F.col("keys").cast("array<string>"), "+")),
    )


def composite_entries(ids: DataFrame, zone_dates: DataFrame) -> DataFrame:
    """Union calendar of every distinct key set."""
    distinct = ids.select("calendar_id", "keys").distinct()
    return (
        distinct.select("calendar_id", F.explode("keys").alias("key"))
        .join(zone_dates, "key")
        .select("calendar_id", "date")
        .distinct()
    )


def composites(streets: DataFrame, overlay_keys: DataFrame, bases: DataFrame, zone_dates: DataFrame, bin_no: int = SWEEP_BIN):
    """Composite calendar per distinct (base, overlay set) and the street mapping.

    ``streets`` has street, base and specificity; the most specific base of a street wins.
    Returns (mapping street → calendar_id, entries).
    """
    base = streets.groupBy("street").agg(
        F.max(F.struct("specificity", "base"))["base"].alias("base")
    )
    keyed = composite_ids(overlay_keys, "").withColumnRenamed("calendar_id", "suffix")
    mapping = base.join(keyed, "street").select(
        "street", "base", "keys", F.concat_ws("-plus-", "base", "suffix").alias("calendar_id")
    )
    combos = mapping.select("base", "keys", "calendar_id").distinct()
    kept = combos.join(bases.where(F.col("bin") != bin_no).withColumnRenamed("calendar_id", "base"), "base").select(*ENTRY)
    added = composite_entries(combos, zone_dates).select("calendar_id", "date", F.lit(bin_no).alias("bin"))
    return mapping.select("street", "calendar_id"), kept.unionByName(added).distinct()


def composite_status(streets: DataFrame, overlay_keys: DataFrame) -> DataFrame:
    """How many streets have an overlay, a base, both or neither."""
    a = streets.select("street").distinct().withColumn("has_base", F.lit(True))
    b = overlay_keys.select("street").distinct().withColumn("has_overlay", F.lit(True))
    status = (
        F.when(F.col("has_base") & F.col("has_overlay"), F.lit("composite"))
        .when(F.col("has_base"), F.lit("no overlay"))
        .otherwise(F.lit("no base"))
    )
    return a.join(b, "street", "full").groupBy(status.alias("status")).agg(F.count(F.lit(1)).alias("streets"))


def prefer_then_fill(first: DataFrame, second: DataFrame, key: str, code: str, spaces: tuple[str, str]) -> DataFrame:
    """All rows of the first source; rows of the second only for keys the first lacks."""

    def spaced(df: DataFrame, space: str) -> DataFrame:
        return df.select(key, F.concat(F.lit(f"{space}:"), F.col(code).cast("string")).alias(code))

    gaps = second.join(first.select(key).distinct(), key, "left_anti")
    return spaced(first, spaces[0]).unionByName(spaced(gaps, spaces[1])).distinct()


INDEX = ["comune", "name", "calendar"]


def rebuild_index(manifest: DataFrame, existing: DataFrame) -> DataFrame:
    """Curated rows kept, manifest rows added once; zone label where a zone has no address.

    ``manifest`` has comune, calendar, zone_label and addresses (array).
    """
    named = F.when(F.size("addresses") > 0, F.col("addresses")).otherwise(F.array("zone_label"))
    rows = manifest.select("comune", "calendar", F.explode(named).alias("name")).select(*INDEX)
    return existing.select(*INDEX).unionByName(rows).withColumn("name", collapse(F.col("name"))).distinct()


def reimport_index(manifest: DataFrame, existing: DataFrame) -> DataFrame:
    """Rows of re-imported calendars replaced, all others kept."""
    fresh = manifest.select(*INDEX).distinct()
    kept = existing.join(fresh.select("calendar").distinct(), "calendar", "left_anti").select(*INDEX)
    return kept.unionByName(fresh).distinct()


def replace_generated(existing: DataFrame, generated: DataFrame) -> DataFrame:
    """Generated rows dropped before the new ones are added."""
    kept = existing.where(~F.contains("calendar", F.lit(GENERATED))).select(*INDEX)
    return kept.unionByName(generated.select(*INDEX)).distinct()


def manifest(entries: DataFrame) -> DataFrame:
    """Per slug its years with their number of entries (one row per slug, few years)."""
    per_year = entries.groupBy("slug", F.year("date").cast("string").alias("year")).agg(F.count(F.lit(1)).alias("n"))
    pairs = F.array_sort(F.collect_list(F.struct("year", "n")))
    return per_year.groupBy("slug").agg(F.map_from_entries(pairs).alias("years"), F.sum("n").alias("entries"))


def failed_sources(sources: DataFrame, entries: DataFrame) -> DataFrame:
    """Sources that gave no entry, as an error table."""
    return sources.join(entries.select("slug").distinct(), "slug", "left_anti").withColumn(
        "error", F.lit("no entries")
    )


def zone_import(
    schedules: DataFrame, options: DataFrame, entries: DataFrame, index: DataFrame, rules: Sequence[tuple[str, str]], comune: str,
    bin_no: int = SWEEP_BIN,
) -> dict[str, DataFrame]:
    """Import of dated zones as one flow: zone calendars, union calendars, collection calendars.

    ``schedules`` has key (number), zone and date; ``options`` option_id, street and zone (of
    several parts); ``rules`` are ordered needles of zone names with the collection calendar
    they belong to. One relation of option and key (``zone_keys``) decides everything:

    * ``entries``: every zone becomes a calendar, every distinct list of two or more zones of
      a street a calendar of their union; collection calendars that exist get their zones'
      dates in place of the category; all other entries stay.
    * ``index``: streets with their calendar and zones with theirs in place of the rows
      generated before.
    * ``report``: streets by whether a calendar was found.

    Generated calendars are replaced as a whole, so a second run changes nothing.
    """
    prefix = F.lit(f"calendars/{comune}{GENERATED}")
    zones = schedules.select("key", "zone").distinct()
    names = zones.select("key", "zone", M.fold_zone(F.col("zone")).alias("n"), slug_unicode(F.col("zone")).alias("slug"))
    zone_keys = M.resolve_zone_keys(options.select("option_id", "zone"), names.select("n", "key"))
    # a street has a handful of zones, in the order of its parts; all results read this, so it is cut
    listed = cut(
        zone_keys.join(names.select("key", "slug"), "key").groupBy("option_id")
        .agg(F.array_sort(F.collect_set(F.struct("pos", "key", "slug"))).alias("own"))
        .select("option_id", F.transform("own", lambda z: z["key"]).alias("keys"), F.array_join(F.transform("own", lambda z: z["slug"]), "-").alias("slug"))
        .withColumn("calendar", F.concat(prefix, "slug"))
    )
    dates = schedules.where("date IS NOT NULL").select("key", "date").distinct()
    sweep = F.lit(bin_no).alias("bin")
    of_zone = names.select("key", F.concat(prefix, "slug").alias("calendar_id"))
    of_list = listed.where(F.size("keys") > 1).select(F.col("calendar").alias("calendar_id"), F.explode("keys").alias("key")).distinct()
    generated = of_zone.unionByName(of_list.select("key", "calendar_id")).join(dates, "key").select("calendar_id", "date", sweep).distinct()

    collected = names.select("key", M.ordered_needles(F.col("n"), rules).alias("calendar_id")).where("calendar_id IS NOT NULL")
    known = entries.select("calendar_id").distinct()
    overlay = collected.join(known, "calendar_id", "left_semi").join(dates, "key").select("calendar_id", "date")
    others = entries.join(generated.select("calendar_id").distinct(), "calendar_id", "left_anti")
    after = replace_category(others, overlay, bin_no).unionByName(generated.select(*ENTRY)).distinct()

    place = F.lit(comune).alias("comune")
    of_streets = options.join(listed, "option_id").select(place, F.col("street").alias("name"), "calendar")
    of_zones = names.select(place, F.concat(F.lit("Zona "), "zone").alias("name"), F.concat(prefix, "slug").alias("calendar"))
    report = options.join(listed, "option_id", "left").groupBy(F.col("calendar").isNotNull().alias("found")).agg(F.count("*").alias("streets"))
    return {"entries": after, "index": replace_generated(index, of_streets.unionByName(of_zones)), "report": report}
