"""Recurrence rules to dated rows. Every expansion is a narrow, per-row operation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from calendra.functions import rules as R
from calendra.functions.dates import recurs_on, year_days
from calendra.functions.lineage import spread


def spec(weekdays: Column, months: Column, ordinals: Column) -> Column:
    return F.struct(
        weekdays.alias("weekdays"), months.alias("months"), ordinals.alias("ordinals")
    )


def expand_specs(df: DataFrame, year: Column, specs: Column) -> DataFrame:
    """One row per date of the year that any of a row's specs covers.

    The specs are parsed once per rule below the generator and then only compared with
    the generated dates, so expansion needs neither a join nor a shuffle.
    """
    return (
        df.withColumn("_specs", specs)
        .withColumn("date", F.explode(year_days(year)))
        .where(
            F.exists(
                "_specs",
                lambda s: recurs_on(F.col("date"), s["weekdays"], s["months"], s["ordinals"]),
            )
        )
        .drop("_specs")
    )


def expand(df: DataFrame, year: Column, weekdays: Column, months: Column, ordinals: Column) -> DataFrame:
    """One row per date of each rule; keeps the columns of ``df``."""
    return expand_specs(df, year, F.array(spec(weekdays, months, ordinals)))


def expand_weekly(schedule: DataFrame, year: Column, weekday: str = "weekday") -> DataFrame:
    """Weekly schedule rows (…, weekday, …) to every date of the year."""
    return expand(schedule, year, F.array(weekday), R.all_months(), R.every_week())


def expand_clauses(df: DataFrame, text: str, year: Column) -> DataFrame:
    """Free-text seasonal rule to dates: split in clauses, parse each, unite the dates.

    All clauses of a rule are compared with each date at once, so a date comes once and
    nothing has to be made distinct but the rules.
    """
    raw = F.trim(F.regexp_replace(F.col(text), r"\s+", " "))
    by_bracket = F.split(raw, r"(?i)(?<=\))\s+(?=dal\s)")
    by_day = F.split(raw, r"(?i)\s+(?=dal\s+lun)")
    clauses = F.when(F.size(by_bracket) > 1, by_bracket).otherwise(by_day)
    folded = F.filter(F.transform(clauses, R.fold_rule), lambda t: (t != "") & ~F.contains(t, F.lit("DEFINIR")))

    def parsed(t: Column) -> Column:
        kind = R.clause_kind(t)
        months = R.or_default(R.months_of(t), R.all_months())
        odd = F.filter(months, lambda m: m % 2 == 1)
        return spec(R.weekdays_of(t), F.when(kind == "bimonthly", odd).otherwise(months), R.clause_ordinals(kind))

    return expand_specs(spread(df, *df.columns).distinct(), year, F.transform(folded, parsed))


# A sub-rule «ordinals weekday del mese (months)».
SCOPED = (
    r"((?:\b(?:IV|III|II|I|V|E)\b\s*)+)\s*" + R.ANY_WEEKDAY + r"\s+DEL MESE\s*\(([^)]+)\)"
)


def scoped_parts(text: Column) -> Column:
    """Array of (ordinals, weekday, months) texts of the month-scoped sub-rules."""
    groups = [F.regexp_extract_all(text, F.lit(SCOPED), F.lit(i)) for i in (1, 2, 3)]
    return F.arrays_zip(
        groups[0].alias("ordinals"), groups[1].alias("weekday"), groups[2].alias("months")
    )


def scoped_specs(year: Column, text: Column) -> Column:
    """Specs of the month-scoped sub-rules of a folded text that give any date at all.

    Ordinals up to the fourth exist in every month; only a rule made of fifths has to be
    tried on the year's dates.
    """
    parsed = F.transform(
        scoped_parts(text),
        lambda part: spec(
            R.positions(part["weekday"], R.WEEKDAYS, 0),
            R.positions(part["months"], R.MONTHS, 1),
            R.ordinals_of(F.concat(part["ordinals"], F.lit(" DEL MESE"))),
        ),
    )

    def gives_dates(s: Column) -> Column:
        named = (F.size(s["weekdays"]) > 0) & (F.size(s["months"]) > 0)
        sure = F.exists(s["ordinals"], lambda n: n < 5)
        fifth = F.exists(
            year_days(year), lambda d: recurs_on(d, s["weekdays"], s["months"], s["ordinals"])
        )
        return named & (sure | fifth)

    return F.filter(parsed, gives_dates)


def rule_specs(year: Column, weekday_text: Column, rule_text: Column) -> Column:
    """Specs of a (weekday text, rule text) pair of folded texts.

    Month-scoped sub-rules win when they give dates; otherwise weekdays × active months
    without the stopped ones × ordinals, with every week as the default.
    """
    weekdays = R.or_default(
        R.positions(weekday_text, R.WEEKDAYS, 0), R.positions(rule_text, R.WEEKDAYS, 0)
    )
    months = R.or_default(R.active_months_of(rule_text), R.all_months())
    running = F.array_except(months, R.stopped_months_of(rule_text))
    ordinals = R.or_default(R.ordinals_of(rule_text), R.every_week())
    scoped = scoped_specs(year, rule_text)
    return F.when(F.size(scoped) > 0, scoped).otherwise(
        F.array(spec(weekdays, running, ordinals))
    )


def expand_rules(df: DataFrame, weekday_text: str, rule_text: str, year: Column) -> DataFrame:
    folded = df.withColumns(
        {"_w": R.fold_rule(F.col(weekday_text)), "_r": R.fold_rule(F.col(rule_text))}
    )
    return expand_specs(folded, year, rule_specs(year, F.col("_w"), F.col("_r"))).drop("_w", "_r")


def dates_for_codes(choices: DataFrame, dated: DataFrame, year: int, target: str = "target") -> DataFrame:
    """Union of the dates of each target's chosen codes within the year."""
    in_year = dated.where(F.year("date") == year).select("code", "date")
    return choices.select(target, "code").distinct().join(in_year, "code").select(target, "date").distinct()


def preferred_rules(rules: DataFrame, zone: str) -> DataFrame:
    """Keep a zone's best kind of rule: dated, else mechanised, else non-empty, else all.

    Rules need ``type`` and ``rule`` text columns. The best rank per zone is a map-side
    combined minimum joined back, so a zone with many rules is not gathered.
    """
    # Texts repeat across zones, so each distinct pair is folded and parsed once.
    texts = rules.select("type", "rule").distinct()
    folded = texts.withColumns({"_t": R.fold_rule(F.col("rule")), "_k": R.fold_rule(F.col("type"))})
    text = F.col("_t")
    dated = (
        (F.size(R.ordinals_of(text)) > 0)
        | (F.size(R.active_months_of(text)) > 0)
        | text.rlike(SCOPED)
    )
    rank = (
        F.when((text != "") & dated, 0)
        .when(F.col("_k").rlike("MECCANIZZATO|MISTO"), 1)
        .when(text != "", 2)
        .otherwise(3)
    )
    ranks = folded.select("type", "rule", rank.alias("rank"))
    graded = rules.join(ranks, ["type", "rule"])
    best = graded.groupBy(zone).agg(F.min("rank").alias("rank"))
    return graded.join(best, [zone, "rank"]).select(*rules.columns, "rank")
