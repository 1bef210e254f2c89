"""Numeric column expressions: rounding, Italian number text, display labels."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def round_to(c: Column | str, digits: int = 0) -> Column:
    """Half-up rounding done in IEEE doubles, so every engine gives the same bits."""
    scale = float(10**digits)
    return F.floor(col(c) * F.lit(scale) + F.lit(0.5)) / F.lit(scale)


def per_head_kg(tonnes: Column | str, pop: Column | str, digits: int = 1) -> Column:
    """Tonnes to kilograms per inhabitant; null without tonnes or population."""
    return round_to(
        F.when(col(pop) > 0, col(tonnes) * F.lit(1000.0) / col(pop)), digits
    )


def share_pct(part: Column | str, total: Column | str, digits: int = 2) -> Column:
    return round_to(F.lit(100.0) * col(part) / F.nullif(col(total), F.lit(0.0)), digits)


def parse_italian_number(c: Column | str) -> Column:
    """``1.234,5`` to 1234.5; percent signs and blanks dropped; ``-`` and empty to null."""
    text = F.regexp_replace(col(c), r"[%\s ]", "")
    text = F.when(~text.isin("", "-"), text)
    return F.translate(F.replace(text, F.lit("."), F.lit("")), ",", ".").try_cast("double")


def italian_thousands(c: Column | str) -> Column:
    return F.translate(F.format_number(col(c), 0), ",", ".")


def population_bound(c: Column | str) -> Column:
    """Population bound rounded half-even to 50, 100 or 1000 by size, Italian thousands."""
    n = col(c).cast("double")
    unit = (
        F.when(n < 500, 1.0).when(n < 1000, 50.0).when(n < 10000, 100.0).otherwise(1000.0)
    )
    return italian_thousands((F.bround(n / unit) * unit).cast("bigint"))


def compact_number(c: Column | str) -> Column:
    """``1,2 M`` from a million, ``34 mila`` from ten thousand, else thousands with dots."""
    n = col(c)
    return (
        F.when(
            n >= 1_000_000,
            F.concat(
                F.translate(F.format_string("%.1f", round_to(n / F.lit(1e6), 1)), ".", ","),
                F.lit(" M"),
            ),
        )
        .when(
            n >= 10_000,
            F.concat(F.floor(n / F.lit(1000.0) + 0.5).cast("string"), F.lit(" mila")),
        )
        .otherwise(italian_thousands(n))
    )
