"""Italian schedule text to weekdays, months and ordinals, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from calendra.functions.text import collapse, strip_accents

# Weekday stems (Monday first), months and ordinal words.
WEEKDAYS = ("LUNED", "MARTED", "MERCOLED", "GIOVED", "VENERD", "SABATO", "DOMENICA")
MONTHS = (
    "GENNAIO", "FEBBRAIO", "MARZO", "APRILE", "MAGGIO", "GIUGNO",
    "LUGLIO", "AGOSTO", "SETTEMBRE", "OTTOBRE", "NOVEMBRE", "DICEMBRE",
)
ORDINALS = {
    "I": 1, "II": 2, "III": 3, "IV": 4, "V": 5,
    "1": 1, "2": 2, "3": 3, "4": 4, "5": 5,
    "PRIMO": 1, "SECONDO": 2, "TERZO": 3, "QUARTO": 4,
}
ORDINAL_WINDOW = 40

ANY_WEEKDAY = "(" + "|".join(w + ("" if w.endswith(("O", "A")) else r"\w*") for w in WEEKDAYS) + ")"
ANY_MONTH = "(" + "|".join(MONTHS) + ")"
NO_INTS = "cast(array() as array<int>)"


def fold_rule(c: Column) -> Column:
    """Upper case ASCII with single spaces; dashes and degree signs become spaces."""
    s = strip_accents(F.upper(F.coalesce(c, F.lit(""))))
    return collapse(F.regexp_replace(s, r"[^\x00-\x7F]+|-", " "))


def _lookup(words: tuple[str, ...], base: int) -> Column:
    pairs = [F.lit(x) for i, w in enumerate(words) for x in (w[:3], base + i)]
    return F.create_map(*pairs)


def positions(text: Column, words: tuple[str, ...], base: int) -> Column:
    """Sorted positions of the words that occur in the text.

    The text is read once: all words are found by one pattern and looked up by their first
    three letters, which are distinct.
    """
    lookup = _lookup(words, base)
    found = F.regexp_extract_all(text, F.lit("(" + "|".join(words) + ")"), F.lit(1))
    return F.array_sort(F.array_distinct(F.transform(found, lambda w: lookup[F.left(w, F.lit(3))])))


def stem_position(word: Column, words: tuple[str, ...], base: int) -> Column:
    """Position of the listed word that the (possibly inflected) word starts with."""
    return F.try_element_at(_lookup(words, base), F.left(word, F.lit(3)))


def cyclic_range(lo: Column, hi: Column, first: int, last: int) -> Column:
    """lo..hi, going over the end of the cycle when lo is after hi."""
    return F.when(lo <= hi, F.sequence(lo, hi)).otherwise(
        F.concat(F.sequence(lo, F.lit(last)), F.sequence(F.lit(first), hi))
    )


def weekdays_of(text: Column) -> Column:
    """Weekdays (Mon=0) of a folded text: «dal A al B [escluso C]», else every named day."""
    span = rf"DAL\s+{ANY_WEEKDAY}\s+AL\s+{ANY_WEEKDAY}"
    lo = stem_position(F.regexp_extract(text, span, 1), WEEKDAYS, 0)
    hi = stem_position(F.regexp_extract(text, span, 2), WEEKDAYS, 0)
    excluded = F.transform(
        F.regexp_extract_all(text, F.lit(rf"ESCLUSO\s+{ANY_WEEKDAY}"), F.lit(1)),
        lambda w: stem_position(w, WEEKDAYS, 0),
    )
    ranged = F.array_except(cyclic_range(lo, hi, 0, 6), excluded)
    return F.when(text.rlike(span), ranged).otherwise(positions(text, WEEKDAYS, 0))


def months_of(text: Column) -> Column:
    """Month range «A [-|a|al|fino al] B» of a folded text, else every named month."""
    span = rf"\b{ANY_MONTH}\s+(?:-|A|AL|FINO AL)?\s*{ANY_MONTH}\b"
    lo = stem_position(F.regexp_extract(text, span, 1), MONTHS, 1)
    hi = stem_position(F.regexp_extract(text, span, 2), MONTHS, 1)
    return F.when(text.rlike(span), cyclic_range(lo, hi, 1, 12)).otherwise(
        positions(text, MONTHS, 1)
    )


ORDINAL_WORDS = "|".join(sorted(ORDINALS, key=len, reverse=True))
NEAR_WORDS = "|".join(rf".{{0,{ORDINAL_WINDOW - len(w)}}}{w}" for w in (*WEEKDAYS, "MESE"))
ORDINAL_PATTERN = rf"\b({ORDINAL_WORDS})\b(?:(?={NEAR_WORDS})|(?<=MESE.{{1,4}}))"


def ordinals_of(text: Column) -> Column:
    """Roman, digit or word ordinals that stand close to a weekday or to «mese»."""
    found = F.regexp_extract_all(text, F.lit(ORDINAL_PATTERN), F.lit(1))
    lookup = F.create_map(*[F.lit(x) for pair in ORDINALS.items() for x in pair])
    return F.array_sort(F.array_distinct(F.transform(found, lambda w: lookup[w])))


# The clauses that hold lists of months, and where the lists end.
STOPPED_CLAUSES = (
    r"SERVIZIO\s+INTERR\w*\s+(?:NEI\s+)?MESI?\s+DI\s+(.+?)(?=\s+I\b|\s+II\b|\s+III\b|\s+IV\b|\s+OFFERTA|\s+MATTINO|$)",
    r"INTERR\w*\s+(?:NEL(?:LA|LE)?\s+)?MESE?\s+DI\s+(.+?)(?=\s+I\b|\s+II\b|\s+III\b|\s+IV\b|\s+MATTINO|$)",
)
ACTIVE_CLAUSES = (
    r"ATTIVO\s+NEI\s+MESI\s+DI\s+(.+?)(?=\s+I\b|\s+II\b|\s+III\b|\s+IV\b|$)",
    r"DEL MESE.{0,10}?MESI\s+DI\s+(.+)",
    r"^.*(?<!NEI )MESI\s+DI\s+(.+)",
)


def first_match(text: Column, *patterns: str) -> Column:
    """First capture group of the first pattern that matches; empty text if none does."""
    hits = [F.nullif(F.regexp_extract(text, p, 1), F.lit("")) for p in patterns]
    return F.coalesce(*hits, F.lit(""))


def stopped_months_of(text: Column) -> Column:
    """Months named in an interruption clause."""
    return positions(first_match(text, *STOPPED_CLAUSES), MONTHS, 1)


def active_months_of(text: Column) -> Column:
    """Months of the service clause: «attivo nei mesi di», «del mese mesi di», last «mesi di»."""
    return positions(first_match(text, *ACTIVE_CLAUSES), MONTHS, 1)


def all_months() -> Column:
    return F.sequence(F.lit(1), F.lit(12))


def or_default(values: Column, default: Column) -> Column:
    return F.when(F.size(values) > 0, values).otherwise(default)


def every_week() -> Column:
    return F.array(*[F.lit(i) for i in range(1, 6)])


# Frequency words; the first pattern that matches decides.
FREQUENCIES = (
    ("last", r"ULTIMO.*MESE|MESE.*ULTIMO"),
    ("monthly", r"UNA\s+VOLTA\s+AL\s+MESE|OGNI\s+MESE"),
    ("bimonthly", r"OGNI\s+DUE\s+MESI|UNA\s+VOLTA\s+OGNI\s+2\s+MESI"),
    ("biweekly", r"OGNI\s+DUE\s+SETTIMANE|OGNI\s+15\s+GIORNI"),
)


def clause_kind(text: Column) -> Column:
    """Frequency of a folded clause; weekly if no pattern matches."""
    kind = F.lit("weekly")
    for name, pattern in reversed(FREQUENCIES):
        kind = F.when(text.rlike(pattern), F.lit(name)).otherwise(kind)
    return kind


def clause_ordinals(kind: Column) -> Column:
    return (
        F.when(kind == "last", F.array(F.lit(-1)))
        .when(kind.isin("monthly", "bimonthly"), F.array(F.lit(1)))
        .when(kind == "biweekly", F.array(F.lit(1), F.lit(3), F.lit(5)))
        .otherwise(every_week())
    )
