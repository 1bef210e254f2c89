"""``expand_rule(weekday, rule, year)``: rule texts to dates as a table function of SQL.

The body says in SQL what the column expressions of ``rules`` and ``recurrence`` say, out of
the same fixed words and patterns, so that plain SQL can write
``SELECT … FROM zones, LATERAL expand_rule(weekday, rule, 2026)``. Everything stays in the JVM.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import SparkSession

from calendra.functions import rules as R
from calendra.functions.text import BASE_LETTERS, COMPOSED
from calendra.operators.recurrence import SCOPED

NAME = "expand_rule"
MARKS = r"\p{Mn}"


def _text(value: str) -> str:
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _folded(name: str) -> str:
    upper = f"upper(coalesce({name}, ''))"
    plain = f"regexp_replace(translate({upper}, {_text(COMPOSED)}, {_text(BASE_LETTERS)}), {_text(MARKS)}, '')"
    return f"trim(regexp_replace(regexp_replace({plain}, {_text(r'[^\x00-\x7F]+|-')}, ' '), {_text(r'\s+')}, ' '))"


def _numbers(found: str, key: str, values: Mapping[str, int]) -> str:
    """The sorted distinct numbers of found words."""
    pairs = ", ".join(f"{_text(k)}, {v}" for k, v in values.items())
    return f"array_sort(array_distinct(transform({found}, word -> map({pairs})[{key}])))"


def _positions(text: str, words: Sequence[str], base: int) -> str:
    found = f"regexp_extract_all({text}, {_text('(' + '|'.join(words) + ')')}, 1)"
    return _numbers(found, "left(word, 3)", {w[:3]: base + i for i, w in enumerate(words)})


def _ordinals(text: str) -> str:
    return _numbers(f"regexp_extract_all({text}, {_text(R.ORDINAL_PATTERN)}, 1)", "word", R.ORDINALS)


def _first(text: str, patterns: Sequence[str]) -> str:
    hits = ", ".join(f"nullif(regexp_extract({text}, {_text(p)}, 1), '')" for p in patterns)
    return f"coalesce({hits}, '')"


def _default(values: str, default: str) -> str:
    return f"if(size({values}) > 0, {values}, {default})"


def _recurs(day: str, spec: str) -> str:
    nth = f"array_contains({spec}.ordinals, cast(ceil(day({day}) / 7.0) as int))"
    last = f"(array_contains({spec}.ordinals, -1) AND month(date_add({day}, 7)) <> month({day}))"
    return (
        f"array_contains({spec}.weekdays, weekday({day})) AND array_contains({spec}.months, month({day})) AND ({nth} OR {last})"
    )


def definition() -> str:
    """The statement that creates the function in a session."""
    parts = ", ".join(f"regexp_extract_all(r, {_text(SCOPED)}, {i})" for i in (1, 2, 3))
    part = (
        f"named_struct('weekdays', {_positions('part.`1`', R.WEEKDAYS, 0)}, 'months', {_positions('part.`2`', R.MONTHS, 1)}, "
        f"'ordinals', {_ordinals('concat(part.`0`, ' + _text(' DEL MESE') + ')')})"
    )
    scoped = (
        f"filter(transform(arrays_zip({parts}), part -> {part}), s -> size(s.weekdays) > 0 AND size(s.months) > 0 "
        f"AND (exists(s.ordinals, n -> n < 5) OR exists(days, d -> {_recurs('d', 's')})))"
    )
    weekdays = _default(_positions("w", R.WEEKDAYS, 0), _positions("r", R.WEEKDAYS, 0))
    active = _default(_positions(_first("r", R.ACTIVE_CLAUSES), R.MONTHS, 1), "sequence(1, 12)")
    stopped = _positions(_first("r", R.STOPPED_CLAUSES), R.MONTHS, 1)
    whole = (
        f"array(named_struct('weekdays', {weekdays}, 'months', array_except({active}, {stopped}), "
        f"'ordinals', {_default(_ordinals('r'), 'sequence(1, 5)')}))"
    )
    return f"""
    CREATE OR REPLACE TEMPORARY FUNCTION {NAME}(weekday_text STRING, rule_text STRING, rule_year INT)
    RETURNS TABLE (date DATE)
    RETURN SELECT explode(filter(days, day_ -> exists(specs, spec -> {_recurs('day_', 'spec')}))) AS date
    FROM (SELECT days, if(size(scoped) > 0, scoped, {whole}) AS specs
      FROM (SELECT w, r, days, {scoped} AS scoped
        FROM (SELECT {_folded('weekday_text')} AS w, {_folded('rule_text')} AS r,
          sequence(make_date(rule_year, 1, 1), make_date(rule_year, 12, 31)) AS days)))"""


def register(spark: SparkSession) -> None:
    """Make ``expand_rule`` known to the session's SQL."""
    spark.sql(definition())
