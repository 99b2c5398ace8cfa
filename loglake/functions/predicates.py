"""Search predicates as Columns. They compose with ``&``, ``|`` and ``~``.

Exact and range predicates work on raw columns so that they reach the Parquet scan. Token predicates search the whole
text for the terms with word borders around them, which says the same as tokenising and builds no arrays; a plain
substring test goes first and rules out most rows.
"""

from __future__ import annotations

import re
from datetime import datetime
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from loglake.functions.text import BETWEEN, as_word, catch_all_text, query_terms
from loglake.schema import LEVELS

# Units of relative time expressions and the Spark interval unit of each.
DATE_MATH_UNITS = {
    "MILLIS": "MILLISECOND", "MILLI": "MILLISECOND",
    "SECONDS": "SECOND", "SECOND": "SECOND",
    "MINUTES": "MINUTE", "MINUTE": "MINUTE",
    "HOURS": "HOUR", "HOUR": "HOUR",
    "DAYS": "DAY", "DAY": "DAY",
    "MONTHS": "MONTH", "MONTH": "MONTH",
    "YEARS": "YEAR", "YEAR": "YEAR",
}


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def term(field: Column | str, value) -> Column:
    """Exact, case-sensitive equality on a verbatim field."""
    return _col(field) == value


def match(field: Column | str, text: str) -> Column:
    """Any token of the field equals any token of ``text``, ignoring case."""
    terms, lowered = query_terms(text), F.lower(_col(field))
    if not terms:
        return F.lit(False)
    return any_of(*[lowered.contains(t) for t in terms]) & lowered.rlike("|".join(map(as_word, terms)))


def search(text: str, columns: list[str] | None = None) -> Column:
    """Bare terms: ``match`` over the catch-all text."""
    return match(catch_all_text(columns), text)


def phrase(field: Column | str, text: str) -> Column:
    """The tokens of ``text`` stand next to each other in the field."""
    terms, lowered = query_terms(text), F.lower(_col(field))
    if not terms:
        return F.lit(False)
    return all_of(*[lowered.contains(t) for t in terms]) & lowered.rlike(BETWEEN.join(map(as_word, terms)))


def relative_time(expression: str | datetime | Column | None, now: datetime | Column) -> Column | None:
    """``NOW``, ``NOW-10MINUTES``, ``NOW/DAY-2HOURS``, an ISO instant, or ``*`` for an open end (None)."""
    if isinstance(expression, Column):
        return expression
    if isinstance(expression, datetime):
        return F.lit(expression).cast("timestamp")
    if expression in (None, "*"):
        return None
    if not expression.startswith("NOW"):
        return F.lit(expression).cast("timestamp")
    rest = expression[3:]
    at = now if isinstance(now, Column) else F.lit(now).cast("timestamp")
    steps = re.findall(r"([+-])(\d+)([A-Z]+)|/([A-Z]+)", rest)
    spelled = "".join(f"{s}{n}{u}" if s else f"/{r}" for s, n, u, r in steps)
    if spelled != rest:
        raise ValueError(f"not a relative time: {expression!r}")
    for sign, amount, unit, floor in steps:
        if floor:
            at = F.date_trunc(DATE_MATH_UNITS[floor], at)
        else:
            step = F.expr(f"INTERVAL '{int(amount)}' {DATE_MATH_UNITS[unit]}") if unit[:5] != "MILLI" else F.expr(
                f"INTERVAL '{int(amount) / 1000:.3f}' SECOND"
            )
            at = at + step if sign == "+" else at - step
    return at


def time_range(field: Column | str, lo, hi, now: datetime | Column) -> Column:
    """``[lo TO hi]``, inclusive at both ends; ``now`` is the evaluation time."""
    col, low, high = _col(field), relative_time(lo, now), relative_time(hi, now)
    parts = ([col >= low] if low is not None else []) + ([col <= high] if high is not None else [])
    return reduce(lambda a, b: a & b, parts) if parts else col.isNotNull()


def num_range(field: Column | str, lo=None, hi=None) -> Column:
    """Inclusive numeric range; ``None`` leaves an end open."""
    col = _col(field)
    parts = ([col >= lo] if lo is not None else []) + ([col <= hi] if hi is not None else [])
    return reduce(lambda a, b: a & b, parts) if parts else col.isNotNull()


def all_of(*predicates: Column) -> Column:
    return reduce(lambda a, b: a & b, predicates, F.lit(True))


def any_of(*predicates: Column) -> Column:
    return reduce(lambda a, b: a | b, predicates, F.lit(False))


def negate(predicate: Column) -> Column:
    """Everything the predicate does not match, rows without the field included."""
    return ~F.coalesce(predicate, F.lit(False))


def match_all() -> Column:
    return F.lit(True)


def exists(field: Column | str) -> Column:
    return _col(field).isNotNull()


def missing(field: Column | str) -> Column:
    return _col(field).isNull()


def prefix(field: Column | str, value: str) -> Column:
    return _col(field).startswith(value)


def wildcard(field: Column | str, pattern: str) -> Column:
    """``*`` stands for any text, ``?`` for one character; the whole value must match."""
    # LIKE treats % and _ as wildcards, so literal ones are escaped.
    like = pattern.replace("\\", "\\\\").replace("%", r"\%").replace("_", r"\_").replace("*", "%").replace("?", "_")
    return _col(field).like(like)


def level_at_least(level: str, field: Column | str = "level") -> Column:
    """Severity at or above ``level``; unknown level names do not match."""
    return F.upper(_col(field)).isin(LEVELS[LEVELS.index(level.upper()):])


def inside_wait_period(last: Column, now: Column, retry_interval: Column) -> Column:
    """Whole minutes since ``last`` do not exceed the interval; the boundary minute still waits."""
    # Truncation towards zero: a `last` in the future counts as zero or negative minutes.
    minutes = F.floor((F.unix_micros(now) - F.unix_micros(last)) / F.lit(60_000_000))
    return last.isNotNull() & (minutes <= retry_interval)


def exceeds_threshold(found: Column, threshold: Column, strict_reference: bool = False) -> Column:
    """More rows than the threshold (default 0); with threshold -1, no rows at all.

    ``strict_reference`` lets -1 fire on any row count, as a plain ``found > threshold`` test does.
    """
    limit = F.coalesce(threshold, F.lit(0))
    if strict_reference:
        return ((limit == -1) & (found == 0)) | (found > limit)
    return F.when(limit == -1, found == 0).otherwise(found > limit)
