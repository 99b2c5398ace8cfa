"""An index over thousands of rule conditions, so that neither plans nor scans grow with the number of rules.

Conditions that differ in compared constants only have one shape. A shape is one expression in the plan, and its
constants are columns of the index, which has a row per rule: constants that all rules of a shape share are put back
into the text, equalities with the others make the key. A log row gives, for each shape whose shared part it satisfies,
its own values of the key; these meet the index in an equi-join, and the rest of a condition is tested on the
candidates alone.
"""

from __future__ import annotations

import logging
import re
from collections.abc import Iterator
from typing import NamedTuple

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loglake.frames import local_frame
from loglake.sources.config import AlertRule

log = logging.getLogger(__name__)

# Strings, quoted names, numbers, words, comparisons, and single characters of a condition.
_PART = re.compile(
    r"""'(?:[^'\\]|\\.)*'|"(?:[^"\\]|\\.)*"|`[^`]*`|\d+(?:\.\d*)?(?:[eE][+-]?\d+)?\w*|\w+|<=>|<>|!=|==|<=|>=|\S""",
    re.DOTALL,
)
_COMPARISONS = {"=", "==", "<=>", "!=", "<>", "<", "<=", ">", ">="}
_OTHER_TESTS = {"NOT", "IS", "IN", "LIKE", "RLIKE", "ILIKE", "REGEXP", "BETWEEN", "EXISTS"}
# Stands for a constant in the text of a shape.
_HOLE = "\x00"

_INDEX = T.StructType(
    [
        T.StructField("_rule_application", T.StringType()),
        T.StructField("_rule_shape", T.IntegerType()),
        T.StructField("_rule_key", T.ArrayType(T.StringType())),
        T.StructField("_rule_s", T.ArrayType(T.StringType())),
        T.StructField("_rule_i", T.ArrayType(T.LongType())),
        T.StructField("_rule_lookback", T.IntegerType()),
        T.StructField("condition", T.IntegerType()),
    ]
)


class Conjunct(NamedTuple):
    """A part of a condition that has to hold: its text with holes, and the side that is set equal to the one hole."""

    text: str
    equal_to: str | None


class Reading(NamedTuple):
    conjuncts: tuple[Conjunct, ...]
    constants: tuple[tuple[str | int, ...], ...]  # of each conjunct

    @property
    def shape(self) -> tuple:
        kinds = tuple(tuple(_kind(c) for c in constants) for constants in self.constants)
        return self.conjuncts, kinds


def _kind(constant: str | int) -> str:
    return "string" if isinstance(constant, str) else "int" if constant < 1 << 31 else "bigint"


def _constant(part: str) -> str | int | None:
    """The value of a plain string or whole number; None for what is better left in the text."""
    if part[0] == "'" and "\\" not in part:
        return part[1:-1]
    return int(part) if part.isascii() and part.isdigit() and len(part) < 19 else None


def read_condition(text: str) -> Reading | None:
    """The conjuncts of a condition and the constants they compare with; None where its text is not that plain."""
    if _HOLE in text or "--" in text or "/*" in text:
        return None
    parts = list(_PART.finditer(text))
    words = [p[0].upper() for p in parts]
    conjuncts: list[Conjunct] = []
    constants: list[tuple[str | int, ...]] = []
    one = _or_outside(words)  # then the whole text is one conjunct
    depth, open_betweens, begin = 0, [], 0
    held, holes, tests, odd = [], [], [], one
    cut = 0  # where the text not yet taken over begins

    def close(end: int) -> None:
        body = "".join([*held, text[cut:end]]).strip()
        side = None
        if len(tests) == 1 and not odd and len(holes) == 1 and body.endswith(_HOLE) and words[tests[0]] in ("=", "=="):
            side = text[begin : parts[tests[0]].start()].strip()
        conjuncts.append(Conjunct(body, side))
        constants.append(tuple(holes))

    for i, (part, word) in enumerate(zip(parts, words, strict=True)):
        after = words[i + 1] if i + 1 < len(words) else ")"
        if word in ("(", "[", "CASE"):
            depth += 1
        elif word in (")", "]", "END"):
            depth -= 1
        elif word == "BETWEEN":
            open_betweens.append(depth)
        elif word == "AND":
            if open_betweens and open_betweens[-1] == depth:
                open_betweens.pop()
            elif depth == 0 and not one:
                close(part.start())
                held, holes, tests, odd = [], [], [], False
                begin = cut = part.end()
        if depth == 0 and word in _COMPARISONS:
            tests.append(i)
        if depth == 0 and word in _OTHER_TESTS:
            odd = True
        before = words[i - 1] if i else ""
        compared = before in _COMPARISONS or before == "BETWEEN" or before == "AND" and _ends_between(words, i - 1)
        value = _constant(part[0]) if compared and after in ("AND", "OR", ")") else None
        if value is not None:
            held += [text[cut : part.start()], _HOLE]
            holes.append(value)
            cut = part.end()
    if depth or not parts:
        return None
    close(len(text))
    return Reading(tuple(conjuncts), tuple(constants))


def _or_outside(words: list[str]) -> bool:
    depth = 0
    for word in words:
        depth += (word in ("(", "[", "CASE")) - (word in (")", "]", "END"))
        if word == "OR" and depth == 0:
            return True
    return False


def _ends_between(words: list[str], at: int) -> bool:
    """Whether the AND at this place belongs to a BETWEEN."""
    depth = waiting = 0
    for word in reversed(words[:at]):
        depth += (word in (")", "]", "END")) - (word in ("(", "[", "CASE"))
        if depth < 0:
            return False
        if depth == 0 and word == "AND":
            waiting += 1
        if depth == 0 and word == "BETWEEN":
            return waiting == 0
    return False


class Shape(NamedTuple):
    """Conditions of one shape: what all of them share, what makes the key, and what is tested on candidates."""

    shared: list[str]
    keys: list[str]
    residual: list[str]


class RuleIndex(NamedTuple):
    order: list[tuple]  # keys of the conditions by number
    shapes: list[Shape]
    rules: DataFrame  # a row per rule: see _INDEX
    applications: list[list[str]]  # that use each shape
    has_lookback: bool


def by_shape(rules: dict[tuple, tuple[str, AlertRule]]) -> Iterator[dict[tuple, Reading]]:
    """Keys and readings of the conditions that have a shape in common with others."""
    found: dict[tuple, dict[tuple, Reading]] = {}
    for key, (_, rule) in rules.items():
        reading = None if rule.predicate else read_condition(rule.query)
        if reading is not None and any(reading.constants):
            found.setdefault(reading.shape, {})[key] = reading
    return (readings for readings in found.values() if len(readings) > 1)


def _literal(constant: str | int) -> str:
    return f"'{constant}'" if isinstance(constant, str) else str(constant)


def _filled(text: str, fillings: list[str]) -> str:
    pieces = text.split(_HOLE)
    return "".join(p + f for p, f in zip(pieces, [*fillings, ""], strict=True))


def _with_rule(logs: DataFrame) -> DataFrame:
    return logs.withColumns({f.name: F.lit(None).cast(f.dataType) for f in _INDEX.fields})


def index_shape(logs: DataFrame, readings: list[Reading]) -> tuple[Shape, list[dict]] | None:
    """The shape of these conditions and, for each of them, its part of an index row; None if it cannot be resolved."""
    kinds = readings[0].shape[1]
    shared, keys, residual = [], [], []
    rows: list[dict] = [{"_rule_key": [], "_rule_s": [], "_rule_i": []} for _ in readings]
    for n, conjunct in enumerate(readings[0].conjuncts):
        values = list(zip(*(r.constants[n] for r in readings), strict=True))
        varying = [len(set(v)) > 1 for v in values]
        if not any(varying):
            shared.append(_filled(conjunct.text, [_literal(v[0]) for v in values]))
            continue
        if conjunct.equal_to is not None and _same_kind(logs, conjunct.equal_to, kinds[n][0]):
            keys.append(conjunct.equal_to)
            for row, value in zip(rows, values[0], strict=True):
                row["_rule_key"].append(str(value))
            continue
        fillings = []
        for v, varies, kind in zip(values, varying, kinds[n], strict=True):
            if not varies:
                fillings.append(_literal(v[0]))
                continue
            column = "_rule_s" if kind == "string" else "_rule_i"
            place = len(rows[0][column])
            fillings.append(f"{column}[{place}]" if kind != "int" else f"CAST({column}[{place}] AS INT)")
            for row, value in zip(rows, v, strict=True):
                row[column].append(value)
        residual.append(_filled(conjunct.text, fillings))
    try:
        _with_rule(logs).select(*[F.expr(t).cast("boolean") for t in (*shared, *residual)])
    except AnalysisException:
        return None
    return Shape(shared, keys, residual), rows


def _same_kind(logs: DataFrame, expression: str, kind: str) -> bool:
    """Whether equality with such a constant is equality of the values' texts."""
    try:
        found = logs.select(F.expr(expression)).schema[0].dataType
    except AnalysisException:
        return False
    whole = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
    return isinstance(found, T.StringType) if kind == "string" else isinstance(found, whole)


def build_index(
    logs: DataFrame, rules: dict[tuple, tuple[str, AlertRule]], users: dict[tuple, set[str]]
) -> tuple[RuleIndex | None, set[tuple]]:
    """The index over conditions that share shapes, and the keys of those it settles.

    Where no condition of a shape can be resolved they are left out, and so settled. A shape that is not resolved with
    columns in place of constants is left to be tested condition by condition.
    """
    shapes: list[Shape] = []
    applications: list[list[str]] = []
    rows: list[dict] = []
    order: list[tuple] = []
    bad: set[tuple] = set()
    for readings in by_shape(rules):
        keys = list(readings)
        found = index_shape(logs, list(readings.values()))
        if found is None:
            try:
                logs.select(F.expr(rules[keys[0]][1].query))
            except AnalysisException as error:
                for key in keys:
                    log.error("rule %r of %s is left out: %s", rules[key][1].query, rules[key][0], error)
                bad.update(keys)
            continue
        for key, row in zip(keys, found[1], strict=True):
            number = {"_rule_shape": len(shapes), "_rule_lookback": rules[key][1].lookback, "condition": len(order)}
            rows += [{"_rule_application": a, **number, **row} for a in sorted(users[key])]
            order.append(key)
        shapes.append(found[0])
        applications.append(sorted(set().union(*[users[k] for k in keys])))
    if not shapes:
        return None, bad
    lookback = any(r["_rule_lookback"] is not None for r in rows)
    index = RuleIndex(order, shapes, local_frame(logs.sparkSession, rows, _INDEX), applications, lookback)
    return index, bad.union(order)


def _all(texts: list[str]) -> Column:
    return F.expr(" AND ".join(f"({t})" for t in texts)) if texts else F.lit(True)


def index_hits(logs: DataFrame, index: RuleIndex, *columns) -> DataFrame:
    """One row per (log row, satisfied condition of the index) with the columns asked for, from one scan."""
    names = sorted(set().union(*index.applications))
    emitted = []
    for i, (shape, users) in enumerate(zip(index.shapes, index.applications, strict=True)):
        scope = [] if users == names else [f"application IN ({', '.join(map(_quoted, users))})"]
        values = [F.expr(k).cast("string") for k in shape.keys]
        key = F.array(*values) if values else F.array().cast("array<string>")
        known = [f"({k}) IS NOT NULL" for k in shape.keys]
        emitted.append(F.when(_all(scope + shape.shared + known), F.struct(F.lit(i).alias("shape"), key.alias("key"))))
    # The outer explode keeps the optimizer from testing the shapes once more for a filter on the array's size.
    rows = logs.filter(F.col("application").isin(names))
    rows = rows.withColumn("_row", F.explode_outer(F.array_compact(F.array(*emitted))))
    candidates = rows.join(
        index.rules,
        (F.col("application") == F.col("_rule_application"))
        & (F.col("_row.shape") == F.col("_rule_shape"))
        & (F.col("_row.key") == F.col("_rule_key")),
    )
    rest = None
    for i, shape in enumerate(index.shapes):
        case = F.col("_rule_shape") == i
        rest = F.when(case, _all(shape.residual)) if rest is None else rest.when(case, _all(shape.residual))
    if index.has_lookback:
        back = F.col("eval_ts") - F.make_dt_interval(mins=F.col("_rule_lookback"))
        rest &= F.col("_rule_lookback").isNull() | (F.col("ts") >= back) & (F.col("ts") <= F.col("eval_ts"))
    return candidates.filter(rest).select(*columns, "condition")


def _quoted(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"
