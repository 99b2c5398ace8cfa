"""Alert rules over logs: all rules of all applications in one scan.

Rules that share a condition share its evaluation; conditions that share a shape share an expression (``rule_index``). Counts are combined in the map tasks; documents are cut to the
newest few per rule there.
"""

from __future__ import annotations

import logging
from dataclasses import replace
from datetime import datetime
from functools import reduce
from typing import NamedTuple

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loglake.frames import local_frame
from loglake.functions.events import row_as_map
from loglake.functions.predicates import exceeds_threshold
from loglake.functions.timestamps import timestamp_to_iso
from loglake.operators.relevance import relevance_columns, with_relevance
from loglake.operators.rule_index import RuleIndex, build_index, index_hits
from loglake.schema import DEFAULT_ALERT_TYPE, MAX_DOCUMENTS, RULES
from loglake.sources.config import AlertRule, Application, since
from loglake.sources.stored import read_sql_rule

log = logging.getLogger(__name__)

# Conditions of shapes of their own in one expression.
CONDITIONS_PER_SCAN = 200

_INDEXED_RULES = T.StructType([*RULES.fields, T.StructField("condition", T.IntegerType())])


def at_time(logs: DataFrame, now: datetime | Column) -> DataFrame:
    """Logs with the evaluation time as a constant column, which the optimizer folds into the conditions."""
    return logs.withColumn("eval_ts", (now if isinstance(now, Column) else F.lit(now)).cast("timestamp"))


def search_rules(applications: list[Application]) -> list[tuple[str, AlertRule]]:
    return [
        (a.name, r)
        for a in applications
        for r in a.alert_rules
        if (r.alert_type or DEFAULT_ALERT_TYPE) == DEFAULT_ALERT_TYPE
    ]


def _usable(logs: DataFrame, rules: dict[tuple, tuple[str, AlertRule]]) -> dict[tuple, Column]:
    """Conditions that can be resolved on the logs; one that cannot costs its own rule, not the others."""
    try:
        conditions = {key: rule.condition() for key, (_, rule) in rules.items()}
        logs.select(*conditions.values())
        return conditions
    except AnalysisException as error:
        if len(rules) == 1:
            [(application, rule)] = rules.values()
            log.error("rule %r of %s is left out: %s", rule.query, application, error)
            return {}
    # Halves, so that a few bad rules among many take few attempts.
    items = list(rules.items())
    middle = len(items) // 2
    return {**_usable(logs, dict(items[:middle])), **_usable(logs, dict(items[middle:]))}


class Conditions(NamedTuple):
    """Distinct conditions of a rule set: first those of the index, then those of shapes of their own."""

    columns: list[Column]  # of the latter, each with the applications that use it
    users: list[frozenset[str]]
    rules: DataFrame  # the rules frame, with the number of each rule's condition
    applications: list[str]
    lookbacks: list[int | None]  # of each condition, in minutes
    index: RuleIndex | None
    searches: dict[int, str]  # by which the documents of a condition are ranked

    def guarded(self) -> list[Column]:
        """Conditions behind a cheap test of the application, where not every application uses them."""
        application = F.col("application")
        of = lambda u: application == next(iter(u)) if len(u) == 1 else application.isin(sorted(u))
        return [
            c if len(u) == len(self.applications) else of(u) & c
            for c, u in zip(self.columns, self.users, strict=True)
        ]


def index_conditions(logs: DataFrame, applications: list[Application]) -> Conditions:
    rules: dict[tuple, tuple[str, AlertRule]] = {}
    for application, rule in search_rules(applications):
        rules.setdefault(rule.condition_key, (application, rule))
    users: dict[tuple, set[str]] = {}
    for application, rule in search_rules(applications):
        users.setdefault(rule.condition_key, set()).add(application)
    index, settled = build_index(logs, rules, users)
    others = {key: r for key, r in rules.items() if key not in settled}
    by_key = _usable(logs, others) if others else {}
    indexed = index.order if index else []
    number = {key: i for i, key in enumerate([*indexed, *by_key])}
    kept = [(a, r) for a, r in search_rules(applications) if r.condition_key in number]
    rows = [
        {
            "application": application,
            "rule_id": rule.rule_id,
            "query": rule.query,
            "retry_interval": rule.retry_interval,
            "result_threshold": rule.result_threshold,
            "alert_profiles": list(rule.alert_profiles),
            "alert_type": rule.alert_type,
            "condition": number[rule.condition_key],
        }
        for application, rule in kept
    ]
    return Conditions(
        list(by_key.values()),
        [frozenset(users[key]) for key in by_key],
        local_frame(logs.sparkSession, rows, _INDEXED_RULES),
        sorted({a for a, _ in kept}),
        [rules[key][1].lookback for key in number],
        index,
        {i: search for key, i in number.items() if (search := rules[key][1].ranked_by) is not None},
    )


def recent(logs: DataFrame, applications: list[Application]) -> DataFrame:
    """Rows inside a look-back of a rule, when every search rule has one: a bound that reaches the scan."""
    lookbacks = [r.lookback for _, r in search_rules(applications)]
    if not lookbacks or None in lookbacks:
        return logs
    return logs.filter(since(max(lookbacks)) & (F.col("ts") <= F.col("eval_ts")))


def by_lookback(applications: list[Application]) -> list[list[Application]]:
    """The applications once with the rules that look back, and once with the rules that do not.

    A rule without a look-back reads all logs; the others keep their bound on the scan.
    """
    parts = []
    for bounded in (True, False):
        part = [
            replace(a, alert_rules=tuple(r for r in a.alert_rules if (r.lookback is not None) == bounded))
            for a in applications
        ]
        parts.append([a for a in part if a.alert_rules])
    return [p for p in parts if p] or [[]]


def condition_hits(logs: DataFrame, found: Conditions, *columns) -> DataFrame:
    """One row per (log row, satisfied condition) with the columns asked for.

    Applications and look-backs reach the scan as filters. Conditions that share shapes are looked up in the index, in
    one scan however many they are. The others are tested once a row, in one array; the outer explode keeps the
    optimizer from testing them once more for a filter on the array's size. Very many of these are tested in several
    scans, each of the applications (partitions of stored logs) that use its conditions: the time to plan one
    expression grows faster than its length.
    """
    guarded, first = found.guarded(), len(found.lookbacks) - len(found.columns)
    order = sorted(range(len(guarded)), key=lambda i: (-len(found.users[i]), sorted(found.users[i])))
    parts = [] if found.index is None else [index_hits(logs, found.index, *columns)]
    for at in range(0, len(order), CONDITIONS_PER_SCAN):
        part = order[at : at + CONDITIONS_PER_SCAN]
        names = sorted(set().union(*[found.users[i] for i in part]))
        satisfied = F.array_compact(F.array(*[F.when(guarded[i], F.lit(first + i)) for i in part]))
        scoped = logs.filter(F.col("application").isin(names))
        hits = scoped.select(*columns, F.explode_outer(satisfied).alias("condition"))
        parts.append(hits.filter("condition IS NOT NULL"))
    return reduce(DataFrame.unionByName, parts or [logs.filter(F.lit(False)).select(*columns, F.lit(0).alias("condition"))])


def rule_counts(hits: DataFrame) -> DataFrame:
    return hits.groupBy("application", "condition").agg(F.count("*").alias("total_num_found"))


def evaluate_rules(logs: DataFrame, applications: list[Application], now: datetime) -> DataFrame:
    """Rows found by every search rule at ``now``; rules without a hit come back with 0.

    Rules that look back share one bounded scan, the others one full scan. Every condition is tested once a row; a row
    becomes one small (application, condition) pair per condition that it satisfies, and the pairs are counted in the
    map tasks. The plan is the same for any number of rules.
    """
    parts = []
    for part in by_lookback(applications):
        timed = at_time(logs, now)
        found = index_conditions(timed, part)
        counts = rule_counts(condition_hits(recent(timed, part), found, "application"))
        parts.append(found.rules.join(counts, ["application", "condition"], "left").drop("condition"))
    return (
        reduce(DataFrame.unionByName, parts)
        .withColumn("total_num_found", F.coalesce("total_num_found", F.lit(0)))
        .withColumn("eval_ts", F.lit(now).cast("timestamp"))
    )


def evaluate_sql_rules(
    spark: SparkSession, applications: list[Application], now: datetime, options: dict[str, str] | None = None
) -> DataFrame:
    """Rows found by every SQL rule; each is a query of its own.

    ``:eval_ts`` in its text is the evaluation time. With JDBC ``options`` the texts go to that database as they are.
    """
    parts = []
    for a in applications:
        for r in a.alert_rules:
            if r.alert_type != "sql":
                continue
            try:
                found = read_sql_rule(spark, r.query, options, max_rows=None, args={"eval_ts": now})
            except AnalysisException as error:
                log.error("SQL rule %r of %s is left out: %s", r.query, a.name, error)
                continue
            rule = {
                "application": F.lit(a.name),
                "rule_id": F.lit(r.rule_id),
                "query": F.lit(r.query),
                "retry_interval": F.lit(r.retry_interval),
                "result_threshold": F.lit(r.result_threshold).cast("int"),
                "alert_profiles": F.array(*[F.lit(p) for p in r.alert_profiles]),
                "alert_type": F.lit(r.alert_type),
            }
            # One run of the query: its rows are counted, and the first of each partition offered as documents.
            by_number = lambda a, b: F.when(a["_n"] < b["_n"], -1).otherwise(1)
            number = F.col("_n").bitwiseAND(F.lit((1 << 33) - 1))
            offered = F.when(number < MAX_DOCUMENTS, F.struct("_n", row_as_map(found.columns).alias("d")))
            counted = found.withColumn("_n", F.monotonically_increasing_id()).agg(
                F.count("*").alias("total_num_found"), F.array_sort(F.collect_list(offered), by_number).alias("_shown")
            )
            documents = F.transform(F.slice("_shown", 1, MAX_DOCUMENTS), lambda x: x["d"]).alias("documents")
            parts.append(
                counted.select(*[c.alias(n) for n, c in rule.items()], "total_num_found",
                               F.lit(now).cast("timestamp").alias("eval_ts"), documents)
            )
    if not parts:
        extra = "total_num_found bigint, eval_ts timestamp, documents array<map<string,string>>"
        return spark.createDataFrame([], T.StructType([*RULES.fields, *T._parse_datatype_string(extra).fields]))
    return reduce(DataFrame.unionByName, parts)


def cap_documents(hits: DataFrame, n: int = MAX_DOCUMENTS) -> DataFrame:
    """The newest ``n`` rows per (application, condition), cut in every map task before the shuffle; where the hits have
    a ``score``, those with the highest."""
    best = [F.col("score").desc()] if "score" in hits.columns else []
    order = Window.partitionBy("application", "condition").orderBy(*best, F.col("ts").desc(), F.col("id"))
    return hits.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= n)


def rule_documents(
    logs: DataFrame, applications: list[Application], now: datetime, fields: list[str], n: int = MAX_DOCUMENTS
) -> DataFrame:
    """Up to ``n`` matching rows per rule as an array of name -> text maps: the newest, or by relevance if it is asked for.

    ``timestamp`` is the ISO text of ``ts`` where it is no column. Relevance (``ranked_by``) is that among all rows of the application in ``logs``, as for any search.
    """
    parts = []
    for part in by_lookback(applications):
        timed = at_time(logs, now)
        found = index_conditions(timed, part)
        # texts are made of the few rows that are shown, not of all that hit
        raw = F.struct(F.lit(True).alias("_"), *[F.col(f) for f in fields if f in logs.columns]).alias("_raw")
        shown = {f: F.col("_raw")[f] for f in fields if f in logs.columns}
        if "timestamp" in fields and "timestamp" not in shown:
            shown["timestamp"] = timestamp_to_iso("ts")
        extra = relevance_columns(found.searches, "message") if found.searches else []
        hits = condition_hits(recent(timed, part), found, "application", "id", "ts", raw, *extra)
        if found.searches:
            hits = with_relevance(logs, hits, found.searches, "message")
        capped = cap_documents(hits, n).withColumn("document", row_as_map(shown))
        ranked = capped.groupBy("application", "condition").agg(
            F.map_from_entries(F.collect_list(F.struct("rank", "document"))).alias("by_rank")
        )
        documents = F.transform(F.sequence(F.lit(1), F.size("by_rank")), lambda i: F.col("by_rank")[i])
        parts.append(
            found.rules.join(ranked, ["application", "condition"]).select(
                "application", "rule_id", documents.alias("documents")
            )
        )
    return reduce(DataFrame.unionByName, parts)


def triggered(evaluated: DataFrame, strict_reference: bool = False) -> DataFrame:
    """Evaluated rules that fire."""
    return evaluated.filter(
        exceeds_threshold(F.col("total_num_found"), F.col("result_threshold"), strict_reference)
    )
