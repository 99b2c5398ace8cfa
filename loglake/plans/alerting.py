"""One alerting round: active applications -> rules -> thresholds -> suppression -> documents -> messages."""

from __future__ import annotations

import logging
from dataclasses import replace
from datetime import datetime
from functools import reduce

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loglake.frames import stored
from loglake.operators.routing import mail_notifications, route_alerts, slack_notifications, unroutable_alerts
from loglake.operators.rollup import can_roll_up, evaluate_rollup
from loglake.operators.rules import evaluate_rules, evaluate_sql_rules, rule_documents, triggered
from loglake.operators.suppression import not_waiting
from loglake.operators.windows import MICROS_PER_MINUTE
from loglake.sources.config import AlertRule, Application, profiles_frame

log = logging.getLogger(__name__)

DOCUMENT_FIELDS = ["id", "category", "timestamp", "level", "message", "threadName", "throwable"]


def active_applications(applications: list[Application], silenced: list[str]) -> list[Application]:
    return [a for a in applications if a.name not in silenced]


def triggered_alerts(
    logs: DataFrame,
    applications: list[Application],
    now: datetime,
    history: DataFrame | None = None,
    fields: list[str] | None = None,
    strict_reference: bool = False,
) -> DataFrame:
    """Search and SQL rules that fire at ``now``, with total and documents.

    A lazy plan of two scans: one counts, one fetches the newest documents per rule.
    """
    found = triggered(evaluate_rules(logs, applications, now), strict_reference)
    documents = rule_documents(logs, applications, now, fields or DOCUMENT_FIELDS)
    alerts = found.join(documents, ["application", "rule_id"], "left")
    if any(r.alert_type == "sql" for a in applications for r in a.alert_rules):
        sql = triggered(evaluate_sql_rules(logs.sparkSession, applications, now), strict_reference)
        alerts = alerts.unionByName(sql)
    alerts = alerts.withColumn(
        "documents", F.coalesce("documents", F.array().cast("array<map<string,string>>"))
    )
    return alerts if history is None else not_waiting(alerts, history)


def who_is_told(logs: DataFrame, applications: list[Application], now: datetime) -> DataFrame:
    """Which applications are above a threshold, and which profiles hear of it. One scan of the logs."""
    fired = triggered(evaluate_rules(logs, applications, now))
    return route_alerts(fired, profiles_frame(logs.sparkSession, applications)).select(
        "application", "rule_id", "total_num_found", "profile", "channel", "targets"
    )


def notifications(alerts: DataFrame, applications: list[Application]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(mail messages, chat posts, alerts without a matching profile)."""
    profiles = profiles_frame(alerts.sparkSession, applications)
    return mail_notifications(alerts, profiles), slack_notifications(alerts, profiles), unroutable_alerts(alerts, profiles)


def run_round(
    logs: DataFrame,
    applications: list[Application],
    now: datetime,
    history: DataFrame | None = None,
    sql_options: dict[str, str] | None = None,
    rollup: DataFrame | None = None,
) -> DataFrame:
    """Alerts of this round, written to the shared folder (``spark.checkpoint.dir``) and read from there.

    Rules that still wait are left out before any scan. The counting scan comes first; the document scan then runs for
    the rules that fired only. If a rule fails on the data, the rules are halved until it is alone, and the others are
    kept.

    With a ``rollup`` (``read_rollup``) the rules it can answer are counted from it, to the last full minute, and no log
    row is read for them but the documents of those that fire.
    """
    due = applications if history is None else without_waiting(applications, now, history)
    return reduce(DataFrame.unionByName, _rounds(logs, due, now, sql_options, rollup))


def without_waiting(applications: list[Application], now: datetime, history: DataFrame) -> list[Application]:
    """The applications with the rules that may fire at ``now``. History has a row per rule, as the applications do."""
    waiting = {(r["application"], r["rule_id"]): r["last_triggered"] for r in _since_epoch(history)}

    def waits(application: str, rule: AlertRule) -> bool:
        last = waiting.get((application, rule.rule_id))
        minutes = None if last is None else (int(now.timestamp() * 1_000_000) - last) // MICROS_PER_MINUTE
        return minutes is not None and minutes <= rule.retry_interval

    return [replace(a, alert_rules=tuple(r for r in a.alert_rules if not waits(a.name, r))) for a in applications]


def _since_epoch(history: DataFrame) -> list:
    last = F.unix_micros("last_triggered").alias("last_triggered")
    return history.select("application", "rule_id", last).collect()


def _rounds(
    logs: DataFrame,
    applications: list[Application],
    now: datetime,
    sql_options: dict[str, str] | None,
    rollup: DataFrame | None,
) -> list[DataFrame]:
    try:
        return [_attempt(logs, applications, now, sql_options, rollup)]
    except (PySparkException, Py4JJavaError) as error:
        rules = [(a, r) for a in applications for r in a.alert_rules]
        if len(rules) <= 1:
            for a, r in rules:
                log.error("rule %r of %s failed: %s", r.query, a.name, error)
            return [_attempt(logs, [], now, sql_options, rollup)] if rules else _raise(error)
    middle = len(rules) // 2
    halves = []
    for half in (rules[:middle], rules[middle:]):
        kept = {id(r) for _, r in half}
        names = {a.name for a, _ in half}
        halves.append(
            [replace(a, alert_rules=tuple(r for r in a.alert_rules if id(r) in kept)) for a in applications if a.name in names]
        )
    return [df for half in halves for df in _rounds(logs, half, now, sql_options, rollup)]


def _raise(error: Exception):
    raise error


def _attempt(
    logs: DataFrame,
    applications: list[Application],
    now: datetime,
    sql_options: dict[str, str] | None,
    rollup: DataFrame | None,
) -> DataFrame:
    spark = logs.sparkSession
    counted, scanned = ([], applications) if rollup is None else can_roll_up(applications)
    found = triggered(evaluate_rules(logs, scanned, now))
    if rollup is not None:
        found = found.unionByName(triggered(evaluate_rollup(rollup, counted, now)))
    found = stored(found, "fired")
    fired = {(r["application"], r["rule_id"]) for r in found.select("application", "rule_id").collect()}
    firing = [
        replace(a, alert_rules=tuple(r for r in a.alert_rules if (a.name, r.rule_id) in fired)) for a in applications
    ]
    documents = rule_documents(logs, firing, now, DOCUMENT_FIELDS)
    alerts = found.join(documents, ["application", "rule_id"], "left")
    alerts = alerts.unionByName(triggered(evaluate_sql_rules(spark, applications, now, sql_options)))
    alerts = alerts.withColumn("documents", F.coalesce("documents", F.array().cast("array<map<string,string>>")))
    return stored(alerts, "alerts")
