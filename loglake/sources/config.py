"""Alerting and retention configuration: driver-side objects and their DataFrames."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loglake.frames import local_frame
from loglake.schema import (
    ALERT_TYPES,
    DEFAULT_ALERT_TYPE,
    DEFAULT_NUM_COLLECTIONS,
    DEFAULT_ROLL_PERIOD_DAYS,
    POLICIES,
    PROFILES,
    RULES,
)


@dataclass(frozen=True)
class AlertRule:
    """One rule of an application.

    ``query`` is a Spark SQL condition over the log columns and ``eval_ts`` (the evaluation time), or, for type
    'sql', a full query. ``predicate`` may replace the condition by a function from ``eval_ts`` to a Column;
    ``query`` is then the text shown in notifications. ``lookback`` (minutes) limits the rule to
    ``[eval_ts - lookback, eval_ts]``; when all rules have one, the longest prunes the scan. ``ranked_by``, the words of
    a search over the message, ranks the documents shown by relevance; without it they are the newest.
    """

    query: str
    retry_interval: int
    alert_profiles: tuple[str, ...]
    result_threshold: int | None = None
    alert_type: str | None = None
    lookback: int | None = None
    predicate: Callable[[Column], Column] | None = field(default=None, compare=False)
    ranked_by: str | None = None

    @property
    def rule_id(self) -> str:
        """Identity of a rule is its whole content."""
        content = [self.query, self.retry_interval, self.result_threshold, list(self.alert_profiles), self.alert_type]
        content += [] if self.lookback is None else [self.lookback]
        content += [] if self.ranked_by is None else [{"rankedBy": self.ranked_by}]
        return hashlib.sha256(json.dumps(content).encode()).hexdigest()[:16]

    @property
    def condition_key(self) -> tuple:
        """Rules with equal keys have the same condition, and the same order of their documents."""
        return (self.predicate or self.query, self.lookback, self.ranked_by)

    def condition(self) -> Column:
        hit = self.predicate(F.col("eval_ts")) if self.predicate else F.expr(self.query)
        return hit if self.lookback is None else hit & since(self.lookback) & (F.col("ts") <= F.col("eval_ts"))


def since(lookback_minutes: int) -> Column:
    return F.col("ts") >= F.col("eval_ts") - F.expr(f"INTERVAL {int(lookback_minutes)} MINUTES")


@dataclass(frozen=True)
class Application:
    name: str
    alert_rules: tuple[AlertRule, ...]
    email_profiles: tuple[tuple[str, tuple[str, ...]], ...] = ()
    slack_profiles: tuple[tuple[str, str], ...] = ()


def read_config(path: str) -> dict:
    """A configuration file of the driver: YAML where PyYAML is there, JSON in any case."""
    with open(path) as file:
        text = file.read()
    try:
        import yaml
    except ImportError:
        return json.loads(text)
    return yaml.safe_load(text)


def parse_applications(config: dict) -> list[Application]:
    """Applications of a nested configuration (parsed YAML or JSON). An unknown alert type raises."""
    out = []
    for app in config["applications"]:
        rules = []
        for r in app["alertRules"]:
            if r.get("alertType") is not None and r["alertType"] not in ALERT_TYPES:
                raise ValueError(f"unknown alert type in rule {r}")
            rules.append(
                AlertRule(r["query"], int(r["retryInterval"]), tuple(r["alertProfiles"]),
                          r.get("resultThreshold"), r.get("alertType"), r.get("lookback"), ranked_by=r.get("rankedBy"))
            )
        mails = tuple((p["name"], tuple(p["addresses"])) for p in app.get("emailProfiles") or [])
        slacks = tuple((p["name"], p["url"]) for p in app.get("slackProfiles") or [])
        out.append(Application(app["name"], tuple(rules), mails, slacks))
    return out


def rules_frame(spark: SparkSession, applications: list[Application]) -> DataFrame:
    rows = [
        {
            "application": a.name,
            "rule_id": r.rule_id,
            "query": r.query,
            "retry_interval": r.retry_interval,
            "result_threshold": r.result_threshold,
            "alert_profiles": list(r.alert_profiles),
            "alert_type": r.alert_type,
        }
        for a in applications
        for r in a.alert_rules
    ]
    return local_frame(spark, rows, RULES)


def profiles_frame(spark: SparkSession, applications: list[Application]) -> DataFrame:
    rows = []
    for a in applications:
        rows += [
            {"application": a.name, "channel": "mail", "name": name, "targets": list(addresses)}
            for name, addresses in a.email_profiles
        ]
        rows += [
            {"application": a.name, "channel": "slack", "name": name, "targets": [url]}
            for name, url in a.slack_profiles
        ]
    return local_frame(spark, rows, PROFILES)


def explode_config(configs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Configuration documents kept in a table, as (rules, profiles).

    ``configs`` has columns ``application``, ``rules`` (array of rule structs), ``mail`` (array of name,
    addresses) and ``slack`` (array of name, url).
    """
    rules = configs.select("application", F.inline("rules"))
    mail = configs.select("application", F.lit("mail").alias("channel"), F.inline("mail")).toDF(*PROFILES.fieldNames())
    slack = (
        configs.select("application", F.lit("slack").alias("channel"), F.inline("slack"))
        .toDF(*PROFILES.fieldNames())
        .withColumn("targets", F.array("targets"))
    )
    return rules, mail.unionByName(slack)


def policies_frame(spark: SparkSession, config: dict) -> DataFrame:
    """Retention settings of every application, defaults filled in."""
    rows = [
        {"application": a["name"], "num_collections": a.get("numCollections"), "roll_period_days": a.get("rollPeriod")}
        for a in config["applications"]
    ]
    return with_policy_defaults(local_frame(spark, rows, POLICIES))


def with_policy_defaults(policies: DataFrame) -> DataFrame:
    return policies.withColumns(
        {
            "num_collections": F.coalesce("num_collections", F.lit(DEFAULT_NUM_COLLECTIONS)),
            "roll_period_days": F.coalesce("roll_period_days", F.lit(DEFAULT_ROLL_PERIOD_DAYS)),
        }
    )


def read_silenced(spark: SparkSession, path: str) -> DataFrame:
    """Application names, one per line; a missing file means nobody is silenced."""
    try:
        lines = spark.read.text(path)
    except AnalysisException:
        lines = spark.createDataFrame([], "value string")
    name = F.trim("value")
    return lines.select(name.alias("application")).filter(F.col("application") != "")


def with_alert_type(rules: DataFrame) -> DataFrame:
    return rules.withColumn("alert_type", F.coalesce("alert_type", F.lit(DEFAULT_ALERT_TYPE)))


def rules_of_type(rules: DataFrame, alert_type: str) -> DataFrame:
    """Rules a trigger of this type handles; untyped rules are search rules."""
    return with_alert_type(rules).filter(F.col("alert_type") == alert_type)


def distinct_alert_types(rules: DataFrame) -> DataFrame:
    return with_alert_type(rules).select("alert_type").distinct()


def unknown_alert_types(rules: DataFrame) -> DataFrame:
    """Types no trigger handles. The known ones are a fixed list, so a filter does the set difference."""
    return distinct_alert_types(rules).filter(~F.col("alert_type").isin(ALERT_TYPES))


def applications_without_profiles(applications: DataFrame, profiles: DataFrame) -> DataFrame:
    return applications.select("application").distinct().join(profiles, "application", "left_anti")


def validate_profiles(applications: DataFrame, profiles: DataFrame) -> None:
    bad = applications_without_profiles(applications, profiles).take(1)
    if bad:
        raise ValueError(f"application without mail or slack profile: {bad[0]['application']}")
