"""From triggered alerts to profiles and notification texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loglake.schema import MAX_DOCUMENTS

# Line layout of a notification. `{brand}` names the sender.
SUBJECT = "{brand} alert triggered for '%s'"
BODY_HEAD = (
    "  '%s' Application triggered a {brand} alert.\n"
    "\n"
    "  Application Name: %s\n"
    "  Query: %s\n"
    "  Displaying %s results of %s total found:\n"
    "\n"
    "  "
)
BODY_FIELDS = [
    ("ID", "id"),
    ("Category", "category"),
    ("Timestamp", "timestamp"),
    ("Level", "level"),
    ("Message", "message"),
    ("Thread Name", "threadName"),
    ("Throwable", "throwable"),
]
RULER = "-" * 45
DEFAULT_BRAND = "Log"


def drop_silenced(applications: DataFrame, silenced: DataFrame) -> DataFrame:
    return applications.join(silenced.select("application"), "application", "left_anti")


def alerts_by_profile(alerts: DataFrame) -> DataFrame:
    return alerts.withColumn("profile", F.explode("alert_profiles"))


def group_alerts(alerts: DataFrame) -> DataFrame:
    """Alerts per (application, profile). One group holds at most one entry per rule and evaluation."""
    return alerts_by_profile(alerts).groupBy("application", "profile").agg(
        F.count("*").alias("alerts"), F.array_sort(F.collect_list("rule_id")).alias("rule_ids")
    )


def route_alerts(alerts: DataFrame, profiles: DataFrame) -> DataFrame:
    """Every alert with each mail and chat profile of its application that it names."""
    target = profiles.select("application", F.col("name").alias("profile"), "channel", "targets")
    return alerts_by_profile(alerts).join(target, ["application", "profile"])


def unroutable_alerts(alerts: DataFrame, profiles: DataFrame) -> DataFrame:
    """Alerts naming a profile their application does not have. They do not hold up the others."""
    target = profiles.select("application", F.col("name").alias("profile"))
    return alerts_by_profile(alerts).join(target, ["application", "profile"], "left_anti")


def alert_subject(application: Column | str = "application", brand: str = DEFAULT_BRAND) -> Column:
    return F.format_string(SUBJECT.replace("{brand}", brand), application)


def alert_body(
    application: Column | str = "application",
    query: Column | str = "query",
    documents: Column | str = "documents",
    total: Column | str = "total_num_found",
    max_docs: int = MAX_DOCUMENTS,
    brand: str = DEFAULT_BRAND,
) -> Column:
    """Notification text: head, counts, then seven lines per document; a missing field prints as nothing."""
    as_col = lambda c: F.col(c) if isinstance(c, str) else c
    shown = F.slice(F.coalesce(as_col(documents), F.array().cast("array<map<string,string>>")), 1, max_docs)
    lines = lambda d: F.concat(
        *[F.concat(F.lit(f"\n      {label}: "), F.coalesce(d[name], F.lit(""))) for label, name in BODY_FIELDS]
    )
    head = F.format_string(
        BODY_HEAD.replace("{brand}", brand),
        application, application, query, F.size(shown).cast("string"), as_col(total).cast("string"),
    )
    return F.concat(head, F.array_join(F.transform(shown, lines), "\n"))


def mail_notifications(alerts: DataFrame, profiles: DataFrame, brand: str = DEFAULT_BRAND) -> DataFrame:
    """One message per (alert, mail profile), to all its addresses."""
    return route_alerts(alerts, profiles.filter("channel = 'mail'")).select(
        "application", "rule_id", "profile", "targets",
        alert_subject(brand=brand).alias("subject"), alert_body(brand=brand).alias("body"),
    )


def slack_notifications(alerts: DataFrame, profiles: DataFrame, brand: str = DEFAULT_BRAND) -> DataFrame:
    """One JSON post per (alert, chat profile)."""
    text = F.concat(alert_subject(brand=brand), alert_body(brand=brand), F.lit(f"\n{RULER}"))
    return route_alerts(alerts, profiles.filter("channel = 'slack'")).select(
        "application", "rule_id", "profile", F.element_at("targets", 1).alias("url"),
        F.to_json(F.struct(text.alias("text"))).alias("payload"),
    )
