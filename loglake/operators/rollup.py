"""Stored counts per application, condition and minute, so that an alerting round reads counts instead of logs.

Ingest appends the counts of each batch beside the rows it stores; a round sums the minutes a rule looks back on. Full
minutes are counted: a round at ``now`` sees ``[minute - lookback, minute)`` for the minute that ``now`` lies in.
"""

from __future__ import annotations

import logging
import re
import time
from dataclasses import replace
from datetime import datetime

from py4j.protocol import Py4JJavaError
from pyspark.errors import AnalysisException, PySparkException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loglake.frames import local_frame, stored
from loglake.operators.rules import at_time, condition_hits, index_conditions, search_rules
from loglake.schema import RULES
from loglake.sources.config import Application

log = logging.getLogger(__name__)

PARTITIONS = ["application", "collection", "batch"]
ROLLUP = T.StructType(
    [
        T.StructField("condition_id", T.StringType()),
        T.StructField("minute", T.LongType()),  # minutes since the epoch
        T.StructField("n", T.LongType()),
        T.StructField("application", T.StringType()),
        T.StructField("collection", T.StringType()),
        T.StructField("batch", T.LongType()),
        T.StructField("part", T.IntegerType()),
    ]
)
COVERED = T.StructType(
    [T.StructField("application", T.StringType()), T.StructField("condition_id", T.StringType()), T.StructField("batch", T.LongType())]
)
_RULE_WINDOWS = T.StructType(
    [*RULES.fields, T.StructField("condition_id", T.StringType()), T.StructField("lookback", T.IntegerType())]
)


def _condition_id() -> Column:
    return F.substring(F.sha2("query", 256), 1, 16)


def can_roll_up(applications: list[Application]) -> tuple[list[Application], list[Application]]:
    """The applications with the search rules that counts per minute can answer, and with all others.

    A condition that names the evaluation time, or is a function of it, has no counts of its own.
    """
    fits = {
        (a, r.rule_id)
        for a, r in search_rules(applications)
        if r.predicate is None and not re.search(r"\beval_ts\b", r.query, re.IGNORECASE)
    }
    sides = [
        [replace(a, alert_rules=tuple(r for r in a.alert_rules if ((a.name, r.rule_id) in fits) == side)) for a in applications]
        for side in (True, False)
    ]
    return sides[0], sides[1]


def rollup_counts(logs: DataFrame, applications: list[Application]) -> DataFrame:
    """``application, collection, condition_id, minute, n`` of all conditions that can be rolled up, from one scan.

    A row becomes one small element per condition it satisfies; these are counted in the map tasks.
    """
    fitting, _ = can_roll_up(applications)
    fitting = [replace(a, alert_rules=tuple(replace(r, lookback=None) for r in a.alert_rules)) for a in fitting]
    timed = at_time(logs, F.col("ts"))
    found = index_conditions(timed, fitting)
    minute = F.floor(F.unix_micros("ts") / F.lit(60_000_000)).cast("bigint").alias("minute")
    hits = condition_hits(timed, found, "application", "collection", minute)
    keys = ["application", "collection", "condition", "minute"]
    counts = hits.groupBy(*keys).agg(F.count("*").alias("n"))
    ids = found.rules.select("application", "condition", _condition_id().alias("condition_id")).distinct()
    return counts.join(ids, ["application", "condition"]).select("application", "collection", "condition_id", "minute", "n")


def _counted(logs: DataFrame, applications: list[Application]) -> list[DataFrame]:
    """Stored counts; a rule that fails on the data is found by halving and left out, as in a round."""
    try:
        return [stored(rollup_counts(logs, applications), "counts")]
    except (PySparkException, Py4JJavaError) as error:
        rules = [(a, r) for a in applications for r in a.alert_rules]
        if len(rules) == 1:
            log.error("rule %r of %s is not counted: %s", rules[0][1].query, rules[0][0].name, error)
            return []
        if not rules:
            raise
    middle, halves = len(rules) // 2, []
    for half in (rules[:middle], rules[middle:]):
        kept = {(a.name, r.rule_id) for a, r in half}
        halves.append(
            [replace(a, alert_rules=tuple(r for r in a.alert_rules if (a.name, r.rule_id) in kept)) for a in applications]
        )
    return [df for half in halves for df in _counted(logs, half)]


def write_rollup(logs: DataFrame, applications: list[Application], path: str, batch_id: int) -> None:
    """Append the counts of one batch of stored rows; a replayed batch replaces what it wrote before."""
    for n, counts in enumerate(_counted(logs, applications)):
        out = counts.withColumns({"batch": F.lit(batch_id).cast("bigint"), "part": F.lit(n)})
        out = out.hint("rebalance", "application", "collection").sortWithinPartitions(*PARTITIONS, "minute")
        out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*PARTITIONS, "part").parquet(f"{path}/counts")


def read_rollup(spark: SparkSession, path: str) -> DataFrame:
    """The stored counts; none where nothing has been counted yet."""
    try:
        counts = spark.read.schema(ROLLUP).parquet(f"{path}/counts")
    except AnalysisException:
        return spark.createDataFrame([], ROLLUP)
    finished = _covered(spark, path).select("batch").distinct()
    return counts.filter("batch >= 0").unionByName(counts.filter("batch < 0").join(finished, "batch", "left_semi"))


def _covered(spark: SparkSession, path: str) -> DataFrame:
    try:
        return spark.read.schema(COVERED).parquet(f"{path}/covered")
    except AnalysisException:
        return spark.createDataFrame([], COVERED)


def cover(spark: SparkSession, path: str, logs: DataFrame | None, applications: list[Application]) -> int:
    """Count conditions that are new over the logs stored so far; returns how many there were.

    To be called while no ingest runs, before it starts with these applications. Such counts go to a batch of their
    own, below 0, which is read once it is in the list of what is covered; a run that breaks off leaves one that is not.
    """
    fitting, _ = can_roll_up(applications)
    rows = [{"application": a, "query": r.query} for a, r in search_rules(fitting)]
    schema = T.StructType([T.StructField(c, T.StringType()) for c in ("application", "query")])
    wanted = local_frame(spark, rows, schema).withColumn("condition_id", _condition_id()).distinct()
    new = wanted.join(_covered(spark, path), ["application", "condition_id"], "left_anti").collect()
    if not new:
        return 0
    batch = -time.time_ns()
    if logs is not None:
        named = {(r["application"], r["query"]) for r in new}
        left = [replace(a, alert_rules=tuple(r for r in a.alert_rules if (a.name, r.query) in named)) for a in fitting]
        write_rollup(logs, left, path, batch)
    done = [{"application": r["application"], "condition_id": r["condition_id"], "batch": batch} for r in new]
    local_frame(spark, done, COVERED).coalesce(1).write.mode("append").parquet(f"{path}/covered")
    return len(new)


def rule_windows(spark: SparkSession, applications: list[Application]) -> DataFrame:
    """The rules frame of search rules with the id of each one's condition and its look-back in minutes."""
    rows = [
        {
            "application": a, "rule_id": r.rule_id, "query": r.query, "retry_interval": r.retry_interval,
            "result_threshold": r.result_threshold, "alert_profiles": list(r.alert_profiles),
            "alert_type": r.alert_type, "lookback": r.lookback,
        }
        for a, r in search_rules(applications)
    ]
    return local_frame(spark, rows, _RULE_WINDOWS).withColumn("condition_id", _condition_id())


def evaluate_rollup(rollup: DataFrame, applications: list[Application], now: datetime) -> DataFrame:
    """``evaluate_rules`` from stored counts: no log row is read. Rules without a hit come back with 0.

    The longest look-back bounds the minutes that are read, if every rule has one.
    """
    rules = rule_windows(rollup.sparkSession, applications)
    minute = int(now.timestamp()) // 60
    lookbacks = [r.lookback for _, r in search_rules(applications)]
    counts = rollup.filter(F.col("minute") < minute)
    if lookbacks and None not in lookbacks:
        counts = counts.filter(F.col("minute") >= minute - max(lookbacks))
    # of many conditions and minutes few rows are left before they meet the rules
    counts = counts.groupBy("application", "condition_id", "minute").agg(F.sum("n").alias("n"))
    windows = rules.select("application", "rule_id", "condition_id", "lookback")
    inside = F.col("lookback").isNull() | (F.col("minute") >= minute - F.col("lookback"))
    found = counts.join(windows, ["application", "condition_id"]).filter(inside)
    found = found.groupBy("application", "rule_id").agg(F.sum("n").alias("total_num_found"))
    return (
        rules.drop("condition_id", "lookback")
        .join(found, ["application", "rule_id"], "left")
        .withColumn("total_num_found", F.coalesce("total_num_found", F.lit(0).cast("bigint")))
        .withColumn("eval_ts", F.timestamp_seconds(F.lit(minute * 60)))
    )


def rollup_by_tick(rollup: DataFrame, applications: list[Application], lookback_minutes: int = 10) -> DataFrame:
    """``rule_counts_by_tick`` from stored counts: what the rules would have found at every minute."""
    rules = rule_windows(rollup.sparkSession, applications)
    width = F.coalesce("lookback", F.lit(lookback_minutes))
    counts = rollup.groupBy("application", "condition_id", "minute").agg(F.sum("n").alias("n"))
    spread = counts.join(rules.select("application", "rule_id", "condition_id", width.alias("width")), ["application", "condition_id"])
    spread = spread.withColumn("tick", F.explode(F.sequence(F.col("minute") + 1, F.col("minute") + F.col("width"))))
    found = spread.groupBy("application", "rule_id", "tick").agg(F.sum("n").alias("total_num_found"))
    found = found.withColumn("eval_ts", F.timestamp_seconds(F.col("tick") * 60)).drop("tick")
    return rules.drop("condition_id", "lookback").join(found, ["application", "rule_id"])
