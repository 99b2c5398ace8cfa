"""Suppression of repeated alerts and the state that drives it."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loglake.functions.predicates import inside_wait_period
from loglake.operators.windows import MICROS_PER_MINUTE

_NEVER = -(2**62)
_GROUP = ["application", "rule_id", "retry_interval"]


def suppress_repeats(firings: DataFrame, history: DataFrame | None = None, block_minutes: int = 1440) -> DataFrame:
    """The firings that are sent: after one is, the rule is skipped while it is inside its wait period.

    ``firings`` has application, rule_id, retry_interval and eval_ts: evaluation instants, of which a rule has at most
    one per tick (``evaluation_tick`` gives the one for a log row). ``history`` may give ``last_triggered`` per
    (application, rule_id): firings inside that wait are dropped first, and the rest is settled as if there had been
    none before.

    Whether a firing is sent depends on the last one sent, back to the first. To keep one busy rule from becoming
    one task, its time line is cut into blocks. Per block the operator works out, for every firing that can be the
    first one sent in it, which is the last one sent in it. These short tables alone are chained per rule; the
    first firing they fix for every block then settles the block's own list in parallel.
    """
    if history is not None:
        firings = not_waiting(firings, history)
    block_us = block_minutes * MICROS_PER_MINUTE
    wait = (F.col("retry_interval").cast("bigint") + 1) * MICROS_PER_MINUTE
    t = F.unix_micros("eval_ts")
    blocks = (
        firings.groupBy(*_GROUP, F.floor(t / F.lit(block_us)).cast("bigint").alias("block"))
        .agg(F.collect_set(t).alias("times"))
        .withColumn("times", F.array_sort("times"))
    )

    # The previous firing lies before the block, so its wait ends before block start + wait.
    settled = F.col("block") * block_us + wait
    first_ones = F.concat(
        F.filter("times", lambda x: x < settled), F.slice(F.filter("times", lambda x: x >= settled), 1, 1)
    )
    last_sent = lambda first: F.aggregate(
        "times", first, lambda last, x: F.when(x >= last + wait, x).otherwise(last)
    )
    tables = blocks.select(
        *_GROUP, "block", F.transform(first_ones, lambda x: F.struct(x.alias("first"), last_sent(x).alias("last"))).alias("table")
    )

    chains = tables.groupBy(*_GROUP).agg(F.array_sort(F.collect_list(F.struct("block", "table"))).alias("chain"))
    start = F.struct(
        F.lit(_NEVER).cast("bigint").alias("last"), F.array().cast("array<struct<block:bigint,first:bigint>>").alias("firsts")
    )

    def step(state: Column, b: Column) -> Column:
        sent = F.get(F.filter(b["table"], lambda x: x["first"] >= state["last"] + wait), F.lit(0))
        entry = F.struct(b["block"].alias("block"), sent["first"].alias("first"))
        return F.when(
            sent.isNotNull(),
            F.struct(sent["last"].alias("last"), F.concat(state["firsts"], F.array(entry)).alias("firsts")),
        ).otherwise(state)

    firsts = chains.select(*_GROUP, F.inline(F.aggregate("chain", start, step)["firsts"]))

    begin = F.struct(F.col("first").alias("last"), F.array("first").alias("sent"))
    extend = lambda s, x: F.when(
        x >= s["last"] + wait, F.struct(x.alias("last"), F.concat(s["sent"], F.array(x)).alias("sent"))
    ).otherwise(s)
    sent = firsts.join(blocks, [*_GROUP, "block"]).select(
        *_GROUP, F.explode(F.aggregate("times", begin, extend)["sent"]).alias("sent")
    )
    return sent.select(*_GROUP, F.timestamp_micros("sent").alias("eval_ts"))


def not_waiting(evaluated: DataFrame, history: DataFrame) -> DataFrame:
    """Evaluated rules whose wait period is over at their ``eval_ts``."""
    last = history.select("application", "rule_id", "last_triggered")
    joined = evaluated.join(last, ["application", "rule_id"], "left")
    waiting = inside_wait_period(F.col("last_triggered"), F.col("eval_ts"), F.col("retry_interval"))
    return joined.filter(~waiting).drop("last_triggered")


def mark_triggered(state: DataFrame, fired: DataFrame) -> DataFrame:
    """State after these firings: the newest replaces the entry of its rule, new rules are added."""
    keys = ["application", "rule_id"]
    new = fired.select(*keys, "retry_interval", F.col("eval_ts").alias("last_triggered"), F.lit(1).alias("_new"))
    both = state.select(*keys, "retry_interval", "last_triggered", F.lit(0).alias("_new")).unionByName(new)
    newest = F.struct("_new", "last_triggered")
    return both.groupBy(*keys).agg(
        F.max_by("retry_interval", newest).alias("retry_interval"),
        F.max_by("last_triggered", newest).alias("last_triggered"),
    )


def active_suppressions(state: DataFrame, now: datetime) -> DataFrame:
    """State entries that still hold their rule back at ``now``."""
    at = F.lit(now).cast("timestamp")
    return state.filter(inside_wait_period(F.col("last_triggered"), at, F.col("retry_interval")))
