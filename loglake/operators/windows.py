"""Time windows over logs: sliding counts, rule sweeps over evaluation ticks, absence, timed batches."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loglake.operators.documents import content_hash
from loglake.operators.rules import at_time, condition_hits, index_conditions
from loglake.sources.config import Application

MICROS_PER_MINUTE = 60_000_000
SLOTS = 1000
PREFIX = 3


def _pane(ts: Column | str, pane_us: int) -> Column:
    return F.floor(F.unix_micros(ts) / F.lit(pane_us)).cast("bigint")


def _spread(panes: DataFrame, keys: list[str], count: str, per_window: int | Column) -> DataFrame:
    """Add every pane to each of the ``per_window`` windows that cover it; ``_first`` is a window's first pane."""
    width = F.lit(per_window) if isinstance(per_window, int) else per_window
    return (
        panes.select(*keys, count, F.explode(F.sequence(F.lit(0), width - 1)).alias("_back"), "_pane")
        .groupBy(*keys, (F.col("_pane") - F.col("_back")).alias("_first"))
        .agg(F.sum(count).alias(count))
    )


def sliding_counts(
    logs: DataFrame, keys: list[str], window_minutes: int = 10, slide_minutes: int = 1, ts: str = "ts"
) -> DataFrame:
    """Rows per key and sliding window, windows half-open ``[start, start + window)``.

    Rows are first counted per slide-long pane, in the map tasks; only panes are copied to the windows over them.
    """
    if window_minutes % slide_minutes:
        raise ValueError("the window must be a multiple of the slide")
    slide_us = slide_minutes * MICROS_PER_MINUTE
    panes = logs.groupBy(*keys, _pane(ts, slide_us).alias("_pane")).agg(F.count("*").alias("n"))
    windows = _spread(panes, keys, "n", window_minutes // slide_minutes)
    start = F.timestamp_micros(F.col("_first") * slide_us)
    return windows.select(
        *keys, start.alias("start"), (start + F.expr(f"INTERVAL {window_minutes} MINUTES")).alias("end"), "n"
    )


def evaluation_tick(ts: Column | str, tick_minutes: int = 1) -> Column:
    """The first evaluation that sees a row: rules run once per tick, not per row."""
    tick_us = tick_minutes * MICROS_PER_MINUTE
    return F.timestamp_micros((_pane(ts, tick_us) + 1) * tick_us)


def rule_counts_by_tick(
    logs: DataFrame, applications: list[Application], lookback_minutes: int = 10, tick_minutes: int = 1
) -> DataFrame:
    """What the search rules would have found at every evaluation tick.

    A rule looks back as far as it says itself (``lookback``), else ``lookback_minutes``. One scan for the whole
    sweep. Ticks without a hit are not listed: see ``absence``.
    """
    timed = at_time(logs, F.col("ts"))
    conditions = index_conditions(timed, applications)
    tick_us = tick_minutes * MICROS_PER_MINUTE
    hits = condition_hits(timed, conditions, "application", _pane("ts", tick_us).alias("_pane"))
    keys = ["application", "condition"]
    panes = hits.groupBy(*keys, "_pane").agg(F.count("*").alias("total_num_found"))
    lookbacks = [lookback_minutes if b is None else b for b in conditions.lookbacks]
    per_window = F.get(F.array(*[F.lit(-(-b // tick_minutes)) for b in lookbacks] or [F.lit(1)]), F.col("condition"))
    found = _spread(panes.withColumn("_width", per_window), [*keys, "_width"], "total_num_found", F.col("_width"))
    end = F.timestamp_micros((F.col("_first") + F.col("_width")) * tick_us)
    found = found.select(*keys, end.alias("eval_ts"), "total_num_found")
    return conditions.rules.join(found, keys).drop("condition")


def silent_stretches(
    counts_by_tick: DataFrame, rules: DataFrame, start: datetime, end: datetime, tick_minutes: int = 1
) -> DataFrame:
    """Stretches of ticks in ``[start, end]`` at which an absence rule (threshold -1) found nothing.

    One row (``first_tick``, ``last_tick``) per stretch, from the gaps between successive ticks with a hit: work and
    result grow with the hits and not with rules times ticks.
    """
    keys = ["application", "rule_id"]
    tick = tick_minutes * MICROS_PER_MINUTE
    lo, hi = (F.unix_micros(F.lit(t).cast("timestamp")) for t in (start, end))
    quiet = rules.filter("result_threshold = -1").select(*keys)
    step = F.floor((F.unix_micros("eval_ts") - lo) / tick).cast("bigint")
    last = F.floor((hi - lo) / tick).cast("bigint")
    on_grid = (F.unix_micros("eval_ts") - lo) % tick == 0
    hits = counts_by_tick.filter(on_grid).select(*keys, step.alias("step")).filter((F.col("step") >= 0) & (F.col("step") <= last))
    hits = hits.join(quiet, keys, "left_semi")
    borders = quiet.select(*keys, F.explode(F.array(F.lit(-1).cast("bigint"), last + 1)).alias("step"))
    next_hit = F.lead("step").over(Window.partitionBy(*keys).orderBy("step"))
    gaps = hits.unionByName(borders).withColumn("next", next_hit).filter(F.col("next") > F.col("step") + 1)
    at = lambda n: F.timestamp_micros(lo + n * tick)
    return gaps.select(*keys, at(F.col("step") + 1).alias("first_tick"), at(F.col("next") - 1).alias("last_tick"))


def absence(counts_by_tick: DataFrame, rules: DataFrame, start: datetime, end: datetime, tick_minutes: int = 1):
    """Ticks at which an absence rule found nothing: the silent stretches, tick by tick."""
    stretches = silent_stretches(counts_by_tick, rules, start, end, tick_minutes)
    ticks = F.sequence("first_tick", "last_tick", F.expr(f"INTERVAL {tick_minutes} MINUTES"))
    return stretches.select("application", "rule_id", F.explode(ticks).alias("eval_ts"))


def micro_batches(df: DataFrame, seconds: int = 1, size: int = 1000, key: str = "application") -> DataFrame:
    """Number the batches of each key: a batch closes after ``seconds`` or ``size`` rows, whichever comes first.

    Rows are taken by arrival slot (a thousandth of the batch time), then by hash of the id, then by hash of the
    content, so a row's batch depends on the rows alone. They are ranked in slices of slot and hash prefix; a slice
    starts after the slots before its own and the slices before it in its slot. Both running totals are over counts
    that the map tasks have combined: at most ``SLOTS`` slots, at most ``16 ** PREFIX`` slices of a slot.
    """
    batch_us = seconds * 1_000_000
    at = F.unix_micros("ts")
    content = content_hash(df, ["id"])
    cut = df.withColumns(
        {
            "batch_second": F.floor(at / F.lit(batch_us)).cast("bigint") * F.lit(seconds),
            "_slot": F.floor(F.pmod(at, F.lit(batch_us)) / F.lit(batch_us // SLOTS)).cast("int"),
            "_hash": F.coalesce(F.md5("id"), F.md5(F.to_json(F.struct(*df.columns)))),
            "_content": content,
        }
    ).withColumn("_prefix", F.substring("_hash", 1, PREFIX))
    group = [key, "batch_second"]
    slices = cut.groupBy(*group, "_slot", "_prefix").agg(F.count("*").alias("_n"))
    running = lambda w: F.coalesce(
        F.sum("_n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)
    )
    slots = slices.groupBy(*group, "_slot").agg(F.sum("_n").alias("_n"))
    slots = slots.withColumn("_before", running(Window.partitionBy(*group).orderBy("_slot"))).drop("_n")
    within = running(Window.partitionBy(*group, "_slot").orderBy("_prefix"))
    starts = slices.withColumn("_within", within).drop("_n").join(slots, [*group, "_slot"])
    starts = starts.withColumn("_start", F.col("_before") + F.col("_within")).drop("_before", "_within")
    place = [*group, "_slot", "_prefix"]
    rank = F.row_number().over(Window.partitionBy(*place).orderBy("_hash", "_content"))
    position = F.col("_start") + rank - 1
    numbered = cut.join(starts, place).withColumn("batch_no", F.floor(position / F.lit(size)).cast("bigint"))
    return numbered.drop("_slot", "_prefix", "_hash", "_content", "_start")
