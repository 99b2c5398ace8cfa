"""Stateful alerting on streams."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from datetime import datetime, timezone

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import IntegerType, StructType

from loglake.frames import local_frame
from loglake.operators.rules import at_time, condition_hits, index_conditions
from loglake.operators.suppression import active_suppressions, mark_triggered
from loglake.operators.windows import MICROS_PER_MINUTE
from loglake.plans.alerting import run_round
from loglake.sources.config import Application
from loglake.streaming.windows import with_lateness

SENT = "application string, rule_id string, eval_us bigint"
_WIDTHS = StructType().add("condition", IntegerType()).add("width", IntegerType())
# Timers need the RocksDB state store; it writes a batch's changes, and whole snapshots in the background.
_STORE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
}
STATE = "application string, rule_id string, retry_interval int, last_triggered timestamp"


def suppress_stream(firings: DataFrame, delay: str = "10 minutes") -> DataFrame:
    """Stateful twin of ``suppress_repeats`` for a stream of firings (application, rule_id, retry_interval, eval_ts).

    The state is the last time sent per rule. A firing is one evaluation of one rule, so a group grows with time,
    not with log rows; arrival order counts, as for any state kept across batches. Once the watermark, ``delay`` behind
    the newest firing, has passed the end of a rule's wait, its state goes.
    """

    # Defined here so that it travels by value and executors need not have this package installed.
    def send_unless_waiting(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        rows = pd.concat(list(frames)).sort_values("eval_us")
        last, free = state.get if state.exists else (None, None)
        sent = []
        for row in rows.itertuples(index=False):
            if last is None or row.eval_us >= last + (row.retry_interval + 1) * MICROS_PER_MINUTE:
                last = row.eval_us
                sent.append((*key, row.eval_us))
            free = last + (row.retry_interval + 1) * MICROS_PER_MINUTE
        if free is not None and free // 1000 > state.getCurrentWatermarkMs():
            state.update((last, free))
            state.setTimeoutTimestamp(free // 1000)
        elif state.exists:
            state.remove()
        yield pd.DataFrame(sent, columns=["application", "rule_id", "eval_us"])

    keyed = firings.withWatermark("eval_ts", delay).select(
        "application", "rule_id", "retry_interval", "eval_ts", F.unix_micros("eval_ts").alias("eval_us")
    )
    sent = keyed.groupBy("application", "rule_id").applyInPandasWithState(
        send_unless_waiting, SENT, "last bigint, free bigint", "append", GroupStateTimeout.EventTimeTimeout
    )
    return sent.select("application", "rule_id", F.timestamp_micros("eval_us").alias("eval_ts"))


def rule_timers(tick_us: int) -> StatefulProcessor:
    """Evaluates one rule at every tick that the watermark has passed, from counts per tick, and holds back repeats.

    State of a rule: the counts that later ticks still look back on, the last tick settled, and the last one sent. A
    timer wakes it at the next tick that can change anything, so that windows close, silence is noticed and waits end
    without any row. A rule that nothing looks back on and that does not wait has no state, unless it watches for
    absence (threshold -1).
    """

    # Defined here so that it travels by value and executors need not have this package installed.
    class RuleTimers(StatefulProcessor):
        def init(self, handle: StatefulProcessorHandle) -> None:
            self.handle = handle
            self.state = handle.getValueState(
                "rule",
                "ticks array<bigint>, counts array<bigint>, settled bigint, sent bigint, threshold int, retry int, width int",
            )

        def handleInitialState(self, key, initialState, timerValues) -> None:
            row = initialState.iloc[0]
            first, threshold, retry, width = (int(row[c]) for c in ("first", "threshold", "retry", "width"))
            self.state.update(([], [], first - 1, None, threshold, retry, width))
            self.handle.registerTimer(first * tick_us // 1000)

        def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
            new = pd.concat(list(rows))
            one = new.iloc[0]
            rule = tuple(int(one[c]) for c in ("threshold", "retry", "width"))
            ticks, counts, settled, sent = self.state.get()[:4] if self.state.exists() else ([], [], None, None)
            ticks, counts = [*ticks, *new["tick"].tolist()], [*counts, *new["n"].tolist()]
            yield self.settle(key, ticks, counts, settled, sent, *rule, timerValues.getCurrentWatermarkInMs())

        def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
            if self.state.exists():
                yield self.settle(key, *self.state.get(), timerValues.getCurrentWatermarkInMs())

        def settle(self, key, ticks, counts, settled, sent, threshold, retry, width, watermark) -> pd.DataFrame:
            order = np.argsort(np.array(ticks, np.int64), kind="stable")
            at, n = np.array(ticks, np.int64)[order], np.array(counts, np.int64)[order]
            now = watermark * 1000 // tick_us
            absent = threshold == -1
            begin, end = (0 if settled is None else settled + 1), now + 1
            if not absent:  # it fires only where a count is looked back on
                begin, end = (max(begin, int(at[0])), min(end, int(at[-1]) + width)) if len(at) else (0, 0)
            due = np.arange(begin, max(begin, end))
            total = np.concatenate([[0], np.cumsum(n)])
            found = total[np.searchsorted(at, due, "right")] - total[np.searchsorted(at, due - width, "right")]
            fires = found == 0 if absent else found > threshold
            due_us, found = due[fires] * tick_us, found[fires]
            wait = max(1, (retry + 1) * MICROS_PER_MINUTE)
            alerts = []
            i = 0 if sent is None else int(np.searchsorted(due_us, sent + wait))
            while i < len(due_us):
                sent = int(due_us[i])
                alerts.append((*key, sent, int(found[i])))
                i = int(np.searchsorted(due_us, sent + wait))

            kept = at > now + 1 - width
            waits = sent is not None and sent + wait > (now + 1) * tick_us
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
            if kept.any() or absent or waits:
                settled = now if settled is None else max(now, settled)
                self.state.update((at[kept].tolist(), n[kept].tolist(), settled, sent, threshold, retry, width))
                wake = (settled + 1) * tick_us if kept.any() or absent else sent + wait
                self.handle.registerTimer(-(-wake // 1000))
            elif self.state.exists():
                self.state.clear()
            return pd.DataFrame(alerts, columns=["application", "rule_id", "eval_us", "total_num_found"])

        def close(self) -> None:
            pass

    return RuleTimers()


def alert_stream(
    logs: DataFrame,
    applications: list[Application],
    path: str,
    checkpoint: str,
    lookback: str = "10 minutes",
    tick: str = "1 minute",
    delay: str = "10 minutes",
    interval: str | None = "1 minute",
    since: datetime | None = None,
) -> StreamingQuery:
    """Rules evaluated at every tick of event time, absence rules included, repeats suppressed; alerts go to
    ``{path}/alerts``, exactly once.

    A rule looks back as far as it says itself, else ``lookback``. Rows become counts per (application, condition,
    tick) in the map tasks; those of ticks that the watermark has passed go to the state of each rule that uses the
    condition (``rule_timers``). Absence rules (threshold -1) are watched from ``since`` on, by default from now.
    """
    spark = logs.sparkSession
    tick_us = _micros(tick)
    timed = at_time(logs, F.col("ts"))
    found = index_conditions(timed, applications)
    hits = condition_hits(with_lateness(timed, delay), found, "application", "ts")
    panes = hits.groupBy("application", "condition", F.window("ts", tick).alias("pane")).agg(F.count("*").alias("n"))
    widths = [-(-(_micros(lookback) if b is None else b * MICROS_PER_MINUTE) // tick_us) for b in found.lookbacks]
    width = local_frame(spark, [{"condition": i, "width": w} for i, w in enumerate(widths)], _WIDTHS)
    rules = found.rules.join(width, "condition").select(
        "application", "rule_id", "condition", F.coalesce("result_threshold", F.lit(0)).alias("threshold"),
        F.col("retry_interval").alias("retry"), "width",
    )
    end = F.floor(F.unix_micros("pane.end") / F.lit(tick_us)).cast("bigint")
    counts = panes.withColumns({"at": F.window_time("pane"), "tick": end}).drop("pane")
    counts = counts.join(rules, ["application", "condition"]).drop("condition")
    first = -(-int((since or datetime.now(timezone.utc)).timestamp() * 1_000_000) // tick_us)
    watched = rules.filter("threshold = -1").drop("condition").withColumn("first", F.lit(first))
    sent = counts.groupBy("application", "rule_id").transformWithStateInPandas(
        rule_timers(tick_us), f"{SENT}, total_num_found bigint", "append", "eventTime",
        watched.groupBy("application", "rule_id"),
    )
    sent = sent.withColumn("eval_ts", F.timestamp_micros("eval_us")).drop("eval_us")
    alerts = sent.join(found.rules.drop("condition"), ["application", "rule_id"])
    writer = alerts.writeStream.format("parquet").option("path", f"{path}/alerts").option("checkpointLocation", checkpoint)
    trigger = {"processingTime": interval} if interval else {"availableNow": True}
    # a query keeps the settings that it starts with
    before = {name: spark.conf.get(name, None) for name in _STORE}
    for name, value in _STORE.items():
        spark.conf.set(name, value)
    try:
        return writer.trigger(**trigger).start()
    finally:
        for name, value in before.items():
            spark.conf.unset(name) if value is None else spark.conf.set(name, value)


def _micros(length: str) -> int:
    return pd.Timedelta(length) // pd.Timedelta(microseconds=1)


def read_state(spark: SparkSession, path: str, batch_id: int) -> DataFrame:
    """Suppression state after a batch; empty before the first."""
    if batch_id < 0:
        return spark.createDataFrame([], STATE)
    return spark.read.schema(STATE).parquet(f"{path}/state/batch={batch_id}")


def write_state(state: DataFrame, path: str, batch_id: int) -> None:
    state.write.mode("overwrite").parquet(f"{path}/state/batch={batch_id}")


def forget_state(spark: SparkSession, path: str, batch_id: int) -> None:
    """Remove the state after a batch that is never read again."""
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/state/batch={batch_id}")
    folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


def start_batches(
    df: DataFrame, handle: Callable[[DataFrame, int], None], checkpoint: str, interval: str | None
) -> StreamingQuery:
    trigger = {"processingTime": interval} if interval else {"availableNow": True}
    return df.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint).trigger(**trigger).start()


def alert_rounds(
    ticks: DataFrame,
    read_logs: Callable[[], DataFrame],
    applications: list[Application],
    path: str,
    checkpoint: str,
    send: Callable[[DataFrame], None],
    interval: str | None = "1 minute",
    clock: Callable[[], datetime] | None = None,
    read_counts: Callable[[], DataFrame] | None = None,
) -> StreamingQuery:
    """One alerting round over the stored logs per trigger: absence rules, look-backs and SQL rules included.

    With ``read_counts`` (``read_rollup``) rules are counted from what ingest has rolled up.

    ``ticks`` is any stream, such as a rate source or the log stream itself. State is kept in a folder per batch: a replayed batch starts from
    the same state, and folders that nothing replays go.
    """
    spark = ticks.sparkSession

    def one_round(_: DataFrame, batch_id: int) -> None:
        now = clock() if clock else datetime.now(timezone.utc)
        state = read_state(spark, path, batch_id - 1)
        alerts = run_round(read_logs(), applications, now, state, rollup=read_counts() if read_counts else None)
        write_state(mark_triggered(active_suppressions(state, now), alerts), path, batch_id)
        forget_state(spark, path, batch_id - 2)
        send(alerts)

    return start_batches(ticks, one_round, checkpoint, interval)
