"""Streams over the event table, run to the end of what is there and compared with their batch form."""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import functions as F

from loglake.frames import shared_dir
from loglake.functions.timestamps import timestamp_to_iso
from loglake.operators.rules import triggered
from loglake.operators.windows import rule_counts_by_tick, sliding_counts
from loglake.registry.alerts import TICKS, error_rule, greedy_sql
from loglake.registry.base import LOGS, ORACLES, logs_from_events, query, table
from loglake.schema import COLLECTIONS
from loglake.sources.events import decode_kafka_value
from loglake.streaming.alerts import alert_stream, suppress_stream
from loglake.streaming.ingest import ingest_stream
from loglake.streaming.windows import sliding_count_stream, unique_events

ORIGIN = datetime(2024, 1, 1, tzinfo=timezone.utc)


def log_stream(spark, sf):
    schema = table(spark, sf, "events").schema
    source = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf)
    return logs_from_events(source)


def finish(spark, df, name: str, mode: str = "append"):
    """Run a stream over everything there is into Parquet, and read the result."""
    out, checkpoint = shared_dir(spark, name), shared_dir(spark, f"{name}-checkpoint")
    running = df.writeStream.format("parquet").option("path", f"{out}/data").option("checkpointLocation", checkpoint)
    running.outputMode(mode).trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(df.schema).parquet(f"{out}/data")


def ingest(spark, events, rejects=None):
    """Runs an ingest stream against a stored catalogue that knows no application, and reads what it stored."""
    path, checkpoint = shared_dir(spark, "stream-logs"), shared_dir(spark, "stream-logs-checkpoint")
    catalogues = [spark.createDataFrame([], COLLECTIONS)]
    ingest_stream(
        events, lambda: catalogues[-1], catalogues.append, path, checkpoint, None, clock=lambda: ORIGIN, rejects=rejects
    ).awaitTermination()
    written = spark.read.parquet(path)
    return written.groupBy("application", "collection").agg(F.count("*").alias("n"), F.countDistinct("id").alias("ids"))


@query(
    "t01_ingest_stream",
    f"""WITH {LOGS} SELECT application, application || '_1704067200' AS collection, count(*) AS n,
               count(DISTINCT id) AS ids FROM logs GROUP BY ALL""",
)
def ingest_events(spark, sf):
    events = log_stream(spark, sf).withColumn("timestamp", timestamp_to_iso("ts")).withColumn(
        "properties", F.map_concat("fields", F.create_map(F.lit("hostname"), F.col("hostname")))
    )
    return ingest(spark, events.drop("fields"))


@query(
    "t01_ingest_kafka_values",
    f"""WITH {LOGS} SELECT application, application || '_1704067200' AS collection, count(*) AS n,
               count(DISTINCT id) AS ids FROM logs WHERE version % 9 <> 0 GROUP BY ALL
        UNION ALL SELECT 'rejected', 'rejected', count(*), count(*) FROM logs WHERE version % 9 = 0""",
)
def ingest_kafka_values(spark, sf):
    """JSON values as a topic would hold them, in several micro-batches; every ninth has no readable time."""
    topic, rejects = shared_dir(spark, "topic"), shared_dir(spark, "rejects")
    time = F.when(F.col("version") % 9 == 0, "soon").otherwise(timestamp_to_iso("ts"))
    df = logs_from_events(table(spark, sf, "events")).withColumn("timestamp", time)
    fields = ["id", "application", "category", "timestamp", "level", "message", "threadName", "hostname"]
    df.select(F.to_json(F.struct(*fields)).alias("value")).repartition(3).write.text(topic)
    values = spark.readStream.schema("value string").option("maxFilesPerTrigger", 1).text(topic)
    kept = ingest(spark, decode_kafka_value(values), rejects)
    lost = spark.read.parquet(rejects).agg(F.count("*").alias("n"), F.count("raw").alias("ids"))
    name = F.lit("rejected")
    return kept.unionByName(lost.select(name.alias("application"), name.alias("collection"), "n", "ids"))


# Append mode emits a window once the watermark (newest row minus ten minutes) has passed its end.
CLOSED = "(SELECT epoch(max(ts)) - 600 FROM logs)"


def in_batches(spark, sf, parts: int = 4):
    """The log stream in ``parts`` micro-batches, in order of time."""
    events = table(spark, sf, "events")
    ends = events.agg(F.min("ts").cast("timestamp").alias("lo"), F.max("ts").cast("timestamp").alias("hi")).first()
    path, width = shared_dir(spark, "events"), (ends["hi"] - ends["lo"]) / parts
    for i in range(parts):
        ts = F.col("ts").cast("timestamp")
        of = (ts >= F.lit(ends["lo"] + i * width)) if i else F.lit(True)
        before = (ts < F.lit(ends["lo"] + (i + 1) * width)) if i < parts - 1 else F.lit(True)
        events.filter(of & before).coalesce(1).write.mode("append").parquet(path)
    source = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(path)
    return logs_from_events(source)


def _alerts(retry: int):
    def run(spark, sf):
        path, checkpoint = shared_dir(spark, "alert-stream"), shared_dir(spark, "alert-stream-checkpoint")
        rules = error_rule(retry=retry)
        alert_stream(in_batches(spark, sf), rules, path, checkpoint, interval=None).awaitTermination()
        out = spark.read.parquet(f"{path}/alerts")
        return out.select("application", F.unix_seconds("eval_ts").alias("eval_epoch"), "total_num_found")

    return run


for _retry in (10, 60, 1440):
    query(
        "t02_alert_stream" + (f"_{_retry}" if _retry != 10 else ""),
        f"""WITH RECURSIVE {TICKS}, closed AS (SELECT * FROM ticks WHERE tick * 60 <= (
                SELECT floor((epoch_ms(max(ts)) - 600000) / 1000) FROM logs)),
            {greedy_sql('closed', _retry)}
            SELECT application, tick * 60 AS eval_epoch, n AS total_num_found FROM sent JOIN closed USING (application, tick)""",
    )(_alerts(_retry))


@query(
    "t04_absence_stream",
    f"""WITH {TICKS}, spine AS (SELECT application, epoch(TIMESTAMP '2024-01-01')::BIGINT // 60 + 5 * i AS tick
          FROM (SELECT DISTINCT application FROM logs), range(0, 288 * 30 + 1) AS r(i))
        SELECT application, tick * 60 AS eval_epoch FROM spine s
        WHERE tick * 60 <= {CLOSED} AND NOT EXISTS (SELECT 1 FROM ticks t WHERE t.application = s.application AND t.tick = s.tick)""",
)
def absence_stream(spark, sf):
    """``t04_absence`` up to the watermark: silence every five minutes, in four micro-batches."""
    path, checkpoint = shared_dir(spark, "absence-stream"), shared_dir(spark, "absence-stream-checkpoint")
    alert_stream(
        in_batches(spark, sf), error_rule(-1, retry=4), path, checkpoint, tick="5 minutes", interval=None, since=ORIGIN
    ).awaitTermination()
    out = spark.read.parquet(f"{path}/alerts")
    return out.select("application", F.unix_seconds("eval_ts").alias("eval_epoch"))


@query("t02_suppress_stream", ORACLES["w03_suppress_repeats"])
def stateful_suppression(spark, sf):
    path = shared_dir(spark, "firings")
    firings = triggered(rule_counts_by_tick(logs_from_events(table(spark, sf, "events")), error_rule(), 10))
    firings.write.parquet(path)
    sent = finish(spark, suppress_stream(spark.readStream.schema(firings.schema).parquet(path)), "sent")
    return sent.select("application", F.unix_seconds("eval_ts").alias("eval_epoch"))


@query(
    "t03_sliding_count_stream",
    f"""WITH {LOGS}, panes AS (SELECT application, CAST(floor(epoch(ts) / 60) AS BIGINT) AS pane FROM logs)
        SELECT application, (pane - b) * 60 AS start_epoch, count(*) AS n FROM panes, range(0, 10) AS r(b)
        WHERE (pane - b + 10) * 60 <= {CLOSED} GROUP BY ALL""",
)
def sliding(spark, sf):
    counted = finish(spark, sliding_count_stream(log_stream(spark, sf), ["application"]), "sliding")
    return counted.select("application", F.unix_seconds("start").alias("start_epoch"), "n")


@query(
    "t05_unique_events",
    f"""WITH {LOGS} SELECT application, count(*) + count(*) FILTER (version % 10 = 0) AS n FROM logs GROUP BY application""",
)
def unique(spark, sf):
    """Every event arrives twice; every tenth has no id, and both of its rows stay."""
    twice = log_stream(spark, sf).withColumn("copy", F.explode(F.array(F.lit(1), F.lit(2))))
    twice = twice.withColumn("id", F.when(F.col("version") % 10 != 0, F.col("id")))
    out = finish(spark, unique_events(twice.select("application", "id", "ts")), "unique")
    return out.groupBy("application").agg(F.count("*").alias("n"))


@query(
    "t05_batch_equals_stream",
    f"""WITH {LOGS}, panes AS (SELECT application, CAST(floor(epoch(ts) / 60) AS BIGINT) AS pane FROM logs),
          closed AS (SELECT DISTINCT application, pane - b FROM panes, range(0, 10) AS r(b)
                     WHERE (pane - b + 10) * 60 <= {CLOSED})
        SELECT count(*) AS streamed, count(*) AS batch, 0::BIGINT AS different FROM closed""",
)
def batch_equals_stream(spark, sf):
    """Windows of either side that the watermark has closed, and those whose counts differ or that one side lacks."""
    rows = logs_from_events(table(spark, sf, "events"))
    closed = rows.agg(F.max("ts").alias("newest")).select((F.col("newest") - F.expr("INTERVAL 10 MINUTES")).alias("w"))
    streamed = finish(spark, sliding_count_stream(in_batches(spark, sf), ["application"]), "sliding")
    batch = sliding_counts(rows, ["application"]).filter(F.col("end") <= F.lit(closed.first()["w"]))
    both = streamed.withColumnRenamed("n", "s").join(batch.withColumnRenamed("n", "b"), ["application", "start"], "full")
    return both.agg(
        F.count("s").alias("streamed"), F.count("b").alias("batch"),
        F.count_if(~F.col("s").eqNullSafe(F.col("b"))).alias("different"),
    )
