"""Metric sources, sinks and key conflicts."""

from __future__ import annotations

from datetime import date

from pyspark.sql import functions as F

from loglake.frames import shared_dir
from loglake.functions.events import metric_row
from loglake.functions.timestamps import DEFAULT_STRFTIME
from loglake.operators.metrics import conflicting_metrics, first_metrics, new_metrics
from loglake.registry.base import metrics_from_events, query, table
from loglake.sinks.metrics import write_metrics
from loglake.sources.metrics import read_metric_table, read_metrics

METRICS = """metrics AS (SELECT epoch_us(ts) AS ts_us, CAST(user_id AS VARCHAR) AS key, event_type AS tag, value, ts FROM events)"""


def metrics(spark, sf):
    return metrics_from_events(table(spark, sf, "events"))


@query(
    "s05_read_metrics",
    f"""WITH {METRICS} SELECT 'load_' || tag AS table_name, ts_us, key, tag, value FROM metrics
        UNION ALL SELECT 'load_' || tag, ts_us + 1, key, 'count', 1.0 FROM metrics""",
)
def read_requests(spark, sf):
    # Every request carries two readings.
    at = F.unix_micros("ts")
    reading = F.struct(at.alias("ts"), "key", "tag", "value")
    count = F.struct((at + 1).alias("ts"), "key", F.lit("count").alias("tag"), F.lit(1.0).alias("value"))
    request = F.struct(F.concat(F.lit("load_"), "tag").alias("table_name"), F.array(reading, count).alias("payload"))
    requests = metrics(spark, sf).select(F.to_json(request).alias("body"))
    return read_metrics(requests, "body").withColumn("ts_us", F.unix_micros("ts")).drop("ts")


@query(
    "s12_read_metric_table",
    f"""WITH {METRICS} SELECT key, tag, count(*) AS n, CAST(round(sum(value) * 100) AS BIGINT) AS cents FROM metrics
        WHERE ts >= TIMESTAMP '2024-01-10' AND ts < TIMESTAMP '2024-01-21' GROUP BY key, tag""",
)
def read_table(spark, sf):
    path = shared_dir(spark, "metrics")
    write_metrics(metrics(spark, sf), path)
    stored = read_metric_table(spark, path, date(2024, 1, 10), date(2024, 1, 20))
    return stored.groupBy("key", "tag").agg(
        F.count("*").alias("n"), F.round(F.sum("value") * 100).cast("bigint").alias("cents")
    )


@query(
    "k04_two_tables",
    f"""WITH {METRICS} SELECT 'cpu' AS table_name, ts_us, key, tag, value FROM metrics
        UNION ALL SELECT 'mem', ts_us, key, tag, value * 2 FROM metrics""",
)
def two_tables(spark, sf):
    """Requests for two tables with the same keys, written as they are read, and each table read back."""
    path = shared_dir(spark, "metrics")
    for name, factor in (("cpu", 1), ("mem", 2)):
        reading = F.struct(F.unix_micros("ts").alias("ts"), "key", "tag", (F.col("value") * factor).alias("value"))
        request = F.struct(F.lit(name).alias("table_name"), F.array(reading).alias("payload"))
        write_metrics(read_metrics(metrics(spark, sf).select(F.to_json(request).alias("body")), "body"), path)
    tables = [read_metric_table(spark, path, table=n).withColumn("table_name", F.lit(n)) for n in ("cpu", "mem")]
    return tables[0].unionByName(tables[1]).select(
        "table_name", F.unix_micros("ts").alias("ts_us"), "key", "tag", "value"
    )


@query(
    "p19_metric_row",
    f"WITH {METRICS} SELECT key, tag, value, ts_us AS ts FROM metrics UNION ALL SELECT key, tag, 1.0, ts_us FROM metrics",
)
def metric_rows(spark, sf):
    m = metrics(spark, sf)
    text = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    by_time = m.select(*metric_row(F.col("key").cast("int"), F.col("tag"), F.col("value"), F.col("ts")))
    return by_time.unionByName(m.select(*metric_row(F.col("key"), F.col("tag"), F.lit(1), text, DEFAULT_STRFTIME)))


# A batch that sends the readings of errors twice (same key, higher value) and meets a table that already holds the
# first half of the month.
BATCH = f"""{METRICS}, batch AS (SELECT ts_us, key, tag, value FROM metrics
      UNION ALL SELECT ts_us, key, tag, value + 1 FROM metrics WHERE tag = 'error'),
  stored AS (SELECT * FROM metrics WHERE ts < TIMESTAMP '2024-01-16')"""


def batch_and_stored(spark, sf):
    readings = metrics(spark, sf)
    again = readings.filter("tag = 'error'").withColumn("value", F.col("value") + 1)
    return readings.unionByName(again), readings.filter("ts < TIMESTAMP '2024-01-16'")


@query(
    "k04_write_metrics",
    f"""WITH {METRICS} SELECT ts_us, key, tag, value + CASE WHEN ts < TIMESTAMP '2024-01-16' THEN 0.5 ELSE 0 END AS value
        FROM metrics""",
)
def write_twice(spark, sf):
    path = shared_dir(spark, "metrics")
    batch, stored = batch_and_stored(spark, sf)
    write_metrics(stored.withColumn("value", F.col("value") + 0.5), path)
    write_metrics(batch, path)
    return read_metric_table(spark, path).select(F.unix_micros("ts").alias("ts_us"), "key", "tag", "value")


@query(
    "j06_new_metrics",
    f"""WITH {BATCH}, first AS (SELECT ts_us, key, tag, min(value) AS value FROM batch GROUP BY ALL)
        SELECT ts_us, key, tag, value FROM first f WHERE NOT EXISTS (SELECT 1 FROM stored s
          WHERE s.ts_us = f.ts_us AND s.key = f.key AND s.tag = f.tag)""",
)
def insert_only(spark, sf):
    batch, stored = batch_and_stored(spark, sf)
    return new_metrics(first_metrics(batch), stored).select(F.unix_micros("ts").alias("ts_us"), "key", "tag", "value")


@query(
    "j06_conflicting_metrics",
    f"""WITH {BATCH} SELECT tag, count(*) AS conflicts FROM batch b WHERE EXISTS (SELECT 1 FROM stored s
          WHERE s.ts_us = b.ts_us AND s.key = b.key AND s.tag = b.tag) GROUP BY tag""",
)
def conflicts(spark, sf):
    batch, stored = batch_and_stored(spark, sf)
    return conflicting_metrics(batch, stored).groupBy("tag").agg(F.count("*").alias("conflicts"))
