"""Registration of checkable queries, and the log model read from the driver's tables.

Every query has a Spark side (``run(spark, sf_dir)``) and, where SQL can say it, an equivalent statement for a
second engine. ``LOGS`` and its siblings are the SQL twins of the adapters below.
"""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loglake.frames import stored

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

# Fixed evaluation time: just after the newest event of the test tables.
NOW = datetime(2024, 1, 31, tzinfo=timezone.utc)
SQL_NOW = "TIMESTAMP '2024-01-31 00:00:00'"
# Where a session on one machine keeps stage data; nothing is read from a run before.
LOCAL_SHARED = "/tmp/loglake-shared"
WEEK_AGO = datetime(2024, 1, 24, tzinfo=timezone.utc)


def query(name: str, sql: str | None = None):
    """Register ``run`` under ``name``; the session is put on UTC, the time zone of the log model.

    A session on one machine without a ``spark.checkpoint.dir`` gets one; a cluster names its own.
    """

    def register(run):
        def in_utc(spark: SparkSession, sf_dir: str) -> DataFrame:
            spark.conf.set("spark.sql.session.timeZone", "UTC")
            context = spark.sparkContext
            known = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
            if not known and context.master.startswith("local["):
                context.setCheckpointDir(LOCAL_SHARED)
            return run(spark, sf_dir)

        in_utc.__name__ = run.__name__
        in_utc.__doc__ = run.__doc__
        QUERIES[name] = in_utc
        if sql is not None:
            ORACLES[name] = sql.strip()
        return run

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def logs_from_events(events: DataFrame) -> DataFrame:
    """The ``events`` table in the shape of stored logs."""
    thread = F.concat(F.lit("thread-"), (F.col("event_id") % 8).cast("string"))
    is_error = F.col("event_type") == "error"
    return events.select(
        F.col("event_id").cast("string").alias("id"),
        F.concat(F.lit("app-"), (F.col("user_id") % 5).cast("string")).alias("application"),
        F.concat(F.lit("events."), "event_type").alias("category"),
        F.col("ts").cast("timestamp").alias("ts"),
        F.when(is_error, "ERROR").when(F.col("event_type") == "purchase", "WARN").otherwise("INFO").alias("level"),
        F.concat("event_type", F.lit(" by user "), F.col("user_id").cast("string"), F.lit(" "), "props").alias("message"),
        F.concat(F.lit("host"), (F.col("user_id") % 10).cast("string")).alias("hostname"),
        thread.alias("threadName"),
        F.when(is_error, F.concat(F.lit("Exception in thread "), thread)).alias("throwable"),
        F.create_map(F.lit("k_i"), F.get_json_object("props", "$.k")).alias("fields"),
        F.col("event_id").alias("version"),
    )


LOGS = """
logs AS (
  SELECT CAST(event_id AS VARCHAR) AS id, 'app-' || (user_id % 5) AS application,
         'events.' || event_type AS category, ts,
         CASE event_type WHEN 'error' THEN 'ERROR' WHEN 'purchase' THEN 'WARN' ELSE 'INFO' END AS level,
         event_type || ' by user ' || user_id || ' ' || props AS message,
         'host' || (user_id % 10) AS hostname, 'thread-' || (event_id % 8) AS "threadName",
         CASE WHEN event_type = 'error' THEN 'Exception in thread thread-' || (event_id % 8) END AS throwable,
         json_extract_string(props, '$.k') AS k, event_id AS version, user_id
  FROM events)"""


def logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return logs_from_events(table(spark, sf_dir, "events"))


def search_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``documents`` as a full-text corpus: application = source, message = the whole text."""
    return table(spark, sf_dir, "documents").select(
        F.col("doc_id").cast("string").alias("id"), F.col("source").alias("application"),
        F.col("lang").alias("category"), F.col("text").alias("message"),
    )


def metrics_from_events(events: DataFrame) -> DataFrame:
    return events.select(
        F.col("ts").cast("timestamp").alias("ts"), F.col("user_id").cast("string").alias("key"),
        F.col("event_type").alias("tag"), "value",
    )


def with_collections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Logs placed into daily collections per application."""
    from loglake.operators.collections import assign_collection

    return assign_collection(logs(spark, sf_dir), policies(spark, sf_dir))


def collections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The catalogue those collections make up, as a stored table."""
    from loglake.operators.collections import collections_of

    return stored(collections_of(with_collections(spark, sf_dir)), "catalogue")


def policies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A retention policy for most applications seen: some settings left to the defaults, one kept for two days."""
    number = F.substring("application", 5, 9).cast("int")
    return (
        logs(spark, sf_dir)
        .select("application")
        .distinct()
        .filter(number < 4)
        .select(
            "application",
            F.when(number != 0, number + 2).cast("int").alias("num_collections"),
            F.when(number == 3, 2).cast("int").alias("roll_period_days"),
        )
    )


POLICIES = """
policies AS (
  SELECT DISTINCT application,
         CASE WHEN CAST(substr(application, 5) AS INT) <> 0 THEN CAST(substr(application, 5) AS INT) + 2 END
           AS num_collections,
         CASE WHEN CAST(substr(application, 5) AS INT) = 3 THEN 2 END AS roll_period_days
  FROM logs WHERE CAST(substr(application, 5) AS INT) < 4)"""

PLACED = """
firsts AS (
  SELECT application, CAST(floor(epoch(min(ts))) AS BIGINT) AS first_epoch FROM logs GROUP BY application),
placed AS (
  SELECT l.*, f.first_epoch + CAST(floor((floor(epoch(l.ts)) - f.first_epoch)
                / (coalesce(p.roll_period_days, 1) * 86400.0)) AS BIGINT)
              * coalesce(p.roll_period_days, 1) * 86400 AS created_epoch
  FROM logs l JOIN firsts f USING (application) LEFT JOIN policies p USING (application)),
collections AS (
  SELECT DISTINCT application, application || '_' || created_epoch AS collection,
         CAST(created_epoch AS BIGINT) AS created_epoch
  FROM placed)"""

CATALOGUE = f"WITH {LOGS}, {POLICIES}, {PLACED}"
