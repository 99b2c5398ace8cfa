"""Log event sources. Each yields DataFrames for batch and, given a streaming input, for streams."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loglake.functions.timestamps import timestamp_to_iso
from loglake.schema import JSON_MAP, LOG_EVENT

# Severity words recognised in a text line.
LINE_LEVELS = (
    "alert|trace|debug|notice|info|warning|warn|error|err|critical|crit|fatal|severe|emergency|emerg"
)
LINE_PATTERN = rf"(\d{{2}}/\d{{2}}/\d{{2}} \d{{2}}:\d{{2}}:\d{{2}}) ((?i:{LINE_LEVELS})) (.*?): (.*)$"
LINE_DATE_PATTERN = "yy/MM/dd HH:mm:ss"


def read_log_events(
    spark: SparkSession, path: str, application: str | None = None, streaming: bool = False
) -> DataFrame:
    """One JSON event per line. ``application`` plays the part of the target named by the request."""
    reader = spark.readStream if streaming else spark.read
    df = reader.schema(LOG_EVENT).json(path)
    return df if application is None else df.withColumn("application", F.lit(application))


def explode_event_array(df: DataFrame, json_col: str, application: Column | None = None) -> DataFrame:
    """JSON arrays of events, one row per event. Text that is not such an array yields no rows."""
    events = F.from_json(F.col(json_col), T.ArrayType(LOG_EVENT))
    keep = [] if application is None else [application.alias("_application")]
    out = df.select(*keep, F.inline(events))
    return out if application is None else out.drop("application").withColumnRenamed("_application", "application")


def read_json_maps(df: DataFrame, json_col: str, application: Column) -> DataFrame:
    """JSON arrays of free-form objects, one ``fields`` map per object; an own ``id`` is kept."""
    maps = F.explode(F.from_json(F.col(json_col), T.ArrayType(JSON_MAP)))
    return df.select(application.alias("application"), maps.alias("fields")).withColumn("id", F.col("fields")["id"])


def decode_kafka_value(df: DataFrame, value: str = "value") -> DataFrame:
    """Message bytes or text as a ``fields`` map. The routing key is its field ``application``, '' when absent.

    A value that is not a JSON object has NULL ``fields``: see ``rejected_messages``.
    """
    fields = F.from_json(F.col(value).cast("string"), JSON_MAP)
    return df.select(F.col(value).cast("string").alias("raw"), fields.alias("fields")).withColumn(
        "application", F.coalesce(F.col("fields")["application"], F.lit(""))
    )


def read_kafka_logs(
    spark: SparkSession, servers: str, topic: str, options: dict[str, str] | None = None, streaming: bool = True
) -> DataFrame:
    """Decoded messages of one topic. Needs the Spark Kafka connector on the class path."""
    reader = (spark.readStream if streaming else spark.read).format("kafka")
    raw = reader.option("kafka.bootstrap.servers", servers).option("subscribe", topic).options(**(options or {}))
    return decode_kafka_value(raw.load())


def parse_log_lines(df: DataFrame, application: str, line: str = "value") -> DataFrame:
    """Text lines ``yy/MM/dd HH:mm:ss LEVEL category: message``.

    A line of another shape keeps its text as the message and has NULL in the parsed columns.
    """
    part = lambda i: F.nullif(F.regexp_extract(line, LINE_PATTERN, i), F.lit(""))
    ts = F.try_to_timestamp(part(1), F.lit(LINE_DATE_PATTERN))
    return df.select(
        F.lit(application).alias("application"),
        ts.alias("ts"),
        timestamp_to_iso(ts).alias("timestamp"),
        part(2).alias("level"),
        part(3).alias("category"),
        F.when(F.col(line).rlike(LINE_PATTERN), F.regexp_extract(line, LINE_PATTERN, 4))
        .otherwise(F.col(line))
        .alias("message"),
    )
