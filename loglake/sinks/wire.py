"""Wire formats: event JSON, arrays of events, Kafka messages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from loglake.operators.windows import micro_batches

# Field order of an event on the wire.
WIRE_FIELDS = ["category", "timestamp", "level", "message", "threadName", "throwable", "ndc", "properties", "thrown"]


def event_json(df: DataFrame) -> Column:
    """The wire JSON of a row; absent fields are left out, ``thrown`` is an array in any case."""
    have = [c for c in WIRE_FIELDS if c in df.columns and c != "thrown"]
    thrown = F.col("thrown") if "thrown" in df.columns else F.lit(None)
    stack = F.coalesce(thrown.cast("array<string>"), F.array().cast("array<string>"))
    return F.to_json(F.struct(*have, stack.alias("thrown")))


def to_event_json(df: DataFrame, alias: str = "body") -> DataFrame:
    return df.select("*", event_json(df).alias(alias))


def export_event_arrays(df: DataFrame, seconds: int = 3, size: int = 100) -> DataFrame:
    """Requests of up to ``size`` events per application, each body a JSON array."""
    keys = ["application", "batch_second", "batch_no"]
    batched = micro_batches(to_event_json(df), seconds, size).groupBy(*keys)
    bodies = F.array_sort(F.collect_list(F.struct("ts", "id", "body")))
    joined = F.array_join(F.transform(bodies, lambda e: e["body"]), ",")
    return batched.agg(F.count("*").alias("events"), F.concat(F.lit("["), joined, F.lit("]")).alias("body"))


def kafka_messages(df: DataFrame) -> DataFrame:
    """Each row as one JSON message in column ``value``."""
    return df.select(F.to_json(F.struct("*")).alias("value"))


def write_kafka_json(
    df: DataFrame, servers: str, topic: str, options: dict[str, str] | None = None, checkpoint: str | None = None
) -> StreamingQuery | None:
    """Send rows as JSON to a topic. Needs the Spark Kafka connector on the class path."""
    target = {"kafka.bootstrap.servers": servers, "topic": topic, **(options or {})}
    out = kafka_messages(df)
    if df.isStreaming:
        return out.writeStream.format("kafka").options(**target).option("checkpointLocation", checkpoint).start()
    out.write.format("kafka").options(**target).save()
    return None
