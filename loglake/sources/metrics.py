"""Metric sources."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loglake.schema import DEFAULT_METRIC_TABLE, METRIC_REQUEST


def read_metrics(df: DataFrame, json_col: str) -> DataFrame:
    """Metric requests ``{table_name, payload: [...]}`` as one row per reading; ``ts`` comes in microseconds."""
    request = df.select(F.from_json(F.col(json_col), METRIC_REQUEST).alias("r"))
    readings = request.select(F.col("r.table_name").alias("table_name"), F.inline("r.payload"))
    return readings.withColumn("ts", F.timestamp_micros("ts"))


def read_metric_table(
    spark: SparkSession, path: str, first_day: date | None = None, last_day: date | None = None,
    table: str = DEFAULT_METRIC_TABLE,
) -> DataFrame:
    """One stored metrics table, by name; name and day bounds prune partitions."""
    df = spark.read.parquet(path).filter(F.col("table_name") == table)
    if first_day is not None:
        df = df.filter(F.col("day") >= F.lit(first_day))
    if last_day is not None:
        df = df.filter(F.col("day") <= F.lit(last_day))
    return df.select("ts", "key", "tag", "value")
