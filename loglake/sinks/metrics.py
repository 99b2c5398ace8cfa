"""Metrics tables: partitioned by name, day and a hash bucket of the key, insert-only on (table, ts, key, tag)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loglake.operators.metrics import conflicting_metrics, first_metrics, metric_key, new_metrics
from loglake.schema import DEFAULT_METRIC_TABLE

HASH_BUCKETS = 4
PARTITIONS = ["table_name", "day", "bucket"]


def _placed(df: DataFrame) -> DataFrame:
    return df.withColumns(
        {"day": F.to_date("ts"), "bucket": F.pmod(F.xxhash64("key"), F.lit(HASH_BUCKETS)).cast("int")}
    )


def _exists(spark: SparkSession, path: str) -> bool:
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(folder)


def write_metrics(df: DataFrame, path: str, on_conflict: str = "ignore") -> None:
    """Insert readings (``ts`` timestamp, key, tag, value, and ``table_name`` where there are several tables).

    ``on_conflict``: 'ignore' leaves stored readings as they are, 'error' raises and writes nothing. Stored readings
    are looked at on the days that the batch has, and on no day between. An empty batch changes nothing; an existing
    folder that cannot be read as a metrics table is an error.
    """
    if on_conflict not in ("ignore", "error"):
        raise ValueError(f"on_conflict must be 'ignore' or 'error', not {on_conflict!r}")
    spark = df.sparkSession
    batch = df if "table_name" in df.columns else df.withColumn("table_name", F.lit(DEFAULT_METRIC_TABLE))
    days = [r["day"] for r in batch.select(F.to_date("ts").alias("day")).distinct().collect()]
    if not days:
        return
    if _exists(spark, path):
        existing = spark.read.parquet(path).filter(F.col("day").isin(days))
    else:
        existing = spark.createDataFrame([], _placed(batch).schema)
    if on_conflict == "error":
        repeated = batch.groupBy(*metric_key(batch)).count().filter("count > 1")
        if not repeated.isEmpty() or not conflicting_metrics(batch, existing).isEmpty():
            raise ValueError("metric with an existing (table, ts, key, tag)")
    fresh = _placed(new_metrics(first_metrics(batch), existing))
    (
        fresh.hint("rebalance", "day", "bucket")
        .sortWithinPartitions(*PARTITIONS, "ts")
        .write.mode("append")
        .partitionBy(*PARTITIONS)
        .parquet(path)
    )
