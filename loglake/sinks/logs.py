"""Stored logs and alert history as partitioned Parquet."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

PARTITIONS = ["application", "collection"]
# Bloom filters on ids, as large as the ids of a row group need: a look-up skips row groups that do not have its id,
# which their ranges of random ids never tell.
ID_FILTERS = {"parquet.bloom.filter.enabled#id": "true", "parquet.bloom.filter.adaptive.enabled": "true"}


def write_logs(df: DataFrame, path: str, mode: str = "append") -> None:
    """Append rows to their collections.

    Rebalancing by partition value lets AQE split a collection that takes a large share of the rows over many tasks
    and merge small ones; rows are sorted by time so that row-group statistics prune time ranges.
    """
    clustered = df.hint("rebalance", *PARTITIONS).sortWithinPartitions(*PARTITIONS, "ts")
    clustered.write.options(**ID_FILTERS).mode(mode).partitionBy(*PARTITIONS).parquet(path)


def stream_logs(
    df: DataFrame, path: str, checkpoint: str, interval: str | None = "1 second"
) -> StreamingQuery:
    """Append a stream to its collections, exactly once; ``interval`` None takes what is there and stops.

    Rows are gathered by collection in as many random shares as the session has shuffle partitions, so a busy
    collection is written by all tasks.
    """
    spread = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    trigger = {"processingTime": interval} if interval else {"availableNow": True}
    # Drawn per row: a hash of the content would keep copies together.
    share = (F.rand(spread) * spread).cast("int")
    return (
        df.repartition(*PARTITIONS, share)
        .writeStream.format("parquet")
        .options(**ID_FILTERS)
        .partitionBy(*PARTITIONS)
        .option("path", path)
        .option("checkpointLocation", checkpoint)
        .outputMode("append")
        .trigger(**trigger)
        .start()
    )


def write_alert_history(alerts: DataFrame, path: str, round_id: str) -> None:
    """Append the alerts of one round, a folder a round; writing a round again replaces it and no other."""
    out = alerts.withColumns({"eval_epoch": F.unix_seconds("eval_ts"), "round": F.lit(round_id)})
    out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("round").parquet(path)


def write_batch(df: DataFrame, path: str, batch_id: int) -> None:
    """Append one micro-batch to its collections; a replayed batch replaces what it wrote before."""
    parts = [*PARTITIONS, "batch"]
    out = df.withColumn("batch", F.lit(batch_id).cast("bigint"))
    clustered = out.hint("rebalance", *PARTITIONS).sortWithinPartitions(*parts, "ts")
    writer = clustered.write.options(**ID_FILTERS, partitionOverwriteMode="dynamic").mode("overwrite")
    writer.partitionBy(*parts).parquet(path)
