"""Late data and sliding counts on streams."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def with_lateness(df: DataFrame, delay: str = "10 minutes", ts: str = "ts") -> DataFrame:
    """Accept rows up to ``delay`` late; later ones are not counted."""
    return df.withWatermark(ts, delay)


def unique_events(df: DataFrame, delay: str = "10 minutes") -> DataFrame:
    """First arrival of every id within the lateness bound; rows without an id are all kept.

    Copies of an id are thinned out in random shares first, as many as there are shuffle partitions, so that an id
    sent over and over does not reach one task with all its copies.
    """
    shares = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keyed = with_lateness(df, delay).withColumns(
        {"_key": F.coalesce("id", F.concat(F.lit("no id "), F.uuid())), "_share": (F.rand(shares) * shares).cast("int")}
    )
    thinned = keyed.dropDuplicatesWithinWatermark(["_key", "_share"])
    return thinned.dropDuplicatesWithinWatermark(["_key"]).drop("_key", "_share")


def pane_counts(counted: DataFrame, keys: list[str], window: str, slide: str, n: str = "n") -> DataFrame:
    """Sliding windows over a stream of rows with a watermark on ``ts``: ``keys``, the window ``w``, and the count.

    Rows are counted in slide-long panes first, combined in the map tasks; only panes are copied to the windows.
    """
    panes = counted.groupBy(*keys, F.window("ts", slide).alias("_pane")).agg(F.count("*").alias(n))
    at = F.window(F.window_time("_pane"), window, slide).alias("w")
    return panes.groupBy(*keys, at).agg(F.sum(n).alias(n))


def sliding_count_stream(
    logs: DataFrame, keys: list[str], window: str = "10 minutes", slide: str = "1 minute", delay: str = "10 minutes"
) -> DataFrame:
    """Rows per key and half-open sliding window."""
    counted = pane_counts(with_lateness(logs, delay), keys, window, slide)
    return counted.select(*keys, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")
