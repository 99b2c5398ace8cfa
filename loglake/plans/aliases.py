"""Aliases as versions that are only ever appended: a reader sees an alias before or after a change, never between."""

from __future__ import annotations

import time

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

VERSIONS = "alias string, collection string, version bigint, members bigint"


def publish_aliases(aliases: DataFrame, path: str, gone: list[str] | None = None, version: int | None = None) -> int:
    """Append a version of every alias in ``aliases`` (alias, collection), and an empty one of those ``gone``.

    Each row says how many make up its alias, so a version counts once all its rows are there. Other aliases stay as
    they are. ``version``, by default the time in nanoseconds, orders changes; writing one again changes nothing.
    """
    spark = aliases.sparkSession
    version = time.time_ns() if version is None else version
    members = F.count("*").over(Window.partitionBy("alias"))
    new = aliases.select("alias", "collection").distinct().withColumn("members", members)
    left = spark.createDataFrame([(a, None, 0) for a in gone or []], "alias string, collection string, members bigint")
    out = new.unionByName(left).withColumn("version", F.lit(version).cast("bigint"))
    out.coalesce(1).write.mode("append").parquet(path)
    return version


def read_alias_versions(spark: SparkSession, path: str) -> DataFrame:
    try:
        return spark.read.schema(VERSIONS).parquet(path)
    except AnalysisException:
        return spark.createDataFrame([], VERSIONS)


def read_aliases(spark: SparkSession, path: str, at: int | None = None) -> DataFrame:
    """``alias, collection`` by the newest complete version of each alias, or the newest up to version ``at``."""
    rows = read_alias_versions(spark, path).distinct()
    rows = rows if at is None else rows.filter(F.col("version") <= at)
    complete = rows.groupBy("alias", "version", "members").agg(F.collect_list("collection").alias("collections"))
    complete = complete.filter(F.size("collections") == F.col("members"))
    newest = complete.groupBy("alias").agg(F.max_by("collections", "version").alias("collections"))
    return newest.select("alias", F.explode("collections").alias("collection"))


def compact_aliases(spark: SparkSession, path: str, to: str) -> None:
    """The current version of every alias, written to a new folder; readers move there when it is complete."""
    publish_aliases(read_aliases(spark, path), to)
