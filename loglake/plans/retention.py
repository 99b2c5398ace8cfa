"""Retention: open, roll, retire and delete collections. Plans are DataFrames; only ``expire`` deletes files."""

from __future__ import annotations

from datetime import datetime
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loglake.functions.naming import collection_name
from loglake.operators.collections import (
    collection_exists,
    retired_collections,
    should_roll,
)


class Roll(NamedTuple):
    collections: DataFrame  # the catalogue afterwards: what the aliases are built from
    opened: DataFrame
    retired: DataFrame


def _open(applications: DataFrame, now: datetime) -> DataFrame:
    epoch = F.lit(int(now.timestamp())).cast("bigint")
    return applications.select(
        "application", collection_name("application", epoch).alias("collection"), epoch.alias("created_epoch")
    )


def initialize_applications(policies: DataFrame, collections: DataFrame, now: datetime) -> DataFrame:
    """The catalogue with a first collection for every application that has none."""
    new = policies.select("application").join(collections, "application", "left_anti")
    return collections.unionByName(_open(new, now))


def open_missing(collections: DataFrame, applications: DataFrame, now: datetime) -> DataFrame:
    """The catalogue with a first collection for every application with rows that has none."""
    return initialize_applications(applications.select("application").distinct(), collections, now)


def roll(policies: DataFrame, collections: DataFrame, now: datetime) -> Roll:
    """Open a collection for every due application, then retire its collections beyond the newest N.

    Applications that are not due keep what they have, also when they hold more than N.
    """
    due = should_roll(collections, policies, now)
    opened = _open(due, now).join(collections, "collection", "left_anti").select(*collections.columns)
    everything = collections.unionByName(opened)
    retired = retired_collections(everything, due)
    kept = everything.join(retired.select("collection"), "collection", "left_anti").select(*collections.columns)
    return Roll(kept, opened, retired)


def delete_applications(collections: DataFrame, names: DataFrame) -> DataFrame:
    """The catalogue without these applications."""
    return collections.join(names.select("application"), "application", "left_anti")


def create_collection(collections: DataFrame, application: str, now: datetime) -> DataFrame:
    """The catalogue with one more collection; a name that exists is an error."""
    name = f"{application}_{int(now.timestamp())}"
    if collection_exists(collections, name):
        raise ValueError(f"collection {name} exists")
    one = collections.sparkSession.range(1).select(F.lit(application).alias("application"))
    return collections.unionByName(_open(one, now))


def set_alias(aliases: DataFrame, alias: str, collections: list[str]) -> DataFrame:
    """Point an alias at exactly these collections."""
    if not collections:
        raise ValueError("an alias needs at least one collection")
    spark = aliases.sparkSession
    rows = spark.range(1).select(
        F.lit(alias).alias("alias"), F.explode(F.array(*[F.lit(c) for c in collections])).alias("collection")
    )
    return delete_alias(aliases, alias).unionByName(rows)


def repoint_aliases(aliases: DataFrame, replacement: DataFrame) -> DataFrame:
    """Replace every alias named in ``replacement`` as a whole."""
    return aliases.join(replacement.select("alias").distinct(), "alias", "left_anti").unionByName(replacement)


def delete_alias(aliases: DataFrame, alias: str) -> DataFrame:
    return aliases.filter(F.col("alias") != alias)


def delete_collection(collections: DataFrame, name: str) -> DataFrame:
    return collections.filter(F.col("collection") != name)


def expire(spark: SparkSession, logs_path: str, retired: DataFrame, confirm: bool = False) -> list[str]:
    """Partition folders of retired collections; with ``confirm`` they are deleted.

    Call it after the new catalogue is stored, so that no reader still resolves to them. Only names travel to the
    driver: a handful per application and roll.
    """
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    folders = []
    for row in retired.select("application", "collection").toLocalIterator():
        folder = f"{logs_path.rstrip('/')}/application={row['application']}/collection={row['collection']}"
        path = jvm.org.apache.hadoop.fs.Path(folder)
        fs = path.getFileSystem(conf)
        if fs.exists(path):
            folders.append(folder)
            if confirm:
                fs.delete(path, True)
    return sorted(folders)


