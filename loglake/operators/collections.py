"""Collections (time partitions of an application) and their aliases, as DataFrames."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loglake.functions.naming import alias_name, collection_name
from loglake.schema import DEFAULT_NUM_COLLECTIONS, DEFAULT_ROLL_PERIOD_DAYS
from loglake.sources.config import with_policy_defaults

SECONDS_PER_DAY = 86_400


def assign_collection(logs: DataFrame, policies: DataFrame, origin: datetime | None = None) -> DataFrame:
    """Put every row into the collection that was open at its time.

    For logs that no catalogue knows yet: an application's first collection opens with its first row (or at
    ``origin``), and a new one opens every roll period. Rows that arrive go to the collection that the catalogue has
    open: see ``place_in_open`` and ``place_by_time``.
    """
    settings = policies.select("application", "roll_period_days")
    if origin is None:
        first = logs.groupBy("application").agg(F.unix_seconds(F.min("ts")).alias("_first"))
        settings = first.join(settings, "application", "left")
    joined = logs.join(settings, "application", "left")
    start = F.lit(origin).cast("timestamp").cast("bigint") if origin else F.col("_first")
    period = F.coalesce("roll_period_days", F.lit(DEFAULT_ROLL_PERIOD_DAYS)).cast("bigint") * SECONDS_PER_DAY
    rolls = F.floor((F.unix_seconds("ts") - start) / period).cast("bigint")
    return (
        joined.withColumn("created_epoch", start + rolls * period)
        .withColumn("collection", collection_name("application", "created_epoch"))
        .drop("_first", "roll_period_days")
    )


def place_in_open(rows: DataFrame, catalogue: DataFrame) -> DataFrame:
    """Rows that arrive, in the newest collection of their application: the target of its write alias.

    An application that the catalogue does not have keeps its rows, with a NULL collection; ``open_missing`` opens
    one for it first.
    """
    return rows.join(newest_collection(catalogue), "application", "left")


def place_by_time(rows: DataFrame, catalogue: DataFrame) -> DataFrame:
    """Rows of the past, each in the collection that was open at its ``ts``; older rows go to the first one.

    A collection is open until its successor opens, however late that is. An application has a handful of
    collections, kept as one array, so each row is placed without a range join.
    """
    opened = catalogue.groupBy("application").agg(
        F.array_sort(F.collect_set(F.struct("created_epoch", "collection"))).alias("_opened")
    )
    joined = rows.join(opened, "application", "left")
    before = F.filter("_opened", lambda c: c["created_epoch"] <= F.unix_seconds("ts"))
    target = F.coalesce(F.try_element_at(before, F.lit(-1)), F.get("_opened", F.lit(0)))
    return joined.withColumns({"created_epoch": target["created_epoch"], "collection": target["collection"]}).drop("_opened")


def collections_of(logs: DataFrame) -> DataFrame:
    """The catalogue of collections that hold rows."""
    return logs.select("application", "collection", "created_epoch").distinct()


def newest_collection(collections: DataFrame) -> DataFrame:
    """Target of the write alias of every application."""
    return collections.groupBy("application").agg(
        F.max_by("collection", "created_epoch").alias("collection"), F.max("created_epoch").alias("created_epoch")
    )


def alias_members(collections: DataFrame) -> DataFrame:
    """(alias, collection) rows: the write alias to the newest collection, the read alias to all."""
    latest = newest_collection(collections).select(alias_name("application", "latest").alias("alias"), "collection")
    return collections.select(alias_name("application", "all").alias("alias"), "collection").unionByName(latest)


def alias_map(collections: DataFrame) -> DataFrame:
    """Alias to its sorted collections; a group is one application's retained collections."""
    return members_by_alias(alias_members(collections))


def members_by_alias(aliases: DataFrame) -> DataFrame:
    return aliases.groupBy("alias").agg(F.array_sort(F.collect_set("collection")).alias("collections"))


def list_applications(collections: DataFrame, verbose: bool = False) -> DataFrame:
    """Applications that have a write alias; verbose adds the members of both aliases."""
    if not verbose:
        return collections.select("application").distinct()
    return collections.groupBy("application").agg(
        F.max_by("collection", "created_epoch").alias("latest"),
        F.array_sort(F.collect_set("collection")).alias("all"),
    )


def collection_exists(collections: DataFrame, name: str) -> bool:
    return not collections.filter(F.col("collection") == name).isEmpty()


def alias_exists(aliases: DataFrame, alias: str) -> bool:
    return not aliases.filter(F.col("alias") == alias).isEmpty()


def get_alias(aliases: DataFrame, alias: str) -> list[str] | None:
    """Collections of one alias, None when there is no such alias."""
    found = members_by_alias(aliases.filter(F.col("alias") == alias)).take(1)
    return found[0]["collections"] if found else None


def resolve_alias(logs: DataFrame, aliases: DataFrame, alias: Column | str) -> DataFrame:
    """Rows of the collections behind an alias. ``collection`` is a partition column, which a join can prune."""
    return logs.join(aliases.filter(F.col("alias") == alias).select("collection"), "collection", "left_semi")


def collections_since(collections: DataFrame, since: Column) -> DataFrame:
    """Collections that took rows at or after ``since``: those whose successor did not open before it."""
    later = Window.partitionBy("application").orderBy("created_epoch")
    closed = F.lead("created_epoch").over(later)
    return (
        collections.withColumn("_closed", closed)
        .filter(F.col("_closed").isNull() | (F.col("_closed") > F.unix_seconds(since)))
        .drop("_closed")
    )


def read_since(logs: DataFrame, collections: DataFrame, since: Column) -> DataFrame:
    """Rows at or after ``since``, read from the collections that can hold some; the others are not opened."""
    open_ones = collections_since(collections, since).select("collection")
    return logs.filter(F.col("ts") >= since).join(open_ones, "collection", "left_semi")


def due_applications(collections: DataFrame, policies: DataFrame, now: datetime) -> DataFrame:
    """Policies with ``due``: whole days since the newest collection reach the period, or there is none."""
    newest = newest_collection(collections).select("application", F.col("created_epoch").alias("newest"))
    age = F.floor((F.unix_seconds(F.lit(now).cast("timestamp")) - F.col("newest")) / F.lit(SECONDS_PER_DAY))
    due = F.col("newest").isNull() | (age >= F.col("roll_period_days"))
    return with_policy_defaults(policies).join(newest, "application", "left").withColumn("due", due).drop("newest")


def should_roll(collections: DataFrame, policies: DataFrame, now: datetime) -> DataFrame:
    return due_applications(collections, policies, now).filter("due").drop("due")


def retired_collections(collections: DataFrame, policies: DataFrame) -> DataFrame:
    """Collections beyond the newest N of their application; applications without a policy keep all."""
    by_age = Window.partitionBy("application").orderBy(F.col("created_epoch").desc())
    keep = F.coalesce("num_collections", F.lit(DEFAULT_NUM_COLLECTIONS))
    return (
        collections.withColumn("_rank", F.row_number().over(by_age))
        .join(policies.select("application", "num_collections"), "application")
        .filter(F.col("_rank") > keep)
        .select(*collections.columns)
    )


def retained_collections(collections: DataFrame, policies: DataFrame) -> DataFrame:
    retired = retired_collections(collections, policies).select("collection")
    return collections.join(retired, "collection", "left_anti").select(*collections.columns)


def collections_by_age(collections: DataFrame) -> DataFrame:
    return collections.orderBy(F.col("created_epoch").desc(), "collection")
