"""Operators on stored documents: identity, upsert, validity, unions, order."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loglake.functions.timestamps import parse_iso
from loglake.schema import REQUIRED_EVENT_FIELDS


def assign_id(df: DataFrame, deterministic: bool = False) -> DataFrame:
    """Give rows without ``id`` one: a random UUID, or a content hash that stays equal on replay."""
    if deterministic:
        content = [c for c in df.columns if c != "id"]
        new = F.sha2(F.to_json(F.struct(*content)), 256)
    else:
        new = F.uuid()
    return df.withColumn("id", F.coalesce("id", new) if "id" in df.columns else new)


def content_hash(df: DataFrame, leave_out: list[str]) -> Column:
    """A hash of a row's content, whatever the order of its columns: maps by their entries, what holds maps or variants
    by its JSON text."""

    def part(name: str, kind: str) -> Column:
        inner = kind.removeprefix("map<")
        if "map<" in inner or "variant" in kind:
            return F.to_json(F.struct(name))
        return F.map_entries(name) if inner != kind else F.col(name)

    columns = sorted((f.name, f.dataType.simpleString()) for f in df.schema.fields if f.name not in leave_out)
    return F.xxhash64(*[part(*c) for c in columns]) if columns else F.lit(0)


def upsert_latest(df: DataFrame, keys: list[str] | None = None, version: str = "version") -> DataFrame:
    """The newest version of every key.

    Of rows with equal versions, as one write gives them, the newest by ``ts`` is read, where there is one, and of
    those the one with the largest hash of its content: whichever order the rows come in. The rank filter is applied in
    every map task before the shuffle, so a key that holds a large share of the rows sends one row per task.
    """
    keys = keys or ["id"]
    order = [c for c in (version, "ts") if c in df.columns]
    newest = Window.partitionBy(*keys).orderBy(*(F.col(c).desc() for c in order), content_hash(df, [*keys, *order]).desc())
    return df.withColumn("_rank", F.row_number().over(newest)).filter("_rank = 1").drop("_rank")


def get_by_id(df: DataFrame, ids: list[str] | DataFrame) -> DataFrame:
    """Documents with these ids; a list becomes a pushed-down condition, a frame a semi join."""
    if isinstance(ids, DataFrame):
        return df.join(ids, "id", "left_semi")
    return df.filter(F.col("id").isin(ids))


def _complete(df: DataFrame, required: list[str] | None) -> Column:
    """All required fields are there, and the time is one. Free-form rows have their fields in a map."""
    get = (lambda f: F.col(f)) if "timestamp" in df.columns else (lambda f: F.col("fields")[f])
    names = required or REQUIRED_EVENT_FIELDS
    checks = [get(f).isNotNull() for f in names]
    if "timestamp" in names:
        checks.append(parse_iso(get("timestamp")).isNotNull())
    return F.coalesce(reduce(lambda a, b: a & b, checks), F.lit(False))


def valid_events(df: DataFrame, required: list[str] | None = None) -> DataFrame:
    """Events with every required field and a time that can be read."""
    return df.filter(_complete(df, required))


def rejected_events(df: DataFrame, required: list[str] | None = None) -> DataFrame:
    """The others, as they came: the text of an unreadable time is still there."""
    return df.filter(~_complete(df, required))


def rejected_messages(decoded: DataFrame) -> DataFrame:
    """Kafka messages whose value was no JSON object."""
    return decoded.filter(F.col("fields").isNull())


def union_collections(frames: list[DataFrame]) -> DataFrame:
    """Several collections read as one; columns a collection lacks are NULL."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def newest_first(logs: DataFrame, limit: int | None = None) -> DataFrame:
    """Newest rows first. With ``limit`` every task keeps only its own newest rows."""
    ordered = logs.orderBy(F.col("ts").desc(), F.col("id"))
    return ordered if limit is None else ordered.limit(limit)


def events_per_application(df: DataFrame) -> DataFrame:
    return df.groupBy("application").agg(F.count("*").alias("events"))
