"""Metric rows: unique by (ts, key, tag)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loglake.schema import METRIC_KEY


def metric_key(df: DataFrame) -> list[str]:
    return [*(["table_name"] if "table_name" in df.columns else []), *METRIC_KEY]


def first_metrics(batch: DataFrame, order: str | None = None) -> DataFrame:
    """One row per key within a batch: the lowest by ``order`` (arrival), else the lowest value.

    A plain aggregate, combined in the map tasks, so repeated keys do not pile up in one task.
    """
    return batch.groupBy(*metric_key(batch)).agg(F.min_by("value", order or "value").alias("value"))


def new_metrics(batch: DataFrame, existing: DataFrame) -> DataFrame:
    """Rows of the batch whose key is not stored yet."""
    key = metric_key(batch)
    return batch.join(existing.select(*key), key, "left_anti")


def conflicting_metrics(batch: DataFrame, existing: DataFrame) -> DataFrame:
    """Rows of the batch whose key is stored already."""
    key = metric_key(batch)
    return batch.join(existing.select(*key), key, "left_semi")
