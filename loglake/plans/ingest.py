"""From raw events to stored log rows."""

from __future__ import annotations

import time

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loglake.functions.events import flatten_event, log_rows
from loglake.operators.collections import place_by_time, place_in_open
from loglake.operators.documents import assign_id, valid_events
from loglake.schema import REQUIRED_EVENT_FIELDS


def normalise(events: DataFrame) -> DataFrame:
    """Events as wide log rows; incomplete ones are left out (``rejected_events`` lists them).

    Events have typed columns (``read_log_events``) or a ``fields`` map (``read_json_maps``, ``decode_kafka_value``).
    """
    return log_rows(flatten_event(valid_events(events, REQUIRED_EVENT_FIELDS)))


def place(
    rows: DataFrame,
    catalogue: DataFrame,
    by_time: bool = False,
    deterministic_id: bool = False,
    version: int | None = None,
) -> DataFrame:
    """Log rows with id, version and the collection they belong to.

    Rows that arrive go to the open collection of their application, rows of the past (``by_time``) to the one that
    was open then. Rows sent without an id get a random one each; ``deterministic_id`` takes a content hash, by which
    equal rows count as one document. ``version`` orders writes, so that of rows with one id the newest write is read
    (``read_latest``); by default it is the time of the call in microseconds.
    """
    identified = assign_id(rows, deterministic_id)
    numbered = identified.withColumn("version", F.lit(version or time.time_ns() // 1000).cast("bigint"))
    return (place_by_time if by_time else place_in_open)(numbered, catalogue)
