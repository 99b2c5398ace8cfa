"""Continuous ingest."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime, timezone

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from loglake.frames import stored
from loglake.operators.documents import rejected_events
from loglake.operators.rollup import cover, write_rollup
from loglake.plans.ingest import normalise, place
from loglake.plans.retention import open_missing
from loglake.sinks.logs import write_batch
from loglake.sources.config import Application
from loglake.sources.stored import stored_logs
from loglake.streaming.alerts import start_batches


def ingest_stream(
    events: DataFrame,
    read_catalogue: Callable[[], DataFrame],
    write_catalogue: Callable[[DataFrame], None],
    path: str,
    checkpoint: str,
    interval: str | None = "1 second",
    clock: Callable[[], datetime] | None = None,
    rejects: str | None = None,
    rollup: str | None = None,
    applications: list[Application] | None = None,
) -> StreamingQuery:
    """Events -> log rows -> the open collection of their application, one micro-batch per interval.

    Events have typed columns or a ``fields`` map. Every batch reads the catalogue, so a roll in between takes effect
    with the next one; an application that has no collection gets its first. A replayed batch writes over what it
    wrote before and keeps its version. Incomplete events go to ``rejects``, a folder a batch, or are left out. How
    many rows a batch takes is set at the source (``maxOffsetsPerTrigger``, ``maxFilesPerTrigger``).

    With ``rollup``, a folder, the counts per minute of the rules of ``applications`` are appended there beside the
    rows; conditions that it does not cover yet are first counted over what is stored.
    """
    if rollup:
        spark = events.sparkSession
        cover(spark, rollup, stored_logs(spark, path), applications or [])

    def one_batch(batch: DataFrame, batch_id: int) -> None:
        arrived = stored(batch, "arrived")
        if rejects:
            rejected_events(arrived).write.mode("overwrite").parquet(f"{rejects}/batch={batch_id}")
        rows = normalise(arrived)
        known = read_catalogue()
        catalogue = open_missing(known, rows, clock() if clock else datetime.now(timezone.utc))
        catalogue = stored(catalogue, "catalogue")
        if catalogue.count() != known.count():
            write_catalogue(catalogue)
        placed = place(rows, catalogue, version=batch_id + 1)
        if rollup:
            placed = stored(placed, "placed")
            write_rollup(placed, applications or [], rollup, batch_id)
        write_batch(placed, path, batch_id)

    return start_batches(events, one_batch, checkpoint, interval)
