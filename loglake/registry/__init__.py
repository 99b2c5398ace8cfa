"""Checkable queries over the driver's tables, one or more per operator."""

from loglake.registry import alerts, ingest, lifecycle, metrics, search, streams  # noqa: F401
from loglake.registry.base import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
