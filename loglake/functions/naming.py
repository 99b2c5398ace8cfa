"""Names of collections (time partitions of an application) and of their aliases."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

COLLECTION_PATTERN = r"^(.*)_(\d+)$"
# Alias kinds. Writers use 'latest', readers use 'all'.
ALIAS_KINDS = ("latest", "all")


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def collection_application(c: Column | str) -> Column:
    """The application part of a collection name."""
    return F.regexp_extract(_col(c), COLLECTION_PATTERN, 1)


def collection_epoch(c: Column | str) -> Column:
    """The creation second of a collection name, NULL for other names."""
    return F.regexp_extract(_col(c), COLLECTION_PATTERN, 2).try_cast("bigint")


def collection_name(application: Column | str, created: Column | str) -> Column:
    """``<application>_<epoch seconds>``; ``created`` holds epoch seconds."""
    return F.concat_ws("_", _col(application), _col(created).cast("string"))


def alias_name(application: Column | str, kind: str) -> Column:
    """``<application>_latest`` or ``<application>_all``."""
    if kind not in ALIAS_KINDS:
        raise ValueError(f"alias kind must be one of {ALIAS_KINDS}, not {kind!r}")
    return F.concat(_col(application), F.lit(f"_{kind}"))
