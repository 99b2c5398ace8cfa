"""Projections of log events: flattening, dynamic typing, origin, gauges, record condensing."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loglake.frames import merge_maps
from loglake.functions.timestamps import parse_iso, timestamp_to_iso, unix_time_micros

# Name suffix -> (typed map column, Spark type). Names without one stay strings.
DYNAMIC_SUFFIXES = {
    "_i": ("ints", "int"),
    "_l": ("longs", "bigint"),
    "_f": ("floats", "float"),
    "_d": ("doubles", "double"),
}
CORE_FIELDS = ["category", "timestamp", "level", "message", "threadName", "throwable", "application"]
GAUGE_PATTERN = r"(?s)^metric: ([^=]+)=(.*)$"


def flatten_event(df: DataFrame) -> DataFrame:
    """Lift ``properties`` next to the core fields in one string map column ``fields``.

    A property that carries the name of a core field replaces it. Missing ``throwable`` and ``application``
    become empty text. ``id`` stays a column of its own. Rows that come as a ``fields`` map are flat already.
    """
    defaults = {"throwable", "application"}
    pairs = []
    for name in CORE_FIELDS:
        value = F.coalesce(F.col(name), F.lit("")) if name in defaults else F.col(name)
        pairs += [F.lit(name), value]
    if "fields" in df.columns and "timestamp" not in df.columns:  # free-form maps and Kafka values are flat
        return df if "id" in df.columns else df.withColumn("id", F.lit(None).cast("string"))
    return df.withColumn("fields", merge_maps(F.create_map(*pairs), F.col("properties"))).drop("properties")


def log_rows(df: DataFrame) -> DataFrame:
    """Flattened events as wide log rows: known names become columns, the rest stays in ``fields``.

    A row belongs to the application that its request or message names. A property ``application`` that says
    otherwise stays in ``fields``; it names the target only where nothing else does.
    """
    known = CORE_FIELDS[:-1] + ["hostname", "application_id", "container_id"]
    target = F.coalesce(F.nullif(F.col("application"), F.lit("")), F.nullif(F.col("fields")["application"], F.lit("")))
    get = lambda name: F.col("fields")[name]
    return df.select(
        target.alias("application"),
        F.coalesce(F.col("id"), get("id")).alias("id"),
        parse_iso(get("timestamp")).alias("ts"),
        *[get(n).alias(n) for n in known if n != "timestamp"],
        F.map_filter(
            "fields",
            lambda k, v: ~k.isin(known + ["id", "application"]) | ((k == "application") & (v != "") & (v != target)),
        ).alias("fields"),
    )


def typed_fields(df: DataFrame, col: str = "fields") -> DataFrame:
    """Split dynamic fields into typed maps by name suffix; a value of the wrong type becomes NULL."""
    fields = F.col(col)

    def typed(suffix: str, spark_type: str) -> Column:
        chosen = F.map_filter(fields, lambda k, _: k.endswith(suffix))
        return F.transform_values(chosen, lambda _, v: v.try_cast(spark_type))

    strings = F.map_filter(fields, lambda k, _: ~k.rlike("_[ilfd]$"))
    maps = {name: typed(suffix, spark_type) for suffix, (name, spark_type) in DYNAMIC_SUFFIXES.items()}
    return df.withColumns({**maps, "strings": strings})


def variant_fields(df: DataFrame, col: str = "fields", name: str = "attributes") -> DataFrame:
    """Dynamic fields as one VARIANT with typed values, by name suffix; a value of the wrong type becomes a null.

    A predicate on ``variant_field`` reads that field alone, where the typed maps of ``typed_fields`` are built whole.
    """

    def typed(k: Column, v: Column) -> Column:
        value = v.cast("variant")
        for suffix, (_, spark_type) in DYNAMIC_SUFFIXES.items():
            value = F.when(k.endswith(suffix), v.try_cast(spark_type).cast("variant")).otherwise(value)
        return value

    return df.withColumn(name, F.to_variant_object(F.transform_values(F.col(col), typed)))


def variant_field(field: str, column: Column | str = "attributes") -> Column:
    """One dynamic field of ``variant_fields``, of the type its suffix says."""
    if not re.fullmatch(r"[^\\'\]]+", field):
        raise ValueError(f"not a field name: {field!r}")
    types = [spark_type for suffix, (_, spark_type) in DYNAMIC_SUFFIXES.items() if field.endswith(suffix)]
    return F.try_variant_get(column, f"$['{field}']", types[0] if types else "string")


def spark_application_id(path: Column | str) -> Column:
    """Penultimate segment of a container log path, '' when there is none."""
    parts = F.split(F.col(path) if isinstance(path, str) else path, "/")
    return F.coalesce(F.try_element_at(parts, F.lit(-2)), F.lit(""))


def spark_container_id(path: Column | str) -> Column:
    """Attempt and container number: the last two '_' parts of the last path segment, '' when missing."""
    last = F.element_at(F.split(F.col(path) if isinstance(path, str) else path, "/"), -1)
    parts = F.split(last, "_")
    tail = F.array_join(F.slice(parts, -2, 2), "_")
    return F.coalesce(F.when(F.size(parts) >= 2, tail), F.lit(""))


def enrich_origin(df: DataFrame, hostname: Column, path: Column) -> DataFrame:
    """Fill ``hostname`` where unset; for rows with a container path, overwrite both Spark ids."""
    present = path.isNotNull()
    old = {c: F.col(c) if c in df.columns else F.lit(None).cast("string")
           for c in ("hostname", "application_id", "container_id")}
    return df.withColumns(
        {
            "hostname": F.coalesce(old["hostname"], hostname),
            "application_id": F.when(present, spark_application_id(path)).otherwise(old["application_id"]),
            "container_id": F.when(present, spark_container_id(path)).otherwise(old["container_id"]),
        }
    )


def join_stack(c: Column | str) -> Column:
    """Stack lines as one text; a NULL stack stays NULL."""
    return F.array_join(F.col(c) if isinstance(c, str) else c, "\n")


def merge_mdc(properties: Column | str, mdc: Column | str) -> Column:
    """Event properties plus diagnostic context; the context wins on equal names."""
    as_col = lambda c: F.col(c) if isinstance(c, str) else c
    return merge_maps(as_col(properties), as_col(mdc))


def lower_columns(df: DataFrame) -> DataFrame:
    return df.toDF(*[c.lower() for c in df.columns])


def row_as_map(columns: list[str] | dict[str, Column]) -> Column:
    """The columns as a name -> text map without NULL entries."""
    named = columns if isinstance(columns, dict) else {c: F.col(c) for c in columns}
    full = F.map_from_arrays(
        F.array(*[F.lit(n) for n in named]), F.array(*[c.cast("string") for c in named.values()])
    )
    return F.map_filter(full, lambda _, v: v.isNotNull())


def rows_as_maps(df: DataFrame, alias: str = "document") -> DataFrame:
    return df.select(row_as_map(df.columns).alias(alias))


def extract_gauge(df: DataFrame, key: str = "application") -> DataFrame:
    """Metric rows out of gauge log lines ``metric: <tag>=<value>``; other lines and non-numbers are left out."""
    found = df.filter(F.col("message").startswith("metric: ")).select(
        "ts",
        F.col(key).alias("key"),
        F.regexp_extract("message", GAUGE_PATTERN, 1).alias("tag"),
        F.regexp_extract("message", GAUGE_PATTERN, 2).try_cast("double").alias("value"),
    )
    return found.filter((F.col("tag") != "") & F.col("value").isNotNull())


def metric_row(key: Column, tag: Column, value: Column, ts: Column, fmt: str | None = None) -> list[Column]:
    """Select-list of one gauge reading."""
    return [
        key.cast("string").alias("key"),
        tag.alias("tag"),
        value.cast("double").alias("value"),
        unix_time_micros(ts, fmt).alias("ts"),
    ]


def record_to_event(
    df: DataFrame, name: str, created: str, level: str, message: str, thread: str | None = None,
    hostname: str | None = None, upper_level: bool = False,
) -> DataFrame:
    """A client log record condensed to event fields. Sources without a thread send an empty name."""
    lvl = F.upper(level) if upper_level else F.col(level)
    return df.select(
        F.col(name).alias("category"),
        timestamp_to_iso(created).alias("timestamp"),
        lvl.alias("level"),
        F.col(message).alias("message"),
        (F.col(thread) if thread else F.lit("")).alias("threadName"),
        (F.col(hostname) if hostname else F.lit(None).cast("string")).alias("hostname"),
    )
