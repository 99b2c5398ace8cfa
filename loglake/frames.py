"""Small shared DataFrame helpers."""

from __future__ import annotations

import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema


def local_frame(spark: SparkSession, rows: list[dict], schema: T.StructType) -> DataFrame:
    """Driver-side configuration rows as a DataFrame.

    Going through Arrow yields a local relation whose exact size Catalyst knows, so a join against it is
    broadcast when it is under ``spark.sql.autoBroadcastJoinThreshold`` and shuffled when it is not.
    """
    names = schema.fieldNames()
    table = pa.Table.from_pylist(
        [{name: row.get(name) for name in names} for row in rows], schema=to_arrow_schema(schema)
    )
    return spark.createDataFrame(table, schema)


def shared_dir(spark: SparkSession, name: str) -> str:
    """A fresh path in the folder that driver and executors share: ``spark.checkpoint.dir``, or what
    ``SparkContext.setCheckpointDir`` was given."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read back: computed once, and not again when an executor is lost."""
    path = shared_dir(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def empty_map():
    return F.create_map().cast("map<string,string>")


def merge_maps(base, override):
    """Key-wise merge of two string maps; ``override`` wins. Independent of the duplicate-key policy."""
    base = F.coalesce(base, empty_map())
    override = F.coalesce(override, empty_map())
    kept = F.map_filter(base, lambda k, _: ~F.map_contains_key(override, k))
    return F.map_concat(kept, override)
