"""Readers over stored logs and user-written SQL."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loglake.functions.events import lower_columns
from loglake.operators.documents import upsert_latest
from loglake.schema import MAX_DOCUMENTS


def read_sql_rule(
    spark: SparkSession,
    query: str,
    options: dict[str, str] | None = None,
    max_rows: int | None = MAX_DOCUMENTS,
    args: dict | None = None,
) -> DataFrame:
    """Rows of a user-written query, column names in lower case.

    Without ``options`` the query runs on the session's tables and views. With them it is sent to a database by
    JDBC (``url``, ``user``, ``password`` and whatever else the driver takes).
    """
    if options:
        df = spark.read.format("jdbc").options(**options).option("query", query).load()
    else:
        df = spark.sql(query, args=args) if args else spark.sql(query)
    df = lower_columns(df)
    return df if max_rows is None else df.limit(max_rows)


def stored_logs(spark: SparkSession, path: str) -> DataFrame | None:
    """Logs as they are stored; None where none are."""
    try:
        return spark.read.parquet(path)
    except AnalysisException:
        return None


def read_application(logs: DataFrame, application: str, collections: list[str] | None = None) -> DataFrame:
    """Every retained row of one application. Both conditions are on partition columns, so files are pruned."""
    found = logs.filter(F.col("application") == application)
    return found if collections is None else found.filter(F.col("collection").isin(collections))


def read_latest(logs: DataFrame) -> DataFrame:
    """Stored rows with the newest version of each id: rows that were sent or written again count once."""
    return upsert_latest(logs)
