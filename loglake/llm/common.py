"""Helpers that several operators share."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Salts that the rows of one key are spread over.
SALTS = 32


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


_LOCAL: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """A new path in the folder of ``spark.checkpoint.dir``, which driver and executors share.

    Where the setting is missing, a session on one machine gets a temporary folder; a cluster session is refused.
    """
    context = spark.sparkContext
    base = spark.conf.get("spark.checkpoint.dir", None) or _LOCAL.get(context.applicationId)
    if not base:
        if not context.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = _LOCAL[context.applicationId] = tempfile.mkdtemp(prefix="llm-")
    return f"{base.rstrip('/')}/{uuid.uuid4().hex}"


def stored(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder and read back: computed once, and safe from lost executors."""
    path = shared_dir(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Gives the executors this package, once an application, whether or not it is installed there."""
    context = spark.sparkContext
    if context.applicationId in _SHIPPED:
        return
    here = Path(__file__).resolve().parent
    archive = Path(tempfile.mkdtemp(prefix="llm-code-")) / "loglake_llm.zip"
    with zipfile.ZipFile(archive, "w") as out:
        out.write(here.parent / "__init__.py", "loglake/__init__.py")
        for source in sorted(here.glob("*.py")):
            out.write(source, f"loglake/llm/{source.name}")
    context.addPyFile(str(archive))
    _SHIPPED.add(context.applicationId)


def map_arrow(df: DataFrame, function, schema) -> DataFrame:
    """``df.mapInArrow`` with this package on the executors."""
    ship(df.sparkSession)
    return df.mapInArrow(function, schema)


def slices(batches, rows: int = 256):
    """The Arrow batches in parts of ``rows``, so that a worker holds what it makes of few texts at a time."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def body(text: str = "text") -> Column:
    return F.coalesce(F.col(text), F.lit(""))


def let(value: Column, use) -> Column:
    """``use(value)`` with ``value`` computed once a row."""
    return F.transform(F.array(value), use)[0]


def words(text: Column) -> Column:
    """Runs of characters other than ASCII white space."""
    return F.array_remove(F.split(text, r"[\x20\x09-\x0D]+"), "")


def salt(*columns: str | Column, salts: int = SALTS) -> Column:
    return F.pmod(F.xxhash64(*columns), F.lit(salts)).cast("int")


def spread_join(rows: DataFrame, table: DataFrame, key: str, spread_by: list[str]) -> DataFrame:
    """``rows`` left-joined with ``table``, which has one row a key, when one key may hold a third of ``rows``.

    The pairs of key and salt that occur (a few for any key) are joined with the table first; then the rows meet
    them by key and salt, so that no task gets all rows of a key.
    """
    salted = rows.withColumn("_salt", salt(*spread_by))
    pairs = salted.select(key, "_salt").distinct().join(table, key)
    return salted.join(pairs, [key, "_salt"], "left").drop("_salt")


def ranked(
    df: DataFrame, keys: list[str], order: list[str], rows: int, table: DataFrame, name: str = "rank"
) -> DataFrame:
    """Rows of ``df`` joined with ``table``, which has one row for ``keys``, and their place, from 0, among equal keys.

    ``rows`` is the total of ``df``. Slices by hash are ranked on their own and start where the slices before them
    end, so a key with a third of all rows is ranked by many tasks; rows move once. Rows that are equal in ``order``
    get places in any order.
    """
    slices = max(16, rows // 20_000)
    sliced = df.withColumn("_slice", salt(*order, salts=slices))
    counts = sliced.groupBy(*keys, "_slice").agg(F.count("*").alias("_n"))
    before = Window.partitionBy(*keys).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.withColumn("_start", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    within = Window.partitionBy(*keys, "_slice").orderBy(*order)
    joined = sliced.join(starts.join(table, keys), [*keys, "_slice"])
    return joined.withColumn(name, F.col("_start") + F.row_number().over(within) - 1).drop("_slice", "_start")
