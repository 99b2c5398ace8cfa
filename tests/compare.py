"""Run registered queries and their SQL twins side by side.

``python tests/compare.py [name part ...]`` prints one line per query.
"""

from __future__ import annotations

import math
import sys
import tempfile
import time
from datetime import datetime
from decimal import Decimal
from pathlib import Path

import duckdb
from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()

SQL_TYPES = {"string": "VARCHAR", "bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "boolean": "BOOLEAN"}


def session(cores: int = 8) -> SparkSession:
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("loglake-tests")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "8g")
        .config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="loglake-tests-"))
        .getOrCreate()
    )


def plain(value):
    if isinstance(value, Decimal):
        return float(value)
    if isinstance(value, float):
        return "nan" if math.isnan(value) else round(value, 9)
    if isinstance(value, datetime):
        return value.replace(tzinfo=None).isoformat()
    return value


def rows_of(names: list[str], rows) -> list[tuple]:
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


def compare(spark: SparkSession, sf_dir: str, run, sql: str | None) -> tuple[bool, str]:
    df = run(spark, sf_dir)
    ours = rows_of(df.columns, df.collect())
    if sql is None:
        return bool(ours), f"{len(ours)} rows, no SQL"
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    result = con.execute(sql)
    names = [d[0] for d in result.description]
    theirs = rows_of(names, result.fetchall())
    if sorted(names) != sorted(df.columns):
        return False, f"columns {sorted(df.columns)} against {sorted(names)}"
    theirs_types = {d[0]: str(d[1]) for d in result.description}
    odd = {c: (t, theirs_types[c]) for c, t in df.dtypes if SQL_TYPES.get(t) != theirs_types[c]}
    if odd:
        return False, f"types {odd}"
    if ours == theirs:
        return True, f"{len(ours)} rows"
    ours_only = [r for r in ours if r not in set(theirs)][:3]
    theirs_only = [r for r in theirs if r not in set(ours)][:3]
    return False, f"{len(ours)} against {len(theirs)} rows\n   ours   {ours_only}\n   theirs {theirs_only}"


if __name__ == "__main__":
    import __spark_entry__ as entry

    parts = sys.argv[1:]
    spark = session()
    spark.sparkContext.setLogLevel("ERROR")
    bad = 0
    for name, run in entry.queries().items():
        if parts and not any(p in name for p in parts):
            continue
        start = time.time()
        try:
            ok, note = compare(spark, "/root/testdata/sf0.01", run, entry.oracle_sql().get(name))
        except Exception as error:  # noqa: BLE001
            ok, note = False, f"{type(error).__name__}: {str(error)[:700]}"
        bad += not ok
        print(f"{'ok  ' if ok else 'FAIL'} {name:36s} {time.time() - start:6.1f}s {note}", flush=True)
    print(f"{bad} failing")
