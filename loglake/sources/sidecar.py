"""A table of which words occur in which file of stored logs, so that a search opens the matching files only."""

from __future__ import annotations

import re

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loglake.functions.text import query_terms, tokenize

#: Folders that word hashes are dealt to; a search opens those of its words.
SHARDS = 64
#: Matching files that a search names to the scan; of more than these, naming them would cost more than it spares.
NAMED_FILES = 10_000
SIDECAR = "file string, word bigint, shard int"

FILE = "_metadata.file_path"


def _shard(word: Column) -> Column:
    return F.pmod(word, F.lit(SHARDS)).cast("int")


def files_of(logs: DataFrame) -> list[str]:
    """The files of stored logs, named as ``_metadata.file_path`` names them: without an empty host."""
    return [re.sub(r"^(\w+):///", r"\1:/", f) for f in logs.inputFiles()]


def read_sidecar(spark: SparkSession, path: str) -> DataFrame:
    """``file, word, shard``; a file that has been read has a row without a word."""
    try:
        return spark.read.schema(SIDECAR).parquet(path)
    except AnalysisException:
        return spark.createDataFrame([], SIDECAR)


def index_files(logs: DataFrame, path: str, field: Column | str = "message") -> int:
    """Adds the files of ``logs`` that the sidecar does not know; returns how many there were.

    ``logs`` is stored logs as they are read. A row becomes its distinct words; these are made distinct by file in the
    map tasks, so what is shuffled is the vocabulary of the files that a task reads.
    """
    spark = logs.sparkSession
    known = {r["file"] for r in read_sidecar(spark, path).filter("word IS NULL").select("file").toLocalIterator()}
    new = [f for f in files_of(logs) if f not in known]
    if not new:
        return 0
    rows = logs.filter(F.col(FILE).isin(new)) if known else logs
    hashes = F.transform(F.array_distinct(tokenize(field)), lambda w: F.xxhash64(w))
    words = rows.select(F.col(FILE).alias("file"), F.explode(F.coalesce(hashes, F.array().cast("array<bigint>"))).alias("word"))
    read = spark.createDataFrame([(f,) for f in new], "file string").withColumn("word", F.lit(None).cast("bigint"))
    out = words.distinct().withColumn("shard", _shard(F.col("word"))).unionByName(read.withColumn("shard", F.lit(-1)))
    out.hint("rebalance", "shard").sortWithinPartitions("shard", "word").write.mode("append").partitionBy("shard").parquet(path)
    return len(new)


def matching_files(sidecar: DataFrame, text: str, every: bool) -> DataFrame:
    """Files that have any word of ``text``, or with ``every`` all of them."""
    terms = list(dict.fromkeys(query_terms(text)))
    spark = sidecar.sparkSession
    wanted = spark.range(1).select(F.explode(F.transform(F.array(*[F.lit(t) for t in terms]).cast("array<string>"), lambda t: F.xxhash64(t))).alias("word"))
    hashes = [r["word"] for r in wanted.collect()]
    shards = sorted({h % SHARDS for h in hashes})
    found = sidecar.filter(F.col("shard").isin(shards) & F.col("word").isin(hashes))
    counted = found.groupBy("file").agg(F.count_distinct("word").alias("n"))
    return counted.filter(F.col("n") >= (len(set(hashes)) if every else 1)).select("file")


def pruned(logs: DataFrame, sidecar: DataFrame, text: str, every: bool = False) -> DataFrame:
    """``logs`` without the files that cannot match; the predicate still has to be applied.

    Files that the sidecar does not know yet are read. The names go to the scan as a condition on the file, which Spark
    applies to the list of files before it opens one.
    """
    files = files_of(logs)
    known = {r["file"] for r in sidecar.filter("word IS NULL").select("file").toLocalIterator()}
    found = matching_files(sidecar, text, every).limit(NAMED_FILES + 1).collect()
    if len(found) > NAMED_FILES:
        return logs
    wanted = {r["file"] for r in found}
    return logs.filter(F.col(FILE).isin([f for f in files if f in wanted or f not in known]))
