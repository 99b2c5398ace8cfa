"""The corpus pipeline: quality rules, exact duplicates, near duplicates, mixture, packing.

Each stage takes ``(spark, docs, sf_dir)`` and works on all rows that the stage before it kept; all but the last
return the columns of ``documents``. Between stages the rows are written as Parquet and read again. Nulls, empty
texts, repeated rows and extra columns mean in a stage what they mean in its operator; empty tables pass through.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loglake.llm.common import documents, stored
from loglake.llm.exact_dedup import exact_dedup
from loglake.llm.mixing import mix
from loglake.llm.near_dedup import near_dedup
from loglake.llm.packing import pack, pieces
from loglake.llm.quality_rules import quality_rules


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that the quality rules keep."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return quality_rules(docs, labels, carry=tuple(docs.columns)).where("kept").select("row.*")


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of equal texts, that with the largest id."""
    return exact_dedup(docs, carry=tuple(docs.columns)).where("kept").select("row.*")


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each component of near duplicates, that with the least id. Rows without id stay."""
    dropped = stored(near_dedup(docs).where("NOT kept AND doc_id IS NOT NULL").select(F.col("doc_id").alias("dropped")).distinct())
    return docs.join(dropped, docs["doc_id"] == dropped["dropped"], "left_anti")


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every row as often as the mixture takes it."""
    mixed = mix(docs, carry=tuple(docs.columns)).where("copies > 0")
    times = F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("copy")
    return mixed.select("row", times).select("row.*")


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all rows in their sequences; see ``op5_pack`` for the columns."""
    tokenizer = str(public_tokenizers.path("byte_bpe_50k.json"))
    parts = pieces(docs, tokenizer).withColumn("ids_crc32", F.crc32("ids")).drop("ids")
    return pack(stored(parts))


STAGES = [
    ("quality rules", keep_quality),
    ("exact dedup", drop_copies),
    ("near dedup", drop_near_copies),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]

#: Hashed n-grams, sketches and Newton steps have no SQL form; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for _, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
