"""Exact duplicates, combined in skew-safe stages that compare whole texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loglake.llm.common import SALTS, salt, shared_dir, stored

#: A digest with more than this share of the rows is salted, so fewer than its inverse are.
HOT_SHARE = 0.001


def sha256(text: Column) -> Column:
    return F.sha2(text, 256)


def exact_dedup(docs: DataFrame, carry: tuple[str, ...] = (), digest=sha256) -> DataFrame:
    """Every row with its group of equal texts: ``doc_id, keep_id, group_size, kept, text_sha256`` and ``carry``.

    Map tasks combine equal rows of (digest, salt, text) first; each salted group is merged; the salt winners of hot
    digests are then combined globally. Text is part of every grouping key, so whole contents are compared, never
    digests alone. Only digests that hold over a thousandth of all rows (fewer than 1,000) are salted. Membership is
    joined back by digest and a second hash, after a check that the two name one content only.

    Null texts are empty texts. The largest ``doc_id`` of a group stays; a null id loses to any other. Of rows that
    repeat the same id and text one is kept, by the least hash of their carried columns. Empty input gives an empty
    result. Columns outside ``carry`` are not looked at, so their names cannot clash; ``carry`` comes back as given
    in the struct ``row``.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    plain = [c for c, kind in docs.select(*carry).dtypes if "map<" not in kind] if carry else []
    rows = docs.select(
        F.col("doc_id").alias("id"),
        text.alias("body"),
        digest(text).alias("digest"),
        F.xxhash64(text).alias("second"),
        F.struct(*carry or [F.lit(0).alias("none")]).alias("row"),
        F.xxhash64(*plain, F.lit(0)).alias("row_hash"),
    )
    spark = docs.sparkSession
    counts = stored(rows.groupBy("digest").agg(F.count("*").alias("n")).where("n > 1"))
    total = docs.count()
    hot = [r[0] for r in counts.where(F.col("n") > F.lit(total * HOT_SHARE)).select("digest").collect()]
    is_hot = F.col("digest").isin(hot) if hot else F.lit(False)
    rows = rows.withColumn("salt", F.when(is_hot, salt("id", "row_hash") + 1).otherwise(F.lit(0)))

    winners = rows.groupBy("digest", "second", "salt", "body").agg(F.max("id").alias("top"), F.count("*").alias("n"))
    first = shared_dir(spark)
    winners.withColumn("body", F.when(F.col("salt") > 0, F.col("body"))).write.parquet(first)
    winners = spark.read.parquet(first)
    combined = winners.where("salt > 0").groupBy("digest", "second", "body").agg(
        F.max("top").alias("keep"), F.sum("n").alias("size")
    )
    single = winners.where("salt = 0").select("digest", "second", "salt", F.col("top").alias("keep"), F.col("n").alias("size"))
    spread = combined.select(
        "digest", "second", F.explode(F.sequence(F.lit(1), F.lit(SALTS))).alias("salt"), "keep", "size"
    )
    groups = stored(single.unionByName(spread))
    clash = groups.groupBy("digest", "second", "salt").count().where("count > 1").limit(1).count()
    if clash:
        raise ValueError("two contents share both hashes: pass another digest")

    keys = ["digest", "second", "salt"]
    joined = rows.drop("body").join(groups, keys)
    again = Window.partitionBy(*keys, "id").orderBy("row_hash")
    kept = F.col("id").eqNullSafe(F.col("keep")) & (F.row_number().over(again) == 1)
    return joined.select(
        F.col("id").alias("doc_id"),
        F.col("keep").alias("keep_id"),
        F.col("size").alias("group_size"),
        kept.alias("kept"),
        F.col("digest").alias("text_sha256"),
        *(["row"] if carry else []),
    )
