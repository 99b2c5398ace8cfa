"""Connected components by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loglake.llm.common import stored


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def connected_components(edges: DataFrame) -> DataFrame:
    """``node, component`` for every node of ``edges`` (``u, v``); a component is named by its least node.

    Every round writes its edges to the shared folder, so a lost executor costs one round at most. Rounds grow with
    the logarithm of a component's size. A node's neighbours are only ever aggregated, never gathered in a list.
    """
    now = stored(
        edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    )
    state = _state(now)
    while state[0]:
        both = now.union(now.select("v", "u"))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array("u", "v")).alias("u"), F.col("m").alias("v"))
        now, before = stored(small.where("u <> v").distinct()), state
        state = _state(now)
        if state == before:
            break
    return now.groupBy("u").agg(F.min("v").alias("v")).select(
        F.explode(F.array(F.struct(F.col("u").alias("node"), F.col("v").alias("component")),
                          F.struct(F.col("v").alias("node"), F.col("v").alias("component")))).alias("x")
    ).select("x.*").distinct()
