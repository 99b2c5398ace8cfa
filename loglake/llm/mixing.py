"""Mixing sources to target weights by entropy balancing."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loglake.llm.common import body, ranked, ship, stored, words

#: Shares of successive sources, repeating, and how often a document or source may be taken at most.
WEIGHTS = (5, 2, 1)
CAP = 3
#: Newton steps at most, and the relative error of a source's tokens at which it counts as solved.
STEPS = 40
TOLERANCE = 1e-4


def targets(sizes: dict[str | None, int], weights: tuple[int, ...] = WEIGHTS, cap: int = CAP) -> dict:
    """Tokens that each source is to give; together as many as there are, no source over ``cap`` times its own.

    Sources are in order of code points, null last, and share by repeating ``weights``; what a source cannot take is
    shared among the others by weight until none is over.
    """
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    left, open_, found = float(sum(sizes.values())), [s for s in order if sizes[s] > 0], {s: 0.0 for s in order}
    while open_:
        unit = left / sum(weight[s] for s in open_)
        over = [s for s in open_ if unit * weight[s] > cap * sizes[s]]
        for s in over or open_:
            found[s] = float(cap * sizes[s]) if over else unit * weight[s]
        if not over:
            break
        left -= sum(found[s] for s in over)
        open_ = [s for s in open_ if s not in over]
    return found


def solve(lengths: DataFrame, goal: dict, cap: int = CAP) -> dict:
    """The dual variable of each source's token constraint, by safeguarded Newton steps.

    Document rates of least relative entropy to one copy each, with a source's tokens fixed and rates at most ``cap``,
    are ``min(cap, exp(dual * size))``. Every step sums tokens and slope over all ``lengths`` (``source, size, n``) as
    a Spark aggregation; the driver holds one number a source. A step that leaves the bracket halves it instead.
    """
    spark = lengths.sparkSession
    bounds = {
        r["source"]: (r["low"], r["high"])
        for r in lengths.where("size > 0").groupBy("source").agg(
            F.min("size").alias("low"), F.max("size").alias("high")
        ).collect()
    }
    total = {
        r["source"]: r["t"]
        for r in lengths.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("t")).collect()
    }
    state = {}
    for s, (low, _) in bounds.items():
        if goal[s] >= cap * total[s] * (1 - 1e-12):
            state[s] = [math.log(cap) / low, None, None, True]
        elif goal[s] >= total[s]:
            state[s] = [0.0, 0.0, math.log(cap) / low, False]
        else:  # with this dual even the shortest document's rate is below the share to be taken
            state[s] = [0.0, math.log(max(goal[s], 1e-9) / total[s]) / low, 0.0, False]
    for _ in range(STEPS):
        todo = [(s, x[0]) for s, x in state.items() if not x[3]]
        if not todo:
            break
        duals = spark.createDataFrame(todo, "s string, dual double")
        joined = lengths.join(duals, F.col("source").eqNullSafe(F.col("s")))
        power = F.col("dual") * F.col("size")
        rate = F.least(F.lit(float(cap)), F.exp(F.least(power, F.lit(5.0))))
        tokens = F.col("n") * F.col("size") * rate
        rise = F.when(rate < cap, tokens * F.col("size")).otherwise(0.0)
        # decimals add up to the same sum in any order, so reruns agree
        exact = lambda x: F.sum(x.cast("decimal(38,6)"))
        for r in joined.groupBy("source").agg(exact(tokens).alias("tokens"), exact(rise).alias("slope")).collect():
            x = state[s := r["source"]]
            tokens, slope = float(r["tokens"]), float(r["slope"])
            gap = tokens - goal[s]
            if abs(gap) <= TOLERANCE * max(goal[s], 1.0):
                x[3] = True
                continue
            x[2 if gap > 0 else 1] = x[0]
            # Newton on the logarithm of the tokens, which is closer to a line than the tokens are
            step = math.log(max(goal[s], 1e-9) / tokens) * tokens / slope if slope and tokens else math.inf
            x[0] = x[0] + step if x[1] < x[0] + step < x[2] else (x[1] + x[2]) / 2
    return {s: x[0] for s, x in state.items()}


def _rounded(lengths: pd.DataFrame, cap: int) -> list[int]:
    """Whole copies of each length of a source, longest first, each taking over the error of those before.

    As long as it can be done, copies leave neither more to the shorter lengths than they can give nor less than none,
    so the target is missed by less than the shortest document; else by as little as whole copies allow.
    """
    need = float(lengths["target"].iloc[0])
    rest = cap * float((lengths["size"] * lengths["n"]).sum())
    error = need - float((lengths["size"] * lengths["n"] * lengths["rate"]).sum())
    out = []
    for size, n, rate in zip(lengths["size"], lengths["n"], lengths["rate"], strict=True):
        if not size:
            out.append(int(n))
            continue
        rest -= cap * n * size
        least, most = math.ceil((need - rest) / size), math.floor(need / size)
        if least <= most:
            copies = min(max(round(n * rate + error / size), least), most)
        else:
            copies = most if need - most * size - rest <= least * size - need else least
        copies = int(min(max(copies, 0), cap * n))
        error += (n * rate - copies) * size
        need -= copies * size
        out.append(copies)
    return out


def mix(docs: DataFrame, carry: tuple[str, ...] = (), weights: tuple[int, ...] = WEIGHTS, cap: int = CAP) -> DataFrame:
    """Every row with ``doc_id, size, source_size, target, rate, copies, taken`` and ``carry`` in the struct ``row``.

    Size counts words. Entropy balancing gives every document of a source the rate ``min(cap, exp(dual * size))``; the
    rates are rounded into copies over the source's histogram of lengths, longest first with the error carried on, so
    a source's tokens miss their target by less than its shortest document where whole copies allow it. Copies go to the documents of a length by
    rank of a hash, spread over slices. The histogram has a row for each length of a source, which longer documents
    and not more documents add to; the driver sees one number a source.

    Null texts and texts without words have size 0, rate and copies 1 and take nothing. A null source is a source, the
    last. Sources without any words have target 0. Rows that repeat an id are taken on their own. Empty input gives an
    empty result.
    """
    rows = docs.select(
        "doc_id", F.col("source").cast("string").alias("source"), F.size(words(body())).cast("long").alias("size"),
    )
    lengths = stored(rows.groupBy("source", "size").agg(F.count("*").alias("n")))
    sums = lengths.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("t"), F.sum("n").alias("n")).collect()
    sizes = {r["source"]: r["t"] for r in sums}
    goal = targets(sizes, weights, cap)
    duals = solve(lengths, goal, cap)
    plan = docs.sparkSession.createDataFrame(
        [(s, sizes[s], goal[s], duals.get(s, 0.0)) for s in sizes],
        "s string, source_size long, target double, dual double",
    )
    same = F.col("source").eqNullSafe(F.col("s"))
    rate = F.least(F.lit(float(cap)), F.exp(F.least(F.col("dual") * F.col("size"), F.lit(5.0))))
    cells = lengths.join(plan, same).drop("s").withColumn("rate", rate)

    def rounded(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("size", ascending=False)
        return group.assign(copies=_rounded(group, cap))

    kind = T.StructType([*cells.schema.fields, T.StructField("copies", T.LongType())])
    ship(docs.sparkSession)
    cells = stored(cells.groupBy("source").applyInPandas(rounded, kind))
    marked = docs.select(
        "doc_id", F.col("source").cast("string").alias("source"), F.size(words(body())).cast("long").alias("size"),
        *([F.struct(*carry).alias("row")] if carry else []),
    )
    marked = marked.withColumn("source", F.struct("source"))
    cells = cells.withColumn("source", F.struct("source"))
    given = ranked(marked, ["source", "size"], ["doc_id"], sum(r["n"] for r in sums), cells)
    copies = F.expr("copies div n") + F.when(F.col("rank") < F.col("copies") % F.col("n"), 1).otherwise(0)
    return given.withColumn("copies", copies).select(
        "doc_id", "size", "source_size", "target", "rate", "copies",
        (F.col("copies") * F.col("size")).alias("taken"), *(["row"] if carry else []),
    )
