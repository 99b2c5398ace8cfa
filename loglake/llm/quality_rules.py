"""Quality rules: plain text statistics, and a hashed n-gram log-likelihood ratio between two corpora."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loglake.llm.common import body, let, stored, words

BUCKETS = 16_384
#: N-grams that the corpus lends the target, so that a small target says little of what it happens not to have.
PRIOR = 200_000
#: Trusted documents the target is counted from at most, those of the least id hash; sixteen bytes each are broadcast.
TRUSTED = 20_000
#: Mean log-likelihood ratio of an n-gram below which a document is rejected.
THRESHOLD = -0.05


def word_arrays(docs: DataFrame, *columns) -> DataFrame:
    """``docs`` with ``body``, its words ``w``, and hashes of runs of one, two and three words, ``h1, h2, h3``.

    Each array is computed in a projection of its own and used from there.
    """
    out = docs.select(*columns, body().alias("body"), words(body()).alias("w"))
    out = out.withColumn("h1", F.transform("w", lambda x: F.xxhash64(x)))
    for n in (2, 3):
        shorter = F.slice(f"h{n - 1}", 1, F.greatest(F.size("w") - n + 1, F.lit(0)))
        out = out.withColumn(
            f"h{n}", F.zip_with(shorter, F.slice("h1", n, F.size("w")), lambda x, y: F.xxhash64(x, y))
        )
    return out


def met_twice(keyed: Column) -> Column:
    """Places of the keys that occur twice or more in an array of (key, at): sorted, equal keys are neighbours."""
    both = let(
        F.sort_array(keyed),
        lambda s: F.zip_with(
            F.slice(s, 1, F.size(s) - 1),
            F.slice(s, 2, F.size(s)),
            lambda x, y: F.when(x["key"] == y["key"], F.array(x["at"], y["at"])),
        ),
    )
    return F.array_distinct(F.flatten(F.filter(both, lambda x: x.isNotNull())))


def repeat_words() -> Column:
    """Words inside three-word windows that occur twice or more.

    Nothing repeats where all window hashes differ. Elsewhere hashes are sorted with the places in their low bits; the
    windows whose high bits have an equal neighbour are then compared as text.
    """
    bits = 28
    w, h3 = F.col("w"), F.col("h3")
    placed = F.transform(h3, lambda x, i: F.shiftleft(F.shiftright(x, bits), bits).bitwiseOR(i.cast("long")))
    near = let(
        F.sort_array(placed),
        lambda s: F.zip_with(
            F.slice(s, 1, F.size(s) - 1),
            F.slice(s, 2, F.size(s)),
            lambda x, y: F.when(F.shiftright(x, bits) == F.shiftright(y, bits), F.array(x, y)),
        ),
    )
    place = F.lit((1 << bits) - 1).cast("long")
    like = F.array_distinct(F.flatten(F.filter(near, lambda x: x.isNotNull())))
    windows = F.transform(
        F.transform(like, lambda x: x.bitwiseAND(place).cast("int")),
        lambda i: F.struct(F.concat_ws(" ", w[i], w[i + 1], w[i + 2]).alias("key"), i.alias("at")),
    )
    covered = F.flatten(F.transform(met_twice(windows), lambda i: F.array(i, i + 1, i + 2)))
    return F.when(F.size(h3) == F.size(F.array_distinct(h3)), F.lit(0)).otherwise(F.size(F.array_distinct(covered)))


def base_statistics() -> dict[str, Column]:
    """``n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words`` of whole texts, from ``word_arrays``."""
    lines = F.filter(F.split("body", "\n"), lambda line: line.rlike(r"[^\x20\x09-\x0D]"))
    return {
        "n_words": F.size("w").cast("long"),
        "word_chars": F.length(F.array_join("w", "")).cast("long"),
        "n_symbols": F.regexp_count("body", F.lit("[#*$%&|<>]")).cast("long"),
        "n_dup_lines": let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long"),
        "n_repeat_words": repeat_words().cast("long"),
    }


def bucket(gram: Column) -> Column:
    return F.pmod(gram, F.lit(BUCKETS)).cast("int")


def trusted_ids(labels: DataFrame, limit: int = TRUSTED) -> DataFrame:
    """Ids labelled good by every label they have and never toxic; at most ``limit``, by hash, so that it is small."""
    good = labels.where("doc_id IS NOT NULL").groupBy("doc_id").agg(
        F.min("quality").alias("quality"), F.max("toxic").alias("toxic")
    )
    good = good.where("quality = 1 AND coalesce(toxic, 0) = 0").select(F.col("doc_id").alias("trusted_id"))
    return good.orderBy(F.xxhash64("trusted_id"), "trusted_id").limit(limit)


def fit_ratio(docs: DataFrame, trusted: DataFrame) -> Column:
    """log(trusted share / corpus share) of each bucket, as a constant array; the corpus is every row of ``docs``.

    The trusted share is smoothed with ``PRIOR`` n-grams drawn as the corpus is; 0 for a bucket that nothing fell in.

    N-grams are counted in the map tasks, so one row a bucket and task is shuffled, and the driver gets ``BUCKETS``
    rows whatever the size of the corpus. ``trusted`` has a bounded number of ids and is broadcast.
    """
    marked = word_arrays(docs, "doc_id").select("doc_id", F.concat("h1", "h2").alias("found"))
    marked = marked.join(F.broadcast(trusted), marked["doc_id"] == trusted["trusted_id"], "left")
    grams = marked.select(F.col("trusted_id").isNotNull().alias("good"), F.explode_outer("found").alias("gram"))
    # the outer form keeps the optimizer from computing the arrays once more for a filter on their number
    table = grams.where("gram IS NOT NULL").groupBy(bucket(F.col("gram")).alias("bucket")).agg(F.count("*").alias("raw"), F.count_if("good").alias("good"))
    found = {r["bucket"]: (r["good"], r["raw"]) for r in table.collect()}
    good, raw = (sum(x[i] for x in found.values()) for i in (0, 1))
    ratios = [0.0] * BUCKETS
    for b, (g, r) in found.items():
        share = r / raw
        ratios[b] = math.log((g + PRIOR * share) / (good + PRIOR) / share)
    return F.split(F.lit(",".join(f"{x:.9g}" for x in ratios)), ",").cast("array<double>")


def likelihood_ratio(ratios: Column) -> Column:
    """Mean log ratio over the n-grams of ``word_arrays``; 0 for a text without any."""
    total = F.lit(0.0)
    for h in ("h1", "h2"):
        total = F.aggregate(h, total, lambda acc, x: acc + F.get(ratios, bucket(x)))
    n = F.size("h1") + F.size("h2")
    return F.when(n > 0, total / n).otherwise(F.lit(0.0))


def quality_rules(
    docs: DataFrame, labels: DataFrame, carry: tuple[str, ...] = (), threshold: float = THRESHOLD
) -> DataFrame:
    """Every row of ``docs`` with its statistics, ``ratio`` and verdicts ``base_failed`` and ``kept``.

    Trusted-target and raw-corpus multinomials over hashed words and word pairs are fitted to trusted and to all rows; a document
    stays unless its base rules fail or its length-normalised ratio is below ``threshold``. The verdict on a text
    depends on nothing random. Null texts have no words and fail. Where nothing is trusted the target is flat and the
    ratio says nothing, so only base rules decide. Repeated rows get equal verdicts; empty input gives an empty
    result. Columns outside ``carry`` are not looked at; ``carry`` comes back as given in the struct ``row``.
    """
    trusted = stored(trusted_ids(labels))
    ratios = fit_ratio(docs, trusted) if trusted.limit(1).count() else None
    arrays = word_arrays(docs, "doc_id", *([F.struct(*carry).alias("row")] if carry else []))
    scored = arrays.select(
        "doc_id",
        # keeps a filter on the verdict above this projection; below, it would compute the arrays for every word
        F.monotonically_increasing_id().alias("_at"),
        *(c.alias(name) for name, c in base_statistics().items()),
        (F.lit(0.0) if ratios is None else likelihood_ratio(ratios)).alias("ratio"),
        *(["row"] if carry else []),
    )
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    kept = ~F.col("base_failed") & (F.col("ratio") >= threshold) & (F.col("_at") >= 0)
    return scored.withColumn("base_failed", failed).withColumn("kept", kept).drop("_at")
