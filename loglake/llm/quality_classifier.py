"""A quality classifier that asks which dictionary, of good or of bad text, helps compression more."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loglake.llm.common import map_arrow, slices, stored

#: Labelled rows of a class that dictionaries and calibration are fitted on at most, those of the least id hash.
SAMPLE = 1_500
#: Pieces of a class that a dictionary is trained on at most, those of the least hash, from anywhere in whole texts.
PARTS = 4_096
#: Bytes of a dictionary.
DICTIONARY = 64 * 1024
#: Texts are compressed in pieces of so many bytes, each with the dictionary alone: a long text does not outgrow it.
PIECE = 2_048
LEVEL = 1
THRESHOLD = 0.3


@dataclass(frozen=True)
class Model:
    """Dictionaries of the two classes; the score is ``sigmoid(slope * difference + offset)``."""

    good: bytes
    bad: bytes
    slope: float
    offset: float


def compressors(good: bytes, bad: bytes) -> tuple[zstandard.ZstdCompressor, ...]:
    pair = []
    for content in (good, bad):
        dictionary = zstandard.ZstdCompressionDict(content)
        dictionary.precompute_compress(level=LEVEL)
        pair.append(zstandard.ZstdCompressor(dict_data=dictionary, write_content_size=False, write_dict_id=False))
    return tuple(pair)


def dictionary(texts: list[bytes]) -> bytes:
    """A trained dictionary; of too few or too short texts to train on, the texts themselves."""
    try:
        return zstandard.train_dictionary(DICTIONARY, texts).as_bytes()
    except zstandard.ZstdError:
        return b"\n".join(texts)[-DICTIONARY:].ljust(8, b" ")


def difference(text: str | None, pair: tuple[zstandard.ZstdCompressor, ...]) -> float:
    """How much smaller the good dictionary makes a whole text, as a share of its bytes; 0 for an empty one."""
    data = (text or "").encode("utf-8", "surrogatepass")
    if not data:
        return 0.0
    sizes = [sum(len(c.compress(data[at : at + PIECE])) for at in range(0, len(data), PIECE)) for c in pair]
    return (sizes[1] - sizes[0]) / len(data)


def calibrate(x: np.ndarray, y: np.ndarray, weights: np.ndarray) -> tuple[float, float]:
    """Slope and offset of a weighted logistic regression of one variable, by Newton steps with a small ridge."""
    weights = weights / weights.mean()
    scale = float(np.sqrt(np.cov(x, ddof=0, aweights=weights))) or 1.0
    features = np.stack([x / scale, np.ones_like(x)], 1)
    beta = np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(features @ beta, -30, 30)))
        gradient = features.T @ (weights * (p - y)) + 1e-2 * beta
        hessian = (features * (weights * p * (1 - p))[:, None]).T @ features + 1e-2 * np.eye(2)
        beta = beta - np.linalg.solve(hessian, gradient)
    return float(beta[0] / scale), float(beta[1])


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Whole texts in pieces; an empty text has one, an empty one."""
    for batch in slices(batches):
        quality, parts = [], []
        for q, text in zip(batch.column("quality").to_pylist(), batch.column("text").to_pylist(), strict=True):
            data = (text or "").encode("utf-8", "surrogatepass")
            found = [data[at : at + PIECE] for at in range(0, max(len(data), 1), PIECE)]
            quality += [q] * len(found)
            parts += found
        yield pa.RecordBatch.from_arrays([pa.array(quality, pa.int32()), pa.array(parts, pa.binary())], names=["quality", "part"])


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model | None:
    """A model from at most ``sample`` labelled documents of each class, or None where a class has none.

    Every second sampled document goes into the dictionary of its class, by pieces of its whole text, and the others,
    as whole texts, calibrate the score. There a class weighs as much as it has labelled rows in all of ``docs``,
    whatever the sample holds of it.
    """
    one = labels.where("doc_id IS NOT NULL AND quality IS NOT NULL").groupBy("doc_id").agg(
        F.min("quality").alias("quality"), F.max("quality").alias("other")
    )
    rows = docs.groupBy("doc_id").agg(F.count("*").alias("rows"))
    one = one.where("quality = other AND quality IN (0, 1)").select("doc_id", F.col("quality").cast("int").alias("quality"))
    one = stored(one.join(rows, "doc_id"))
    totals = {r["quality"]: r["rows"] for r in one.groupBy("quality").agg(F.sum("rows").alias("rows")).collect()}
    if len(totals) < 2:
        return None
    chosen = [one.where(F.col("quality") == q).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample) for q in (0, 1)]
    place = F.row_number().over(Window.partitionBy("quality").orderBy(F.xxhash64("doc_id"), "doc_id"))
    chosen = chosen[0].union(chosen[1]).select("doc_id", "quality", (place % 2).alias("odd"))
    found = stored(docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").drop("doc_id"))

    learned = map_arrow(found.where("odd = 1"), _parts, "quality int, part binary")
    classes = [
        learned.where(F.col("quality") == q).orderBy(F.xxhash64("part"), "part").limit(PARTS).collect() for q in (0, 1)
    ]
    bad, good = (dictionary([bytes(r["part"]) for r in x]) for x in classes)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair = compressors(good, bad)
        for batch in slices(batches):
            x = pa.array([difference(text, pair) for text in batch.column("text").to_pylist()], pa.float64())
            yield pa.RecordBatch.from_arrays([batch.column("quality"), batch.column("odd"), x], names=["quality", "odd", "x"])

    seen = map_arrow(found.select("quality", "odd", "text"), measure, "quality int, odd int, x double")
    seen = seen.groupBy("quality", "odd", "x").agg(F.count("*").alias("rows")).orderBy("quality", "odd", "x").collect()
    # a class with one document is calibrated on it
    rest = {q: [r for r in seen if r["quality"] == q and not r["odd"]] or [r for r in seen if r["quality"] == q] for q in (0, 1)}
    weights = [r["rows"] * totals[q] / sum(r["rows"] for r in rest[q]) for q in (0, 1) for r in rest[q]]
    x, y = ([r[c] for q in (0, 1) for r in rest[q]] for c in ("x", "quality"))
    slope, offset = calibrate(np.array(x), np.array(y, float), np.array(weights))
    return Model(good, bad, slope, offset)


def held_out(doc_id: Column, of: int) -> Column:
    """A row without id counts as one whose id is the empty text, and so is held out."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % of == 0


def classify(docs: DataFrame, model: Model | None) -> DataFrame:
    """``doc_id, difference, score, predicted`` for every row, from its whole text.

    A text is compressed with either dictionary; the difference of sizes, as a share of the text's bytes, becomes a
    calibrated score. Null and empty texts have no difference and get the score of none. Without a model all scores
    are 0.5. Equal texts get equal scores; other columns are not looked at.
    """
    if model is None:
        rows = docs.select("doc_id", F.lit(0.0).alias("difference"), F.lit(0.5).alias("score"))
        return rows.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair = compressors(model.good, model.bad)
        for batch in batches:
            x = np.array([difference(text, pair) for text in batch.column("text").to_pylist()], float)
            score = 1 / (1 + np.exp(-np.clip(model.slope * x + model.offset, -30, 30)))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(x), pa.array(score)], names=["doc_id", "difference", "score"]
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    scored = map_arrow(docs.select("doc_id", "text"), measure, f"doc_id {kind}, difference double, score double")
    return scored.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))
