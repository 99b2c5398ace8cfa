"""Language identification in two steps: the family of languages first, then the language within its family."""

from __future__ import annotations

import json
from collections.abc import Iterator, Mapping
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loglake.llm.common import map_arrow, ship, slices, stored

#: Families of languages by code; a language that is not listed is a family of its own.
FAMILIES = {
    "en": "germanic", "de": "germanic", "nl": "germanic", "sv": "germanic", "da": "germanic", "no": "germanic",
    "fr": "romance", "es": "romance", "it": "romance", "pt": "romance", "ca": "romance", "ro": "romance",
    "ru": "slavic", "uk": "slavic", "bg": "slavic", "pl": "slavic", "cs": "slavic", "sk": "slavic",
    "fi": "uralic", "et": "uralic", "hu": "uralic", "tr": "turkic", "az": "turkic", "kk": "turkic",
}
#: Distinct labelled rows of a language that the models are fitted on at most, those of the least hash.
SAMPLE = 1_000
#: Hash buckets of byte n-grams of 1 to 3 bytes.
BUCKETS = 1 << 13
ORDERS = (1, 2, 3)
#: Bytes whose n-grams are hashed at a time.
BLOCK = 1 << 20
REGULARISATION = 1e-4
ROUNDS = 200
#: Steepness of the logistic function that turns a margin into a share.
STEEP = 4.0
UNKNOWN = "und"

#: ASCII characters other than letters become spaces, A-Z become a-z; all bytes beyond ASCII stay.
LETTERS = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


#: Linear functions of the n-gram features by pairs of classes; one is positive for the first of its pair.
Pairs = Mapping[tuple[str, str], tuple[np.ndarray, float]]


@dataclass(frozen=True)
class Model:
    """Languages by family, and the linear functions between families, and between languages of a family."""

    members: Mapping[str, tuple[str, ...]]
    families: Pairs
    languages: Pairs


def has_letter(text: str | None) -> bool:
    return any(map(str.isalpha, text or ""))


def buckets(data: bytes, most: int) -> np.ndarray:
    """Bucket of every n-gram that begins in the first ``most`` bytes."""
    x = np.frombuffer(data, np.uint8).astype(np.uint32)
    found = []
    for n in ORDERS:
        size = max(0, min(most, len(x) - n + 1))
        key = np.full(size, n, np.uint32)
        for i in range(n):
            key = key * np.uint32(257) + x[i : i + size]
        found.append((key * np.uint32(2_654_435_761)) >> np.uint32(33 - BUCKETS.bit_length()))
    return np.concatenate(found)


def features(text: str | None) -> np.ndarray:
    """Square roots of the shares that the buckets have in a whole text: a vector of length 1, or 0 of no letter."""
    words = (text or "").lower().encode("utf-8", "surrogatepass").translate(LETTERS).split()
    counts = np.zeros(BUCKETS)
    if not words:
        return counts
    data = b" " + b" ".join(words) + b" "
    for at in range(0, len(data), BLOCK):
        counts += np.bincount(buckets(data[at : at + BLOCK + ORDERS[-1] - 1], BLOCK), minlength=BUCKETS)
    return np.sqrt(counts / counts.sum())


def separate(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, float]:
    """Weights and offset of a linear support vector machine with squared hinge loss, by accelerated gradient steps.

    ``y`` is 1 or -1; both classes weigh the same. Rows have length 1, which bounds the curvature.
    """
    x = np.hstack([x, np.ones((len(x), 1), x.dtype)])
    share = np.where(y > 0, 0.5 / max(1, (y > 0).sum()), 0.5 / max(1, (y < 0).sum()))
    w = before = np.zeros(x.shape[1])
    for i in range(ROUNDS):
        at = w + i / (i + 3) * (w - before)
        slack = np.maximum(0, 1 - y * (x @ at.astype(x.dtype)))
        gradient = REGULARISATION * at - 2 * ((share * y * slack).astype(x.dtype) @ x)
        before, w = w, at - gradient / (4 + REGULARISATION)
    return w[:-1], float(w[-1])


def _featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, 64):
        rows = [features(t) for t in batch.column("text").to_pylist()]
        at = [np.flatnonzero(r) for r in rows]
        yield pa.RecordBatch.from_arrays(
            [batch.column("lang"), batch.column("place"), pa.array([a.astype(np.int32).tobytes() for a in at], pa.binary()),
             pa.array([r[a].astype(np.float32).tobytes() for r, a in zip(rows, at, strict=True)], pa.binary())],
            names=["lang", "place", "at", "share"],
        )


def _sample(docs: DataFrame, sample: int) -> DataFrame:
    """``lang, place, text`` of at most ``sample`` distinct rows a language: those of the least hash.

    Hashes spread evenly, so about two and a half samples lie below that part of their range; only those texts move.
    One number a language goes to the driver and back.
    """
    rows = docs.select("lang", "text", F.xxhash64("doc_id", "text").alias("key"))
    rows = rows.where(F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}"))
    counts = rows.groupBy("lang").agg(F.approx_count_distinct("key").alias("n")).collect()
    top = (1 << 63) - 1
    bounds = {r["lang"]: min(top, -(1 << 63) + int((1 << 64) * min(1.0, 2.5 * sample / r["n"]))) for r in counts}
    bound = F.from_json(F.lit(json.dumps(bounds)), "map<string,bigint>")  # folded into one literal
    near = rows.where(F.col("key") <= bound[F.col("lang")])
    near = near.groupBy("lang", "key").agg(F.first("text").alias("text"))
    place = F.row_number().over(Window.partitionBy("lang").orderBy("key"))
    return near.withColumn("place", place).where(F.col("place") <= sample).select("lang", "place", "text")


def fit(docs: DataFrame, families: Mapping[str, str] = FAMILIES, sample: int = SAMPLE) -> Model | None:
    """A model from at most ``sample`` distinct rows of each language; None where no row has a language and a letter.

    Every pair of families, and of languages of a family, is separated by a task of its own, on at most ``sample`` rows
    of either side; a family's are dealt evenly to its languages. Both sides weigh the same, whatever share of all rows
    they have. Rows without language or without a letter teach nothing; a row that repeats counts once.
    """
    chosen = map_arrow(_sample(docs, sample), _featured, "lang string, place int, at binary, share binary")
    chosen = stored(chosen)
    members: dict[str, tuple[str, ...]] = {}
    for row in chosen.select("lang").distinct().orderBy("lang").collect():
        family = families.get(row["lang"], f"={row['lang']}")
        members[family] = (*members.get(family, ()), row["lang"])
    if not members:
        return None
    # who teaches which pair, on which side, with how many rows
    lessons = []
    for first, second in combinations(sorted(members), 2):
        for family, side in ((first, 1), (second, -1)):
            rows = -(-sample // len(members[family]))
            lessons += [("family", first, second, lang, side, rows) for lang in members[family]]
    for known in members.values():
        for first, second in combinations(known, 2):
            lessons += [("language", first, second, lang, side, sample) for lang, side in ((first, 1), (second, -1))]
    if not lessons:
        return Model(members, {}, {})

    def learn(group: pd.DataFrame) -> pd.DataFrame:
        x = np.zeros((len(group), BUCKETS), np.float32)
        for i, (at, share) in enumerate(zip(group["at"], group["share"], strict=True)):
            x[i, np.frombuffer(at, np.int32)] = np.frombuffer(share, np.float32)
        w, offset = separate(x, group["side"].to_numpy())
        return pd.DataFrame({**{c: [group[c].iloc[0]] for c in pair}, "weights": [w.tobytes()], "offset": [offset]})

    pair = ["level", "first", "second"]
    spark = docs.sparkSession
    ship(spark)
    told = spark.createDataFrame(lessons, "level string, first string, second string, lang string, side int, rows int")
    taught = chosen.join(told, "lang").where("place <= rows")
    learned = taught.groupBy(*pair).applyInPandas(
        learn, "level string, first string, second string, weights binary, offset double"
    )
    found: dict[str, dict] = {"family": {}, "language": {}}
    for r in learned.collect():
        found[r["level"]][r["first"], r["second"]] = (np.frombuffer(r["weights"]), r["offset"])
    return Model(members, found["family"], found["language"])


def vote(x: np.ndarray, classes: tuple[str, ...], pairs: Pairs) -> tuple[str, float]:
    """The class that wins most of its pairs, and its mean share in them; ties go to the larger share, then by name."""
    votes, shares = dict.fromkeys(classes, 0), dict.fromkeys(classes, 0.0)
    for first, second in combinations(classes, 2):
        w, offset = pairs[first, second]
        share = 1 / (1 + np.exp(-np.clip(STEEP * (w @ x + offset), -30, 30)))
        votes[first if share > 0.5 else second] += 1
        shares[first] += share
        shares[second] += 1 - share
    best = min(classes, key=lambda c: (-votes[c], -shares[c], c))
    return best, float(shares[best] / (len(classes) - 1)) if len(classes) > 1 else 1.0


def decide(x: np.ndarray, model: Model) -> tuple[str, float]:
    """The language of a feature vector: its family first, then the language in it. The score is both shares' product."""
    family, likely = vote(x, tuple(sorted(model.members)), model.families)
    lang, share = vote(x, model.members[family], model.languages)
    return lang, likely * share


def held_out(doc_id: Column) -> Column:
    """A row without id counts as one whose id is the empty text: its remainder is 0, and it may teach."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % 3 == 1


def predict(docs: DataFrame, model: Model | None) -> DataFrame:
    """``doc_id, lang_pred, score`` for every row, from its whole text.

    Byte n-grams of the whole text, letters only, are counted in blocks, so a very long text takes bounded memory
    beside itself. Null texts and texts without a letter are ``und`` with score 0, and so is everything without a
    model. Rows that repeat are told each, equal texts equally; other columns are not looked at. Empty input gives an
    empty result.
    """

    shared = docs.sparkSession.sparkContext.broadcast(model)

    def tell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in slices(batches):
            known = [
                decide(features(t), model) if model and has_letter(t) else (UNKNOWN, 0.0)
                for t in batch.column("text").to_pylist()
            ]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array([k[0] for k in known], pa.string()),
                 pa.array([k[1] for k in known], pa.float64())], names=["doc_id", "lang_pred", "score"],
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return map_arrow(docs.select("doc_id", "text"), tell, f"doc_id {kind}, lang_pred string, score double")
