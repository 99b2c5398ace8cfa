"""Language-model scores by online logistic context mixing, and a word-frequency base beside them."""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loglake.llm import bit_model as model
from loglake.llm.common import map_arrow, stored

#: Rows whose id hash leaves 0 are held out: nothing is learned from them.
HELD_OUT_OF = 10
#: Most frequent tokens, whose counts go to every worker (16 bytes each); the counts of all others are joined.
FREQUENT = 1 << 16
#: Byte triples, the most frequent ones, that codes are made from. Every byte has a code whatever this is.
TRIPLES = 1 << 19
#: Counts in a block of a table.
BLOCK = 1 << 13
SMOOTHING = 0.1
#: Bytes whose contexts are counted at a time.
GATHERED = 4 << 20

#: Hash of the token that ends a text; no word has a space in it.
END_TOKEN = xxhash.xxh64_intdigest(b" ") - (1 << 63)


def tokens(data: bytes) -> np.ndarray:
    """Hashes of a text's words, A-Z lower-cased, and of its end."""
    found = data.lower().split()
    out = np.empty(len(found) + 1, np.uint64)
    # xxh64 less 2**63, as a signed 64-bit number, is xxh64 with its top bit flipped
    out[:-1] = np.fromiter(map(xxhash.xxh64_intdigest, found), np.uint64, len(found))
    out[:-1] ^= np.uint64(1 << 63)
    out = out.view(np.int64)
    out[-1] = END_TOKEN
    return out


def _bytes(batch: pa.RecordBatch) -> list[bytes]:
    return [(t or "").encode("utf-8", "surrogatepass") for t in batch.column("text").to_pylist()]


def held_out(doc_id: Column, of: int = HELD_OUT_OF) -> Column:
    """A row without id counts as one whose id is the empty text, and so is held out."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % of == 0


def _occurrences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of tokens (kind 0) and of byte triples (kind 1) in each batch."""
    for batch in batches:
        texts = _bytes(batch)
        for part in model.chunks(texts, GATHERED):
            chosen = [texts[i] for i in part]
            words, n = np.unique(np.concatenate([tokens(t) for t in chosen]), return_counts=True)
            triples, m = model.triple_counts(chosen)
            kind = np.concatenate([np.zeros(len(words), np.int32), np.ones(len(triples), np.int32)])
            yield pa.RecordBatch.from_arrays(
                [pa.array(kind), pa.array(np.concatenate([words, triples.astype(np.int64)])),
                 pa.array(np.concatenate([n, m]).astype(np.int64))], names=["kind", "key", "n"],
            )


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Log odds of each block of slots, from the blocks that tasks have counted; holds one sum a block."""
    sums: dict[tuple[int, int], np.ndarray] = {}
    for batch in batches:
        for *at, data in zip(*(batch.column(c).to_pylist() for c in ("number", "block", "data")), strict=True):
            counts = np.frombuffer(zlib.decompress(data), np.int32)
            if tuple(at) in sums:
                sums[tuple(at)] += counts
            else:
                sums[tuple(at)] = counts.astype(np.int64)
    out = [(t, b, model.stretch(c).tobytes()) for (t, b), c in sums.items()]
    yield pa.RecordBatch.from_arrays(
        [pa.array([x[i] for x in out], kind) for i, kind in enumerate((pa.int32(), pa.int32(), pa.binary()))],
        names=["number", "block", "data"],
    )


def fit_tables(training: DataFrame, code: model.Code) -> list[np.ndarray]:
    """Log odds by slot of every predictor, from the bits of all of ``training``.

    A map task sends each block of counts that it has once, compressed; blocks are summed by many tasks, as a stream.
    The tables have a fixed size, whatever the corpus.
    """
    shared = training.sparkSession.sparkContext.broadcast(code)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = model.new_counts(shared.value)
        for batch in batches:
            texts = _bytes(batch)
            for part in model.chunks(texts, GATHERED):
                model.count_bits([texts[i] for i in part], shared.value, counts)
        for number, table in enumerate(counts):
            rows = [(b, table[b * BLOCK : (b + 1) * BLOCK]) for b in range(-(-len(table) // BLOCK))]
            rows = [(b, zlib.compress(part.tobytes(), 1)) for b, part in rows if part.any()]
            yield pa.RecordBatch.from_arrays(
                [pa.array([number] * len(rows), pa.int32()), pa.array([b for b, _ in rows], pa.int32()),
                 pa.array([d for _, d in rows], pa.binary())], names=["number", "block", "data"],
            )

    kind = "number int, block int, data binary"
    blocks = map_arrow(training.select("text"), count, kind).repartition("number", "block")
    tables = [np.zeros(n, np.int8) for n in (code.nodes, *(model.SLOTS for _ in model.ORDERS))]
    for r in map_arrow(blocks, _merged, kind).toLocalIterator():
        part = np.frombuffer(r["data"], np.int8)
        at = r["block"] * BLOCK // 2
        tables[r["number"]][at : at + len(part)] = part
    return tables


def lm_score(docs: DataFrame) -> DataFrame:
    """``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte`` for every row.

    ``score`` is the log10 probability that the mixed bit predictors give the whole text and its end: their tables are
    counted over all training rows, their weights adapt within each text from the same begin, so a score depends on
    nothing but the text and the tables. ``base_score`` sums smoothed log frequencies of tokens over the whole text;
    the counts of frequent tokens are looked up in the workers, those of all others are joined, each text's sums
    being combined before and after.

    Null and empty texts are an end alone. A row without id is held out. Rows that repeat are scored each. Without
    training rows all counts are 0 and every bit is as likely as not. Empty input gives an empty result; other columns
    are not looked at.
    """
    spark = docs.sparkSession
    rows = docs.select("doc_id", "text", held_out(F.col("doc_id")).alias("held_out"))
    training = rows.where("NOT held_out")
    seen = map_arrow(training.select("text"), _occurrences, "kind int, key long, n long")
    seen = stored(seen.groupBy("kind", "key").agg(F.sum("n").alias("n")))
    counts = seen.where("kind = 0").select("key", "n")
    total, distinct = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    total = int(total)
    floor = total + SMOOTHING * (distinct + 1)
    top = counts.orderBy(F.desc("n"), "key").limit(FREQUENT).toPandas().sort_values("key")
    frequent, often = top["key"].to_numpy(np.int64), top["n"].to_numpy(np.int64)

    found = seen.where("kind = 1").orderBy(F.desc("n"), "key").limit(TRIPLES).toPandas()
    triples = np.zeros(1 << 24, np.int64)
    triples[found["key"].to_numpy(np.int64)] = found["n"].to_numpy(np.int64)
    code = model.prefix_code(triples.reshape(1 << 16, 256))
    tables = fit_tables(training, code)
    shared = spark.sparkContext.broadcast((code, tables, frequent, np.log10((often + SMOOTHING) / floor)))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code, tables, frequent, logs = shared.value
        row = TaskContext.get().partitionId() << 40
        for batch in batches:
            texts = _bytes(batch)
            n, known, base, rare = [], [], [], []
            for text in texts:
                found = tokens(text)
                at = np.searchsorted(frequent, found)
                at[at == len(frequent)] = 0
                is_frequent = frequent[at] == found if len(frequent) else np.zeros(len(found), bool)
                n.append(len(found))
                known.append(int(is_frequent.sum()))
                base.append(float(logs[at[is_frequent]].sum()))
                rare.append(found[~is_frequent])
            losses = model.log_losses(texts, code, tables)
            sizes = np.array([len(t) + 1 for t in texts])
            offsets = np.concatenate([[0], np.cumsum([len(r) for r in rare])]).astype(np.int32)
            lists = pa.ListArray.from_arrays(
                pa.array(offsets), pa.array(np.concatenate(rare) if rare else np.empty(0, np.int64))
            )
            columns = {
                "row": pa.array(np.arange(row, row + len(texts))),
                "doc_id": batch.column("doc_id"),
                "held_out": batch.column("held_out"),
                "n_tokens": pa.array(n, pa.int64()),
                "n_frequent": pa.array(known, pa.int64()),
                "base": pa.array(base, pa.float64()),
                "rare": lists,
                "score": pa.array(-losses / math.log(10)),
                "bits_per_byte": pa.array(losses / math.log(2) / sizes),
            }
            row += len(texts)
            yield pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))

    kind = rows.schema["doc_id"].dataType.simpleString()
    scored = stored(
        map_arrow(
            rows,
            score,
            f"row long, doc_id {kind}, held_out boolean, n_tokens long, n_frequent long, base double, "
            "rare array<long>, score double, bits_per_byte double",
        )
    )
    rest = scored.select("row", F.explode("rare").alias("key")).join(counts, "key", "left")
    logs = F.log10((F.coalesce("n", F.lit(0)) + SMOOTHING) / F.lit(floor))
    sums = rest.groupBy("row").agg(
        F.sum(logs).alias("rest"),
        F.count("n").alias("n_rest"),
    )
    return scored.join(sums, "row", "left").select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("n_frequent") + F.coalesce("n_rest", F.lit(0))).alias("n_known"),
        F.lit(total).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("rest", F.lit(0.0))).alias("base_score"),
        "score",
        "bits_per_byte",
    )
