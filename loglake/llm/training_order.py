"""Token sequences in a keyed training order, as binary shards of fixed stride."""

from __future__ import annotations

import json
from collections import defaultdict
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loglake.llm.common import let, map_arrow, shared_dir, slices, stored
from loglake.llm.tokens import PieceIds, loaded, token_ids

SEQUENCE = 1024
#: Slots of a shard; a shard is written and read by one task.
SHARD = 8192
#: The id after each document, which also fills the last sequence.
END = 0
ROUNDS = 6


def _round(right: np.ndarray, key: int, number: int, mask: int) -> np.ndarray:
    z = right + np.uint64((key * 0x9E3779B97F4A7C15 + number * 0xD1B54A32D192ED03) % (1 << 64))
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return (z ^ (z >> np.uint64(31))) & np.uint64(mask)


def permute(numbers: np.ndarray, n: int, key: int, back: bool = False) -> np.ndarray:
    """The keyed place of each number below ``n`` in a permutation of all of them, or the way ``back``.

    A balanced Feistel network permutes the least even power of two that holds ``n`` values; what falls outside is
    sent through again until it is inside, which takes less than four turns on average. Nothing is stored or sorted.
    """
    half = max(1, ((max(n, 2) - 1).bit_length() + 1) // 2)
    mask = (1 << half) - 1
    out = np.asarray(numbers, np.uint64).copy()
    todo = np.arange(len(out))
    while len(todo):
        left, right = out[todo] >> np.uint64(half), out[todo] & np.uint64(mask)
        for i in reversed(range(ROUNDS)) if back else range(ROUNDS):
            if back:
                left, right = right ^ _round(left, key, i, mask), left
            else:
                left, right = right, left ^ _round(right, key, i, mask)
        out[todo] = (left << np.uint64(half)) | right
        todo = todo[out[todo] >= n]
    return out.astype(np.int64)


def _rows(docs: DataFrame) -> DataFrame:
    """``doc_id, text`` with the input split a row is from; rows that are not read from files are written first."""
    split = (F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"))
    try:
        return docs.select("doc_id", "text", *split)
    except AnalysisException:
        return stored(docs.select("doc_id", "text")).select("doc_id", "text", *split)


def _tokenised(batch: pa.RecordBatch, known: PieceIds) -> Iterator[tuple]:
    """Ids, file and block of each row."""
    found = token_ids([t or "" for t in batch.column("text").to_pylist()], known)
    return zip(found, batch.column("file").to_pylist(), batch.column("block").to_pylist(), strict=True)


def _lengths(rows: DataFrame, tokenizer: str) -> DataFrame:
    """``file, block, at, doc_id, n``: tokens of every row with its end, and its place in its split."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, seen = loaded(tokenizer), defaultdict(int)
        for batch in slices(batches):
            at, n = [], []
            for found, *split in _tokenised(batch, known):
                at.append(seen[tuple(split)])
                seen[tuple(split)] += 1
                n.append(len(found) + 1)
            columns = [batch.column("file"), batch.column("block"), pa.array(at, pa.int64()), batch.column("doc_id"),
                       pa.array(n, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=["file", "block", "at", "doc_id", "n"])

    kind = rows.schema["doc_id"].dataType.simpleString()
    return stored(map_arrow(rows, count, f"file string, block long, at long, doc_id {kind}, n long"))


def materialise(
    docs: DataFrame, path: str, tokenizer: str, key: int, sequence: int = SEQUENCE, shard: int = SHARD
) -> DataFrame:
    """Writes all documents as token sequences in training order and returns which documents each holds.

    The ids of all documents, each with an end id, form one stream in the order of input splits and rows; it is cut
    into sequences. Sequence ``i`` of ``n`` goes to slot ``permute(i, n, key)``. Shard ``s`` holds the slots from
    ``s * shard``, in order, a record each: ``sequence`` unsigned little-endian 16-bit ids and a line feed, so that a
    reader finds slot ``x`` at byte ``x % shard * stride``, and can go on from any slot. ``path/manifest`` says so.

    Texts are tokenised twice, so that ids are shuffled once and never staged: first for lengths, of which one sum an
    input split reaches the driver, then to be dealt to shards. Recomputed tasks yield the same records, as a row's
    place depends on its split alone. Returned: ``slot, sequence_id, shard, byte_offset, doc_ids``. Null and empty
    texts are an end id; repeated rows are written as often as they come; an empty table gives no shards. Other
    columns are not looked at.
    """
    rows = _rows(docs)
    lengths = _lengths(rows, tokenizer)
    splits = sorted(
        (r["file"], r["block"], r["n"]) for r in lengths.groupBy("file", "block").agg(F.sum("n").alias("n")).collect()
    )
    starts = dict(zip(((f, b) for f, b, _ in splits), accumulate((n for *_, n in splits), initial=0), strict=False))
    total = sum(n for *_, n in splits)
    n = -(-total // sequence)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, position = loaded(tokenizer), dict(starts)
        for batch in slices(batches):
            numbers, offsets, ids = [], [], []
            for found, *split in _tokenised(batch, known):
                if len(found) and found.max() > 0xFFFF:
                    raise ValueError("a token id does not fit 16 bits")
                found = np.append(found, END).astype("<u2").tobytes()
                start = position[tuple(split)]
                position[tuple(split)] = start + len(found) // 2
                done = 0
                while done < len(found):
                    offset = (start + done // 2) % sequence
                    part = found[done : done + 2 * (sequence - offset)]
                    numbers.append((start + done // 2) // sequence)
                    offsets.append(offset)
                    ids.append(part)
                    done += len(part)
            slots = permute(np.array(numbers, np.uint64), n, key)
            yield pa.RecordBatch.from_arrays(
                [pa.array(slots), pa.array(offsets, pa.int32()), pa.array(ids, pa.binary())],
                names=["slot", "offset", "ids"],
            )

    def records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Pieces in order of slot and offset, joined into records."""
        slot, parts = None, []

        def flush() -> bytes:
            value = b"".join(parts)
            return value + END.to_bytes(2, "little") * (sequence - len(value) // 2)

        for batch in batches:
            out = []
            for s, part in zip(batch.column("slot").to_pylist(), batch.column("ids").to_pylist(), strict=True):
                if s != slot and parts:
                    out.append((slot // shard, flush()))
                    parts = []
                slot = s
                parts.append(part)
            yield _records(out)
        if parts:
            yield _records([(slot // shard, flush())])

    pieces = map_arrow(rows, deal, "slot long, offset int, ids binary")
    shards = max(1, -(-n // shard))
    ordered = pieces.repartitionById(shards, (F.col("slot") / shard).cast("int")).sortWithinPartitions("slot", "offset")
    values = map_arrow(ordered, records, "shard long, value binary")
    values.select("shard", F.col("value").cast("string")).write.partitionBy("shard").text(f"{path}/shards")
    about = {"sequences": n, "tokens": total, "sequence": sequence, "shard": shard, "key": key,
             "stride": 2 * sequence + 1, "dtype": "<u2", "tokenizer": tokenizer.rsplit("/", 1)[-1]}
    spark = docs.sparkSession
    spark.createDataFrame([(json.dumps(about),)], "value string").coalesce(1).write.text(f"{path}/manifest")
    return _contents(lengths, starts, sequence, shard, n, key)


def _records(out: list[tuple[int, bytes]]) -> pa.RecordBatch:
    columns = [pa.array([s for s, _ in out], pa.int64()), pa.array([v for _, v in out], pa.binary())]
    return pa.RecordBatch.from_arrays(columns, names=["shard", "value"])


def _contents(lengths: DataFrame, starts: dict, sequence: int, shard: int, n: int, key: int) -> DataFrame:
    spark = lengths.sparkSession
    bases = spark.createDataFrame([(f, b, s) for (f, b), s in starts.items()], "file string, block long, base long")
    before = Window.partitionBy("file", "block").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    placed = lengths.withColumn("start", F.coalesce(F.sum("n").over(before), F.lit(0))).join(bases, ["file", "block"])
    start = F.col("base") + F.col("start")
    number = F.explode(F.sequence((start / sequence).cast("long"), ((start + F.col("n") - 1) / sequence).cast("long")))
    held = placed.select("doc_id", start.alias("start"), number.alias("sequence_id"))
    held = held.groupBy("sequence_id").agg(F.sort_array(F.collect_list(F.struct("start", "doc_id"))).alias("docs"))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            slots = permute(batch.column("sequence_id").to_numpy(zero_copy_only=False), n, key)
            columns = [pa.array(slots), batch.column("sequence_id"), pa.array(slots // shard),
                       pa.array(slots % shard * (2 * sequence + 1)), batch.column("doc_ids")]
            names = ["slot", "sequence_id", "shard", "byte_offset", "doc_ids"]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    kind = lengths.schema["doc_id"].dataType.simpleString()
    return map_arrow(
        held.select("sequence_id", F.col("docs.doc_id").alias("doc_ids")),
        place,
        f"slot long, sequence_id long, shard long, byte_offset long, doc_ids array<{kind}>",
    )


def manifest(spark: SparkSession, path: str) -> dict:
    return json.loads(spark.read.text(f"{path}/manifest").first()["value"])


def read_slots(spark: SparkSession, path: str) -> DataFrame:
    """``slot, ids_crc32`` of every record in the shards at ``path``, and whether it ends as a record must."""
    about = manifest(spark, path)
    stride, shard = about["stride"], about["shard"]
    schema = "path string, modificationTime timestamp, length long, content binary"
    files = spark.read.format("binaryFile").schema(schema).option("pathGlobFilter", "part-*").load(f"{path}/shards")
    number = F.regexp_extract("path", "shard=([0-9]+)", 1).cast("long")
    last = (F.col("length") / stride).cast("int") - 1

    def records(content):
        return F.transform(
            F.sequence(F.lit(0), last),
            lambda i: F.struct(
                (number * shard + i).alias("slot"),
                F.crc32(F.substring(content, i * stride + 1, F.lit(stride - 1))).alias("ids_crc32"),
                (F.substring(content, (i + 1) * stride, F.lit(1)) == F.lit(b"\n")).alias("whole"),
            ),
        )

    # a column is copied each time it is read, the variable of ``let`` is not
    rows = files.where(F.col("length") > 0).select(F.explode(let(F.col("content"), records)).alias("x"))
    return rows.select("x.*")


def training_order(docs: DataFrame, tokenizer: str, key: int) -> DataFrame:
    """Shards written to a new shared folder, and each slot with its documents and the checksum read back from there."""
    path = shared_dir(docs.sparkSession)
    contents = materialise(docs, path, tokenizer, key)
    return contents.join(read_slots(docs.sparkSession, path), "slot")
