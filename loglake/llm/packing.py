"""Packing by shortest pack first over the histogram of lengths."""

from __future__ import annotations

import bisect
from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loglake.llm.common import map_arrow, ranked, slices, stored
from loglake.llm.tokens import loaded, token_ids

SEQUENCE = 1024
#: The id after each document.
END = 0


def pieces(docs: DataFrame, tokenizer: str, limit: int = SEQUENCE) -> DataFrame:
    """Rows of ``docs`` as token pieces: ``doc_id, start, length, ids, doc_tokens``.

    A document's ids (little-endian unsigned 32-bit numbers in ``ids``) are those of its whole text and then ``END``;
    pieces of ``limit`` follow one another, the last may be shorter. Null and empty texts are the end id alone. Other
    columns are not looked at.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = loaded(tokenizer)
        end = END.to_bytes(4, "little")
        for batch in slices(batches):
            row, start, length, ids, total = [], [], [], [], []
            texts = [t or "" for t in batch.column("text").to_pylist()]
            for i, found in enumerate(token_ids(texts, known)):
                found = found.tobytes() + end
                for at in range(0, len(found), 4 * limit):
                    part = found[at : at + 4 * limit]
                    row.append(i)
                    start.append(at // 4)
                    length.append(len(part) // 4)
                    ids.append(part)
                    total.append(len(found) // 4)
            columns = [batch.column("doc_id").take(pa.array(row, pa.int32())), pa.array(start, pa.int64()),
                       pa.array(length, pa.int64()), pa.array(ids, pa.binary()), pa.array(total, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "start", "length", "ids", "doc_tokens"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return map_arrow(
        docs.select("doc_id", "text"), cut, f"doc_id {kind}, start long, length long, ids binary, doc_tokens long"
    )


def pack_lengths(histogram: dict[int, int], limit: int = SEQUENCE) -> list[tuple[int, list[int]]]:
    """Patterns ``(count, lengths)`` that hold each length of ``histogram`` as often as it says.

    Longest lengths come first. Each goes to the open packs with the most room (the shortest packs), as many at once as
    there are of either; a count of packs is split when fewer pieces than packs are left. What finds no room opens new
    packs. Works on counts only, so its cost depends on ``limit`` and not on the number of pieces.
    """
    open_: dict[int, list[tuple[int, list[int]]]] = defaultdict(list)
    rooms: list[int] = []
    done: list[tuple[int, list[int]]] = []

    def put(count: int, lengths: list[int], room: int) -> None:
        if not room:
            done.append((count, lengths))
            return
        if not open_[room]:
            bisect.insort(rooms, room)
        open_[room].append((count, lengths))

    for length in sorted(histogram, reverse=True):
        left = histogram[length]
        while left:
            if rooms and rooms[-1] >= length:
                room = rooms[-1]
                count, lengths = open_[room].pop()
                if not open_[room]:
                    rooms.pop()
                used = min(left, count)
                if count > used:
                    put(count - used, lengths, room)
                new, room = [*lengths, length], room - length
            else:
                used, new, room = left, [length], limit - length
            left -= used
            put(used, new, room)
    return done + [x for room in rooms for x in open_[room]]


def slots(patterns: list[tuple[int, list[int]]]) -> dict[int, list[tuple[int, int, int]]]:
    """By length: ``(first rank, first sequence, offset)`` of each place that the patterns have for it."""
    out: dict[int, list[tuple[int, int, int]]] = defaultdict(list)
    used: dict[int, int] = defaultdict(int)
    sequence = 0
    for count, lengths in patterns:
        offset = 0
        for length in lengths:
            out[length].append((used[length], sequence, offset))
            used[length] += count
            offset += length
        sequence += count
    return out


def pack(parts: DataFrame, limit: int = SEQUENCE) -> DataFrame:
    """``parts`` (``doc_id, start, length`` and any payload) with ``sequence_id`` and ``offset``.

    The histogram has at most ``limit`` rows, whatever the size of the corpus; patterns are made from it on the driver,
    and pieces find their place in them by their rank among the pieces of equal length. Empty input gives an empty
    result; pieces that are equal get places in any order.
    """
    lengths = parts.groupBy("length").agg(F.count("*").alias("n"))
    histogram = {r["length"]: r["n"] for r in lengths.collect()}
    places = slots(pack_lengths(histogram, limit))
    placed = ranked(parts, ["length"], ["doc_id", "start"], sum(histogram.values()), lengths)
    known = dict(places)

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sequence, offset = [], []
            for length, rank in zip(batch.column("length").to_pylist(), batch.column("rank").to_pylist(), strict=True):
                found = known[length]
                first, start, at = found[bisect.bisect_right(found, rank, key=lambda x: x[0]) - 1]
                sequence.append(start + rank - first)
                offset.append(at)
            rest = batch.drop_columns(["rank"])
            yield pa.RecordBatch.from_arrays(
                [*rest.columns, pa.array(sequence, pa.int64()), pa.array(offset, pa.int64())],
                names=[*rest.schema.names, "sequence_id", "offset"],
            )

    kind = parts.select(*parts.columns).schema.add("sequence_id", "long").add("offset", "long")
    return map_arrow(placed.select(*parts.columns, "rank"), find, kind)


def packed(docs: DataFrame, tokenizer: str, limit: int = SEQUENCE) -> DataFrame:
    """All rows of ``docs`` packed: ``doc_id, start, length, ids, doc_tokens, sequence_id, offset``."""
    return pack(stored(pieces(docs, tokenizer, limit)), limit)
