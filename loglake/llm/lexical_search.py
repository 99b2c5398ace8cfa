"""Ranked lexical search: exact top documents by integer term weights, through blocks of similar documents.

A shard is a run of documents as a task reads them. In it every term's posting list is cut into blocks of documents
that are alike, and a block has a summary: for every other term the most that one of its documents gets for it. An
item's terms are visited from the weightiest on; a block is skipped only where its summary, added up over the item's
terms, is below the score that the item's tenth document has by then. All documents left out so have a lower score.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loglake.llm.common import map_arrow, slices, stored

#: Documents of an item's result.
TOP = 10
#: Terms of the items that are searched together, at most, if they are several; each group reads the documents again.
TERMS = 1 << 14
#: Documents of a shard at most, and cells of its table of documents by terms.
SHARD, CELLS = 1_024, 1 << 22
#: Documents of a block at most; a shard has a cluster for as many documents, and blocks end where clusters do.
BLOCK = 24

#: What parts terms becomes a space, A-Z become a-z; all bytes beyond ASCII belong to terms.
CLEAN = bytes(
    c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else c + 32 if 65 <= c <= 90 else 32 for c in range(256)
)


def terms(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(CLEAN).split()


def weight(documents: int, frequency: int) -> int:
    return math.floor(1000 * math.log((2 * documents + 2) / (2 * frequency + 1)))


def gains(tf: np.ndarray, n: np.ndarray, documents: int, length: int) -> np.ndarray:
    """What a term of weight 1 adds to a document's score."""
    m = 100 - 90 + (90 * n * documents) // length
    return (1_000_000_000 * tf) // (1_000 * tf + 8 * m)


def _groups(items: list[list[bytes]]) -> Iterator[list[int]]:
    """Items that are searched together."""
    part: list[int] = []
    seen: set[bytes] = set()
    for i, found in enumerate(items):
        if part and len(seen.union(found)) > TERMS:
            yield part
            part, seen = [], set()
        part.append(i)
        seen.update(found)
    if part:
        yield part


def _forward(docs: DataFrame, known) -> DataFrame:
    """``doc_id, n, at, tf``: a document's number of terms, and those of the items' terms that it has."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        get = known.value.get
        for batch in slices(batches):
            n, at, tf = [], [], []
            for text in batch.column("text").to_pylist():
                found = terms(text)
                numbers = np.array([get(t, -1) for t in found], np.int32)
                unique, counts = np.unique(numbers[numbers >= 0], return_counts=True)
                n.append(len(found))
                at.append(unique.tobytes())
                tf.append(counts.astype(np.int32).tobytes())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(at, pa.binary()), pa.array(tf, pa.binary())],
                names=["doc_id", "n", "at", "tf"],
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return stored(map_arrow(docs.select("doc_id", "text"), count, f"doc_id {kind}, n long, at binary, tf binary"))


def _frequencies(forward: DataFrame) -> dict[int, int]:
    """Documents that have each of the items' terms."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            numbers = np.frombuffer(b"".join(batch.column("at").to_pylist()), np.int32)
            term, n = np.unique(numbers, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(term, pa.int32()), pa.array(n, pa.int64())], names=["term", "n"])

    seen = map_arrow(forward.select("at"), count, "term int, n long").groupBy("term").agg(F.sum("n").alias("n"))
    return {r["term"]: r["n"] for r in seen.collect()}


class Shard:
    """Documents by terms, and each term's posting list in blocks of similar documents with their summaries."""

    def __init__(self, scores: np.ndarray):
        self.scores = scores
        rows = len(scores)
        shape = scores.astype(np.float32)
        shape /= np.maximum(np.sqrt((shape * shape).sum(1, keepdims=True)), 1e-9)
        seeds = shape[np.linspace(0, rows - 1, max(1, rows // BLOCK)).astype(int)]
        # documents by the seed that they are most like, and within that by how much
        like = shape @ seeds.T
        self.cluster = like.argmax(1)
        self.order = np.lexsort((-like.max(1), self.cluster))
        self.most = scores.max(0)
        self._blocks: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}

    def blocks(self, term: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The term's documents, like by like, where blocks begin, and the largest score of each block by term."""
        if term not in self._blocks:
            docs = self.order[self.scores[self.order, term] > 0]
            cluster = self.cluster[docs]
            begins = np.flatnonzero(np.diff(cluster, prepend=-1))
            place = np.arange(len(docs)) - np.repeat(begins, np.diff(np.append(begins, len(docs))))
            starts = np.flatnonzero(place % BLOCK == 0)
            self._blocks[term] = docs, starts, np.maximum.reduceat(self.scores[docs], starts, axis=0)
        return self._blocks[term]

    def search(self, item: np.ndarray, floor: int, best: list[tuple[int, int]], ids: np.ndarray, top: int) -> int:
        """Adds to the heap ``best`` of (score, minus id) what belongs there; the score that then must be reached."""
        item = item[np.argsort(-self.most[item], kind="stable")]
        rest = np.cumsum(self.most[item][::-1])[::-1]
        done = np.zeros(len(self.scores), bool)
        for term, left in zip(item, rest, strict=True):
            # documents without the terms before have no more than what is left
            if not left or left < floor:
                break
            docs, starts, summary = self.blocks(int(term))
            bound = summary[:, item].sum(1)
            inside = np.repeat(bound >= max(floor, 1), np.diff(np.append(starts, len(docs))))
            docs = docs[inside]
            docs = docs[~done[docs]]
            done[docs] = True
            found = self.scores[np.ix_(docs, item)].sum(1)
            for i in np.flatnonzero(found >= floor):
                entry = (int(found[i]), -int(ids[docs[i]]))
                if len(best) < top:
                    heapq.heappush(best, entry)
                elif entry > best[0]:
                    heapq.heapreplace(best, entry)
            if len(best) == top:
                floor = best[0][0]
        return floor


def _search(forward: DataFrame, shared) -> DataFrame:
    """``item, doc_id, score``: the best documents that a task has for each item."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items, weights, documents, length, top = shared.value
        rows = max(16, min(SHARD, CELLS // max(1, len(weights))))
        best: list[list[tuple[int, int]]] = [[] for _ in items]
        floors = [0] * len(items)
        for batch in slices(batches, rows):
            ids = batch.column("doc_id").to_numpy(zero_copy_only=False)
            n = batch.column("n").to_numpy()
            scores = np.zeros((batch.num_rows, len(weights)), np.int64)
            for i, (at, tf) in enumerate(zip(batch.column("at"), batch.column("tf"), strict=True)):
                at, tf = (np.frombuffer(x.as_buffer(), np.int32).astype(np.int64) for x in (at, tf))
                scores[i, at] = weights[at] * gains(tf, n[i], documents, length)
            shard = Shard(scores)
            for i, item in enumerate(items):
                floors[i] = shard.search(item, floors[i], best[i], ids, top)
        out = [(i, -e[1], e[0]) for i, found in enumerate(best) for e in found]
        columns = zip(*out, strict=True) if out else ((), (), ())
        kinds = (pa.int32(), pa.int64(), pa.int64())
        yield pa.RecordBatch.from_arrays(
            [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["item", "doc_id", "score"]
        )

    return map_arrow(forward, find, "item int, doc_id long, score long")


def search(docs: DataFrame, items: DataFrame, top: int = TOP) -> DataFrame:
    """``item_id, rank, doc_id, score``: for each row of ``items`` the ``top`` documents with a score above 0.

    The index holds every document with a term and those of its terms that an item of the group asks for. Scores are
    integers and exact: equal ones rank by ascending id. A null text has no term; an item without terms, or whose terms
    nobody has, has no rows. A document without id counts in the statistics and is not ranked. Rows that repeat are
    documents of their own, and items that repeat are answered each. A very long text is read whole; what is kept of it
    is bounded by the items' terms. Without items or documents the result is empty; other columns are not looked at.
    """
    spark = docs.sparkSession
    asked = [(r["item_id"], list(dict.fromkeys(terms(r["text"])))) for r in items.select("item_id", "text").toLocalIterator()]
    kind = items.schema["item_id"].dataType.simpleString()
    result = spark.createDataFrame([], f"item_id {kind}, rank int, doc_id long, score long")
    for part in _groups([t for _, t in asked]):
        vocabulary = sorted({t for i in part for t in asked[i][1]})
        number = {t: i for i, t in enumerate(vocabulary)}
        forward = _forward(docs, spark.sparkContext.broadcast(number))
        documents, length = forward.where("n > 0").agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
        if not documents or not vocabulary:
            continue
        frequency = _frequencies(forward)
        weights = np.array([weight(documents, frequency.get(i, 0)) for i in range(len(vocabulary))], np.int64)
        wanted = [np.array(sorted(number[t] for t in asked[i][1]), np.int64) for i in part]
        shared = spark.sparkContext.broadcast((wanted, weights, documents, int(length), top))
        kept = forward.where("n > 0 AND doc_id IS NOT NULL")
        found = _search(kept.select(F.col("doc_id").cast("long").alias("doc_id"), "n", "at", "tf"), shared)
        place = F.row_number().over(Window.partitionBy("item").orderBy(F.desc("score"), "doc_id"))
        found = found.where("score > 0").withColumn("rank", place).where(F.col("rank") <= top)
        names = spark.createDataFrame([(i, asked[n][0]) for i, n in enumerate(part)], f"item int, item_id {kind}")
        result = result.unionByName(found.join(names, "item").select("item_id", "rank", "doc_id", "score"))
    return result
