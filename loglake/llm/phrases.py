"""Collocations: frequent phrases counted by tries of candidates, and ranked by their weakest cut."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loglake.llm.common import map_arrow, shared_dir, slices, spread_join, stored

LEAST = 30
LONGEST = 4
TOP = 2_000
UNKNOWN = "und"

#: Words of a dictionary that is sent to the workers at a time, and edges of a trie (some 15 MB).
ENTRIES, EDGES = 1 << 20, 1 << 18
#: A trie covers so many ids of parents, and of words: what its arrays are indexed by.
SPAN_BITS = 20
#: Words of a blob, of the blobs that are counted together, and of those that a trie is read for; a longer text makes a
#: longer blob.
BLOB, GATHERED, STEPPED = 1 << 15, 1 << 20, 1 << 22
#: Bytes of blobs that go to a worker at a time, and of a row group of them: what a task holds outside Python.
BATCH, ROW_GROUP = 4 << 20, 4 << 20
#: Distinct words that a task holds counts of.
HELD = 200_000
#: Words of the corpus for each shard that counts of candidates are summed in.
SHARD = 1 << 21

#: A-Z become a-z, tabs spaces; what ends a piece becomes the line feed.
CLEAN = bytes(10 if chr(c) in ".,;:!?\n\v\f\r" else 32 if c == 9 else c + 32 if 65 <= c <= 90 else c for c in range(256))
END = b"\n"


def symbols(text: str | None) -> list[bytes]:
    """Words and piece ends of a text, in order."""
    data = (text or "").encode("utf-8", "surrogatepass").translate(CLEAN).replace(END, b" \n ")
    return [w for w in data.split(b" ") if w]


def planes(x: np.ndarray) -> bytes:
    """Numbers with their first bytes together, then their second ones, and so on: what compresses well."""
    return np.ascontiguousarray(x.view(np.uint8).reshape(-1, x.itemsize).T).tobytes()


def unplaned(data, kind: type = np.int32) -> np.ndarray:
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(size, -1).T).view(kind).ravel()


def double_array(parent: np.ndarray, symbol: np.ndarray, parents: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``base, check, slot``: edge i lies at ``slot[i] = base[parent[i]] + symbol[i]``, where ``check`` is its parent.

    Edges are distinct. Parents with many edges get room of their own; for those with a few, bases are drawn until no
    edge meets another's; those with one edge fill the holes. A parent without edges has base -1.
    """
    order = np.lexsort((symbol, parent))
    node, first, degree = np.unique(parent[order], return_index=True, return_counts=True)
    least, most = symbol[order][first], symbol[order][first + degree - 1]
    width = int(most.max()) + 1
    own = degree >= 16
    span = np.where(own, most - least + 1, 0)
    room = width + int(span.sum())
    size = room + sum(f * int(degree[(degree >= f) & (degree < 2 * f)].sum()) for f in (1, 2, 4, 8)) + 1
    base, check = np.full(parents, -1, np.int32), np.full(size + width, -1, np.int32)
    base[node[own]] = (width + np.cumsum(span) - span - least)[own]

    def edges(which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Edges of the nodes, and for each edge the place of its node in ``which``."""
        owner = np.repeat(np.arange(len(which)), degree[which])
        within = np.arange(len(owner)) - np.repeat(np.cumsum(degree[which]) - degree[which], degree[which])
        return order[first[which][owner] + within], owner

    at, _ = edges(np.flatnonzero(own))
    check[base[parent[at]] + symbol[at]] = parent[at]
    random = np.random.default_rng(1)
    left = np.flatnonzero(~own & (degree > 1))
    left = left[np.argsort(-degree[left], kind="stable")]
    tries = 0
    while len(left):
        turn = left[2 * degree[left] > degree[left[0]]]
        rest = left[len(turn) :]
        tries += 1
        if tries % 100 == 0:  # little room is left: twice as much
            check = np.concatenate([check, np.full(len(check), -1, np.int32)])
        drawn = random.integers(0, len(check) - width, len(turn))
        at, owner = edges(turn)
        slot = drawn[owner] + symbol[at]
        # a free slot that several edges want goes to the first of them; a node needs all of its slots
        _, winner = np.unique(slot, return_index=True)
        lost = np.ones(len(slot), bool)
        lost[winner] = check[slot[winner]] >= 0
        placed = np.ones(len(turn), bool)
        placed[owner[lost]] = False
        fits = placed[owner]
        base[node[turn[placed]]] = drawn[placed]
        check[slot[fits]] = parent[at[fits]]
        left = np.concatenate([turn[~placed], rest])
    at, _ = edges(np.flatnonzero(~own & (degree == 1)))
    holes = width + np.flatnonzero(check[width:] < 0)
    if len(holes) < len(at):
        holes = np.concatenate([holes, np.arange(len(check), len(check) + len(at))])
        check = np.concatenate([check, np.full(len(at), -1, np.int32)])
    base[parent[at]] = holes[: len(at)] - symbol[at]
    check[holes[: len(at)]] = parent[at]
    return base, check, base[parent] + symbol


class Trie:
    """Edges ``(parent, word) -> child`` in two double arrays: by the upper part of a word's id, then by its low byte.

    Ids of parents and words lie within ``SPAN_BITS`` bits of the given least ones.
    """

    def __init__(self, parent: np.ndarray, word: np.ndarray, child: np.ndarray, least_parent: int, least_word: int):
        self.least_parent, self.least_word = least_parent, least_word
        parent, word = parent - least_parent, word - least_word
        pairs, of = np.unique(parent.astype(np.int64) << 32 | word >> 8, return_inverse=True)
        self.upper = double_array(pairs >> 32, pairs & 0xFFFFFFFF, int(parent.max()) + 1)
        *self.lower, slot = double_array(self.upper[2][of], word & 255, len(self.upper[1]))
        self.upper = self.upper[:2]
        self.child = np.zeros(len(self.lower[1]), np.int32)
        self.child[slot] = child

    def step(self, state: np.ndarray, word: np.ndarray) -> np.ndarray:
        """The child of each state by each word; 0 where there is none, as for state and word 0."""
        out = np.zeros(len(state), np.int32)
        at = np.flatnonzero((state > 0) & (word > 0))
        parent, key = state[at] - self.least_parent, word[at] - self.least_word
        inside = (parent >= 0) & (parent < len(self.upper[0])) & (key >= 0)
        at, parent, key = at[inside], parent[inside], key[inside]
        for (base, check), shift, mask in ((self.upper, 8, -1), (self.lower, 0, 255)):
            begin = base[parent]
            slot = begin + (key >> shift & mask)
            hit = np.flatnonzero((begin >= 0) & (slot < len(check)))
            hit = hit[check[slot[hit]] == parent[hit]]
            at, key, parent = at[hit], key[hit], slot[hit]
        out[at] = self.child[parent]
        return out


def _words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of words by language; the null word has the count of all words."""
    held: dict[str, Counter] = {}

    def out() -> pa.RecordBatch:
        rows = []
        for lang, counts in held.items():
            counts.pop(END, None)
            rows += [(lang, None, counts.total()), *((lang, w, n) for w, n in counts.items())]
        held.clear()
        columns = zip(*rows, strict=True) if rows else ((), (), ())
        kinds = (pa.string(), pa.binary(), pa.int64())
        return pa.RecordBatch.from_arrays(
            [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["lang", "word", "n"]
        )

    for batch in slices(batches):
        for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist(), strict=True):
            held.setdefault(lang, Counter()).update(symbols(text))
        if sum(map(len, held.values())) > HELD:
            yield out()
    yield out()


@contextmanager
def _small_batches(spark: SparkSession) -> Iterator[None]:
    """While it lasts, workers get ``BATCH`` bytes at a time, and not Spark's 64 MB."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(BATCH))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def _kept(df: DataFrame) -> DataFrame:
    """``common.stored`` for arrays of ids, which another compression makes much smaller; row groups are small."""
    path = shared_dir(df.sparkSession)
    with _small_batches(df.sparkSession):
        df.write.option("compression", "zstd").option("parquet.block.size", ROW_GROUP).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _lent(shared):
    """The value of a broadcast variable, which the worker does not keep: it is read again the next time."""
    value = shared.value
    if getattr(shared, "_path", None):  # under encryption it can be read only once
        vars(shared).pop("_value", None)
    return value


def _numbered(rows: DataFrame, order: list[str], total: int) -> DataFrame:
    """``rows`` with an ``id`` from 1, without gaps: slices by hash, numbered each, begin where those before them end."""
    parts = max(8, total // 100_000)
    sliced = rows.withColumn("_part", F.pmod(F.xxhash64(*order), F.lit(parts)))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sliced.groupBy("_part").agg(F.count("*").alias("_n"))
    starts = starts.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    place = F.row_number().over(Window.partitionBy("_part").orderBy(*order))
    numbered = sliced.withColumn("_place", place).join(starts, "_part")
    return numbered.withColumn("id", (F.col("_start") + F.col("_place")).cast("int")).drop("_part", "_place", "_start")


class _Dictionary:
    """Rows of ``lang, word, id``, which become ids by language and word where they are sent to; the driver keeps columns."""

    def __init__(self, rows: pa.Table):
        self.rows = rows

    def __reduce__(self):
        return _by_language, (self.rows,)


def _by_language(rows: pa.Table) -> dict[str, dict[bytes, int]]:
    known: dict[str, dict[bytes, int]] = {}
    for batch in rows.to_batches(max_chunksize=4096):
        for lang, word, number in zip(*(column.to_pylist() for column in batch.columns), strict=True):
            known.setdefault(lang, {})[word] = number
    return known


def _encoded(docs: DataFrame, words: DataFrame, total: int) -> DataFrame:
    """Blobs: 32-bit word ids (``planes``) of whole texts, one after another, each ended by 0.

    Words that are not frequent are 0, as ends of pieces are: no frequent phrase holds them. Of the dictionary at most
    ``ENTRIES`` words are sent at a time; with more, the texts are passed over again for the rest of them.
    """
    spark = docs.sparkSession
    shards = max(1, -(-total // ENTRIES))
    rows = docs.withColumn("words", F.lit(None).cast("binary"))
    for shard in range(shards):
        part = words.where(F.pmod(F.xxhash64("word"), F.lit(shards)) == shard).select("lang", "word", "id")
        rows = _looked_up(rows, spark.sparkContext.broadcast(_Dictionary(part.toArrow())), shard == shards - 1)
    return rows


def _looked_up(rows: DataFrame, shared, last: bool) -> DataFrame:
    def look_up(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, list[np.ndarray]]]:
        known = shared.value
        for batch in slices(batches):
            found = []
            for lang, text, before in zip(*(batch.column(c).to_pylist() for c in ("lang", "text", "words")), strict=True):
                get = known.get(lang, {}).get
                ids = np.array([get(w, 0) for w in symbols(text)] + [0], np.int32)
                found.append(ids if before is None else np.maximum(ids, unplaned(before)))
            yield batch, found

    def go_on(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, found in look_up(batches):
            ids = pa.array([planes(x) for x in found], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column("lang"), batch.column("text"), ids], names=["lang", "text", "words"])

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        size = 0
        for _, found in look_up(batches):
            for ids in found:
                held.append(ids)
                size += len(ids)
                if size >= BLOB:
                    yield pa.RecordBatch.from_arrays([pa.array([planes(np.concatenate(held))], pa.binary())], names=["words"])
                    held, size = [], 0
        if held:
            yield pa.RecordBatch.from_arrays([pa.array([planes(np.concatenate(held))], pa.binary())], names=["words"])

    if last:
        return _kept(map_arrow(rows, gather, "words binary"))
    return _kept(map_arrow(rows, go_on, "lang string, text string, words binary"))


def _arrays(batch: pa.RecordBatch, *columns: str) -> Iterator[tuple[np.ndarray | None, ...]]:
    for values in zip(*(batch.column(c) for c in columns), strict=True):
        yield tuple(unplaned(v.as_buffer()) if v.is_valid else None for v in values)


def _packed(keys: np.ndarray, counts: np.ndarray, shards: int) -> pa.RecordBatch:
    """Sorted keys and their counts, compressed, in a row for each shard that a key's hash names."""
    shard = ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)) % np.uint64(shards)
    order = np.argsort(shard, kind="stable")
    numbers, starts = np.unique(shard[order], return_index=True)
    press = zstandard.ZstdCompressor(level=1).compress
    rows = []
    for number, part in zip(numbers.tolist(), np.split(order, starts[1:]) if len(order) else [], strict=True):
        gaps = np.diff(keys[part], prepend=0)
        rows.append((number, press(planes(gaps)), press(planes(counts[part]))))
    columns = zip(*rows, strict=True) if rows else ((), (), ())
    kinds = (pa.int32(), pa.binary(), pa.binary())
    return pa.RecordBatch.from_arrays(
        [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["shard", "keys", "counts"]
    )


def _summed(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    key, of = np.unique(np.concatenate(keys), return_inverse=True)
    return key, np.bincount(of, np.concatenate(counts)).astype(np.int64)


def _tally(blobs: DataFrame, length: int, least: int, words: int, shards: int) -> DataFrame:
    """``parent, word, n``: how often each state accepts (word 0), and candidates of one word more.

    Where a phrase of ``length`` words and the one that begins a word later are both frequent, they make a candidate.
    Counts of either are summed over some blobs at a time, and then over all by shards of the keys; candidates below
    ``least`` go. ``words`` is the number of frequent words.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []

        def out() -> pa.RecordBatch:
            state, word = (np.concatenate([h[i] for h in held]) for i in (0, 1))
            held.clear()
            keys = [state[state > 0].astype(np.int64) * (words + 1)]
            if length < LONGEST:
                after = word[length:]
                at = np.flatnonzero((state[: len(after)] > 0) & (state[1 : len(after) + 1] > 0) & (after > 0))
                keys.append(state[at].astype(np.int64) * (words + 1) + after[at])
            return _packed(*np.unique(np.concatenate(keys), return_counts=True), shards)

        size = 0
        for batch in batches:
            for state, word in _arrays(batch, "state" if length > 1 else "words", "words"):
                held.append((state, word))
                size += len(state)
                if size >= GATHERED:
                    yield out()
                    size = 0
        if held:
            yield out()

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpress = zstandard.ZstdDecompressor().decompress
        held: tuple[list, list] = ([], [])
        now = None

        def out() -> pa.RecordBatch:
            keys, n = _summed(*held)
            parent, word = np.divmod(keys, words + 1)
            kept = (word == 0) | (n >= least)
            columns = (parent[kept].astype(np.int32), word[kept].astype(np.int32), n[kept])
            return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["parent", "word", "n"])

        for batch in batches:
            for shard, keys, counts in zip(*(batch.column(c).to_pylist() for c in ("shard", "keys", "counts")), strict=True):
                if held[0] and shard != now:
                    yield out()
                    held = ([], [])
                now = shard
                held[0].append(np.cumsum(unplaned(unpress(keys), np.int64)))
                held[1].append(unplaned(unpress(counts), np.int64))
        if held[0]:
            yield out()

    packed = map_arrow(blobs, count, "shard int, keys binary, counts binary")
    packed = packed.repartition(shards, "shard").sortWithinPartitions("shard")
    with _small_batches(blobs.sparkSession):
        return stored(map_arrow(packed, add, "parent int, word int, n long"))


def _cells(edges: DataFrame) -> list[tuple[int, int, int, int, int]]:
    """``up, first, last, shard, shards``: parents of ``SPAN_BITS`` bits, a range of words within as many, and a share.

    Ranges are made of blocks of words, and end before they have more than ``EDGES``. A block that alone has more is dealt
    by both ids. Narrow ranges make dense tries.
    """
    low = max(0, SPAN_BITS - 10)
    counts = edges.groupBy(F.expr(f"parent >> {SPAN_BITS}").alias("up"), F.expr(f"word >> {low}").alias("block")).count()
    ranges: list[list[int]] = []
    for up, block, n in counts.orderBy("up", "block").collect():
        same = ranges and ranges[-1][0] == up and ranges[-1][1] << low >> SPAN_BITS == block << low >> SPAN_BITS
        if same and ranges[-1][3] + n <= EDGES:
            ranges[-1][2:] = [block, ranges[-1][3] + n]
        else:
            ranges.append([up, block, block, n])
    return [
        (up, first << low, (last + 1 << low) - 1, shard, shards)
        for up, first, last, n in ranges
        for shards in [-(-n // EDGES)]
        for shard in range(shards)
    ]


def _advanced(blobs: DataFrame, edges: DataFrame, length: int) -> DataFrame:
    """``words, state``: at every place the id of the candidate of ``length`` words that begins there, or 0.

    A trie holds the edges of a cell (see ``_cells``). The blobs are passed over once. With several tries, a worker
    holds some blobs and one trie at a time.
    """
    spark = blobs.sparkSession
    bits = SPAN_BITS
    tries = []
    for up, first, last, shard, shards in _cells(edges):
        part = edges.where(f"parent >> {bits} = {up} AND word BETWEEN {first} AND {last} AND (parent ^ word) % {shards} = {shard}")
        part = part.select("parent", "word", "id").toArrow()
        if len(part):
            trie = Trie(*(c.to_numpy().astype(np.int64) for c in part.columns), up << bits, first)
            tries.append((up, first, last, shard, shards, spark.sparkContext.broadcast(trie)))
            del trie
    before, asked = "state" if length > 2 else "words", length < LONGEST  # after the last level no word more is asked for
    enough = STEPPED if len(tries) > 1 else 1

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []

        def out() -> Iterator[pa.RecordBatch]:
            for up, first, last, shard, shards, shared in tries:
                trie = None  # the one before goes first
                trie = _lent(shared) if len(tries) > 1 else shared.value
                for _, found, at, parent, word in held:
                    inside = np.flatnonzero((parent >> bits == up) & (word >= first) & (word <= last))
                    if shards > 1:
                        inside = inside[(parent[inside] ^ word[inside]) % shards == shard]
                    found[at[inside]] = trie.step(parent[inside], word[inside])
            for words, found, *_ in held:
                ids = (planes(words) if asked else b"", planes(found))
                yield pa.RecordBatch.from_arrays([pa.array([x], pa.binary()) for x in ids], names=["words", "state"])

        size = 0
        for batch in batches:
            for words, state in _arrays(batch, "words", before):
                parent, word = state[: max(0, len(words) - length + 1)], words[length - 1 :]
                at = np.flatnonzero((parent > 0) & (word > 0)).astype(np.int32)
                held.append((words, np.zeros(len(words), np.int32), at, parent[at], word[at]))
                size += len(words)
                if size >= enough:
                    yield from out()
                    held.clear()
                    size = 0
        yield from out() if held else ()

    stepped = _kept(map_arrow(blobs, step, "words binary, state binary"))
    for *_, shared in tries:
        shared.destroy()
    return stepped


def frequent_phrases(docs: DataFrame, least: int = LEAST) -> tuple[DataFrame, DataFrame]:
    """``lang, phrase, size, f`` of every phrase of 1 to 4 words that occurs ``least`` times, and ``lang, n`` of all words."""
    rows = docs.select(F.coalesce("lang", F.lit(UNKNOWN)).alias("lang"), "text")
    seen = map_arrow(rows, _words, "lang string, word binary, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))
    seen = stored(seen.where(f"word IS NULL OR n >= {least}"))
    words = seen.where("word IS NOT NULL")
    total = words.count()
    size = seen.where("word IS NULL").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    shards = max(16, size // SHARD)
    words = stored(_numbered(words, ["lang", "word"], total))
    names = words.select(F.col("id").alias("word"), F.col("word").cast("string").alias("last"))
    level = words.select("id", "lang", F.col("word").cast("string").alias("phrase"), F.col("n").alias("f"))
    levels = [level.withColumn("size", F.lit(1))]
    blobs = _encoded(rows, words, total)
    tally = _tally(blobs, 1, least, total, shards)
    for length in range(2, LONGEST + 1):
        edges = tally.where("word > 0")
        count = edges.count()
        if not count:
            break
        edges = stored(_numbered(edges, ["parent", "word"], count))
        blobs = _advanced(blobs, edges, length)
        tally = _tally(blobs, length, least, total, shards)
        accepted = tally.where("word = 0").select(F.col("parent").alias("id"), F.col("n").alias("f"))
        above = level.select(F.col("id").alias("parent"), "lang", "phrase")
        named = spread_join(spread_join(edges.select("id", "parent", "word"), above, "parent", ["id"]), names, "word", ["id"])
        level = stored(
            named.join(accepted, "id").select("id", "lang", F.concat_ws(" ", "phrase", "last").alias("phrase"), "f")
        )
        levels.append(level.withColumn("size", F.lit(length)))
    found = levels[0]
    for level in levels[1:]:
        found = found.unionByName(level)
    return found.drop("id"), seen.where("word IS NULL").select("lang", "n")


def collocations(docs: DataFrame, least: int = LEAST, top: int = TOP) -> DataFrame:
    """``lang, rank, phrase, a, l, r, n, score`` of each language's first ``top`` phrases of 2 to 4 words.

    Words are counted first. Then, level by level, phrases whose words, and whose shorter phrases, are all frequent
    make the candidates; tries of them advance a state at every place of all whole texts, and accepting states are
    counted. A phrase's score is that of its weakest cut. Phrases that mostly occur inside a longer one go.

    A null language is ``und``; null and empty texts have no words. Rows that repeat count each time. A very long text
    is encoded whole. Ties are settled by the order that the columns state. Empty input gives an empty result; other
    columns are not looked at.
    """
    found, totals = frequent_phrases(docs, least)
    key = lambda phrase: F.concat(phrase, F.lit("\n"), F.col("lang"))  # noqa: E731  no word has a line feed
    counted = stored(found.select("lang", "phrase", "size", "f"))
    of = counted.select(key(F.col("phrase")).alias("key"), "f")
    phrases = counted.where("size > 1").select("lang", "phrase", "size", F.col("f").alias("a"))

    words = F.split("phrase", " ")
    part = lambda begin, n: F.array_join(F.slice("words", begin, n), " ")
    cuts = phrases.withColumn("words", words).withColumn("cut", F.explode(F.sequence(F.lit(1), F.col("size") - 1)))
    cuts = cuts.select("lang", "phrase", "a", "cut", key(part(F.lit(1), F.col("cut"))).alias("left"),
                       key(part(F.col("cut") + 1, F.col("size") - F.col("cut"))).alias("right"))
    for side, name in (("left", "l"), ("right", "r")):
        cuts = spread_join(cuts, of.select(F.col("key").alias(side), F.col("f").alias(name)), side, ["phrase", "cut"])
    exact = lambda c: F.col(c).cast("decimal(19,0)")
    cuts = cuts.withColumn("whole", exact("a") * F.lit(2_000_000).cast("decimal(8,0)")).withColumn("parts", exact("l") + exact("r"))
    cuts = cuts.withColumn("score", F.expr("whole div parts"))
    best = cuts.groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "cut", "l", "r")).alias("best"))

    inner = counted.where("size > 2").withColumn("words", words)
    inner = inner.withColumn("length", F.explode(F.sequence(F.lit(2), F.col("size") - 1)))
    inner = inner.withColumn("begin", F.explode(F.sequence(F.lit(1), F.col("size") - F.col("length") + 1)))
    inner = inner.select("lang", part(F.col("begin"), F.col("length")).alias("phrase"), "f")
    inner = inner.groupBy("lang", "phrase").agg(F.max("f").alias("longer"))
    kept = best.join(inner, ["lang", "phrase"], "left")
    hundred, eighty = (F.lit(n).cast("decimal(3,0)") for n in (100, 80))
    kept = kept.where(F.col("longer").isNull() | (hundred * exact("longer") < eighty * exact("a")))

    order = Window.partitionBy("lang").orderBy(F.desc("best.score"), F.desc("a"), "phrase")
    ranked = kept.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top).join(totals, "lang")
    return ranked.select(
        "lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", F.col("best.l").alias("l"),
        F.col("best.r").alias("r"), "n", F.col("best.score").alias("score"),
    )
