"""Near duplicates by HyperMinHash: bands of compressed registers, a corrected estimate, then full sets."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loglake.llm.common import map_arrow, slices, spread_join, stored
from loglake.llm.components import connected_components
from loglake.llm.shingles import BANDS, REGISTERS, ROWS, estimate, folded, overlap, parity, registers, shingle_set

#: Sets are linked when 100 * intersection >= PERCENT * union.
PERCENT = 80
#: Standard errors by which an estimate may fall short of PERCENT before its pair is left unverified.
ERRORS = 5
#: Rows of a bucket that one task compares with the others at a time.
BLOCK = 512


def _sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        sizes, digests, sketches, bits, wide = [], [], [], [], []
        for text in batch.column("text").to_pylist():
            found = shingle_set(text)
            sizes.append(len(found))
            digests.append(xxhash.xxh3_128_digest(found.tobytes()) if len(found) else None)
            sketches.append(registers(found) if len(found) else None)
            whole = parity(found)
            bits.append(folded(whole).tolist() if len(found) else None)
            wide.append(whole.tolist() if len(whole) > 16 else None)
        columns = [batch.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(digests, pa.binary()),
                   pa.array(sketches, pa.binary()), pa.array(bits, pa.list_(pa.int64())),
                   pa.array(wide, pa.list_(pa.int64()))]
        yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n", "digest", "sketch", "bits", "wide"])


def _full_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        found = [shingle_set(text).tobytes() for text in batch.column("text").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(found, pa.binary())], names=["id", "full"])


def _likely(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs whose sizes allow a link and whose estimate is not far too low for one."""
    for batch in batches:
        keep = []
        for x, y, n, m in zip(*(batch.column(c).to_pylist() for c in ("su", "sv", "nu", "nv")), strict=True):
            error = (PERCENT / 100 * (1 - PERCENT / 100) / min(REGISTERS, max(n, m))) ** 0.5
            fits = 100 * min(n, m) >= PERCENT * max(n, m)
            keep.append(fits and estimate(x, y) >= PERCENT / 100 - ERRORS * error)
        yield batch.select(["u", "v"]).filter(pa.array(keep, pa.bool_()))


def _confirmed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keep = []
        for x, y in zip(batch.column("fu").to_pylist(), batch.column("fv").to_pylist(), strict=True):
            a, b = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
            both = overlap(a, b)
            keep.append(100 * both >= PERCENT * (len(a) + len(b) - both))
        yield batch.select(["u", "v"]).filter(pa.array(keep, pa.bool_()))


def _sides(pairs: DataFrame, table: DataFrame, columns: dict[str, str]) -> DataFrame:
    """``pairs`` (``u, v``) with columns of ``table`` (``id, ...``) for either side, named by their first letters."""
    for side in ("u", "v"):
        named = [F.col(c).alias(f"{short}{side}") for c, short in columns.items()]
        pairs = pairs.join(table.select(F.col("id").alias(side), *named), side)
    return pairs


def _linked(pairs: DataFrame, reps: DataFrame, sets: DataFrame) -> DataFrame:
    kind = pairs.select("u", "v").schema
    likely = map_arrow(_sides(pairs, reps, {"sketch": "s", "n": "n"}), _likely, kind)
    return stored(map_arrow(_sides(likely, sets, {"full": "f"}), _confirmed, kind))


def _may_link() -> Column:
    """Of rows ``a`` and ``b``: their sizes allow a link, and so do their parity bits; no link is lost.

    Sets with a Jaccard similarity of PERCENT differ in at most a share of (100 - PERCENT) / (100 + PERCENT) of their
    summed sizes, and their bits in no more places. The first 1,024 bits settle most pairs; those of long texts are
    compared over all their bits, folded to the width of the shorter.
    """
    n, m = F.col("a.n"), F.col("b.n")
    most = (100 - PERCENT) * (n + m)
    differ = lambda x, y: F.bit_count(x.bitwiseXOR(y))
    few = sum((differ(F.get("a.bits", F.lit(i)), F.get("b.bits", F.lit(i))) for i in range(16)), F.lit(0))
    size = F.least(F.size("a.wide"), F.size("b.wide"))

    def fold(x: Column) -> Column:
        half = F.zip_with(F.slice(x, 1, size), F.slice(x, size + 1, size), lambda p, q: p.bitwiseXOR(q))
        return F.when(F.size(x) > size, half).otherwise(x)

    each = F.zip_with(fold(F.col("a.wide")), fold(F.col("b.wide")), differ)
    all_ = F.aggregate(each, F.lit(0), lambda s, x: s + x)
    return (
        (100 * F.least(n, m) >= PERCENT * F.greatest(n, m))
        & ((100 + PERCENT) * few <= most)
        & (F.col("a.wide").isNull() | F.col("b.wide").isNull() | ((100 + PERCENT) * all_ <= most))
    )


def _possible(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """The pairs (``u, v``) that may be linked."""
    sides = pairs
    for side, name in (("u", "a"), ("v", "b")):
        summary = F.struct("n", "bits", "wide").alias(name)
        sides = sides.join(classes.select(F.col("id").alias(side), summary), side)
    return sides.where(_may_link()).select("u", "v")


def _labelled(bands: DataFrame, links: DataFrame) -> DataFrame:
    """Rows of ``bands`` with their component by ``links``."""
    found = connected_components(links)
    named = bands.join(found, bands["id"] == found["node"], "left")
    return named.select("key", "id", "leader", F.coalesce("component", "id").alias("component"))


def near_links(docs: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Sketches of all rows, classes of equal sets, and confirmed links that join all linked classes.

    Classes meet where a band of registers is equal. A bucket's leader is the class in it that meets most others over
    all bands, the likely origin of a group of copies. Each class first meets the best of its leaders, then those
    leaders that are still in another component; links join into components. Where a bucket still holds
    several components, its rows outside the largest are compared, block by block, with all rows of other components in
    it; pairs whose sizes or parity bits rule a link out are never made. So of two classes that share a band either a path
    of confirmed links joins them, or their own pair was tested. A large group of copies costs a pair a member and not
    all pairs.
    """
    kinds = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n long, digest binary, sketch binary, bits array<long>, wide array<long>"
    sketches = stored(map_arrow(docs.select("doc_id", "text"), _sketch, kinds))
    classes = sketches.where("n > 0 AND doc_id IS NOT NULL").groupBy("digest").agg(
        F.min("doc_id").alias("id"), F.min_by("sketch", "doc_id").alias("sketch"), F.max("n").alias("n"),
        F.min_by("bits", "doc_id").alias("bits"), F.min_by("wide", "doc_id").alias("wide"),
    )
    classes = stored(classes)
    reps = classes.select("id", "sketch", "n")
    width = 2 * ROWS
    band = F.explode(F.sequence(F.lit(0), F.lit(BANDS - 1))).alias("band")
    piece = F.expr(f"substring(sketch, band * {width} + 1, {width})")
    bands = reps.select("id", "sketch", band).select(F.xxhash64("band", piece).alias("key"), "id")
    shared = bands.groupBy("key").agg(F.count("*").alias("rows")).where("rows > 1")
    bands = stored(bands.join(shared, "key").select("key", "id", "rows"))
    degree = bands.groupBy("id").agg(F.sum("rows").alias("degree"))
    first = F.min(F.struct((-F.col("degree")).alias("degree"), F.col("id").alias("leader")))
    leaders = bands.join(degree, "id").groupBy("key").agg(first.alias("first"))
    bands = stored(bands.join(leaders, "key").select("key", "id", "first.leader", "first"))

    needed = bands.select("id").distinct()
    texts = docs.select(F.col("doc_id").alias("id"), "text").join(needed, "id", "left_semi")
    kind = f"id {docs.schema['doc_id'].dataType.simpleString()}, full binary"
    sets = stored(map_arrow(texts, _full_sets, kind))

    ends = [F.greatest("id", "leader").alias("u"), F.least("id", "leader").alias("v")]
    best = bands.groupBy("id").agg(F.min("first")["leader"].alias("leader")).where("id <> leader")
    links = _linked(best.select(*ends).distinct(), reps, sets)
    labelled = stored(_labelled(bands, links))
    # leaders that are in another component than the row; pairs within one need no test
    leads = labelled.where("id = leader").select("key", F.col("component").alias("of"))
    starred = labelled.join(leads, "key").where("component <> of").select(*ends).distinct()
    starred = stored(_possible(starred, classes))
    links = links.union(_linked(starred, reps, sets))
    labelled = stored(_labelled(bands, links))
    parts = labelled.groupBy("key", "component").agg(F.count("*").alias("rows"))
    split = parts.groupBy("key").agg(
        F.count("*").alias("parts"), F.max(F.struct("rows", "component"))["component"].alias("main"),
        F.ceil(F.sum("rows") / BLOCK).cast("int").alias("blocks"),
    )
    mixed = labelled.join(split.where("parts > 1").select("key", "main", "blocks"), "key")
    mixed = stored(mixed.join(classes.select("id", "n", "bits", "wide"), "id"))
    # rows outside the main component are dealt to blocks, and each block meets all rows of the bucket
    out = mixed.where("component <> main").withColumn("block", F.pmod(F.xxhash64("id"), "blocks").cast("int")).alias("a")
    all_ = mixed.withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).alias("b")
    cross = out.join(all_, (F.col("a.key") == F.col("b.key")) & (F.col("a.block") == F.col("b.block"))).where(
        "a.component <> b.component AND (b.component = b.main OR a.id > b.id)"
    ).where(_may_link())
    cross = cross.select(F.greatest("a.id", "b.id").alias("u"), F.least("a.id", "b.id").alias("v")).distinct()
    more = _linked(cross.join(starred, ["u", "v"], "left_anti"), reps, sets)
    return sketches, classes.select("digest", "id"), links.union(more)


def near_dedup(docs: DataFrame) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` for every row: classes of texts joined by similar shingle sets.

    Similar: at least 0.8 by Jaccard over distinct two-word shingles, confirmed on full sets. The component is the
    least ``doc_id`` reachable by links, and the row with that id stays. Texts with equal sets (exact copies, ties)
    are one class and are never paired. Null and empty texts have no shingles, are linked with nothing and stay. A row
    without id is in the component of its equal sets, or alone with a null component, and stays only in the latter
    case. Rows that repeat an id are one document. Empty input gives an empty result. Other columns are not looked at.
    """
    sketches, classes, links = near_links(docs)
    found = connected_components(links)
    named = classes.join(found, classes["id"] == found["node"], "left")
    named = named.select("digest", F.coalesce("component", "id").alias("component"))
    rows = spread_join(sketches.select("doc_id", "n", "digest"), named, "digest", ["doc_id"])
    component = F.coalesce("component", "doc_id")
    return rows.select(
        "doc_id",
        F.col("n").alias("n_shingles"),
        component.alias("component_id"),
        F.col("doc_id").eqNullSafe(component).alias("kept"),
    )
