"""The pipeline's stages, one after the other, against brute force on what each was given."""

from __future__ import annotations

import collections
import random
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent.parent))
import corpus_pipeline
from loglake.llm import mixing, quality_rules
from loglake.llm.common import stored

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, row string, digest binary"


def _rows():
    rng = random.Random(11)
    words = [f"word{i}" for i in range(900)]
    rows = []
    for i in range(60):
        text = [rng.choice(words) for _ in range(rng.randint(60, 160))]
        source = f"src{i % 3}" if i % 10 else None
        rows.append((i, " ".join(text), "en", source, None, "r", None))
        if i % 4 == 0:
            rows.append((1000 + i, " ".join(text), "de", source, 1, None, b"x"))
        if i % 5 == 0:
            text[7] = "changed"
            rows.append((2000 + i, " ".join(text), "en", "src1", 1, None, None))
    rows += [(5000, None, "en", "src0", 0, None, None), (5001, "too short", "en", "src0", 9, None, None)]
    rows += [rows[0], (None, rows[3][1] + " more", "en", None, 5, None, None)]
    return rows


def _shingles(text):
    w = text.encode().lower().split()
    return set(zip(w, w[1:], strict=False))


@pytest.fixture(scope="module")
def sf_dir(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("tables"))
    spark.createDataFrame(_rows(), SCHEMA).repartition(3).write.parquet(f"{path}/documents.parquet")
    marks = [(i, 1, 0) for i in range(0, 60, 2)]
    spark.createDataFrame(marks, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return path


def test_stages(spark, sf_dir):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality rules", "exact dedup", "near dedup", "mixing", "packing"]
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    frames = [docs]
    for _, stage in corpus_pipeline.STAGES:
        frames.append(stored(stage(spark, frames[-1], sf_dir)))
    assert all(f.schema.names == docs.schema.names for f in frames[:-1])
    raw, good, single, apart, mixed = (f.collect() for f in frames[:-1])

    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    kept = quality_rules.quality_rules(docs, labels).where("kept").collect()
    assert collections.Counter(r["doc_id"] for r in good) == collections.Counter(r["doc_id"] for r in kept)
    assert {5000, 5001} & {r["doc_id"] for r in raw} and not {5000, 5001} & {r["doc_id"] for r in good}

    last = {}
    for r in good:
        last[r["text"]] = max(last.get(r["text"], -1), r["doc_id"] if r["doc_id"] is not None else -1)
    assert {r["text"]: r["doc_id"] if r["doc_id"] is not None else -1 for r in single} == last and len(single) == len(last)

    ids = sorted(r["doc_id"] for r in single if r["doc_id"] is not None)
    sets = {r["doc_id"]: _shingles(r["text"]) for r in single}
    near = {
        b for b in ids for a in ids
        if a < b and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])
    }
    assert near and {r["doc_id"] for r in apart} == (set(ids) - near) | {None}

    size = collections.Counter()
    for r in apart:
        size[r["source"]] += len(r["text"].split())
    goal, taken = mixing.targets(dict(size)), collections.Counter()
    for r in mixed:
        taken[r["source"]] += len(r["text"].split())
    assert all(abs(taken[s] - t) < 60 for s, t in goal.items())
    assert max(collections.Counter(r["doc_id"] for r in mixed).values()) <= 3

    pieces = frames[-1].collect()
    per_doc = collections.Counter()
    for r in pieces:
        per_doc[r["doc_id"], r["doc_tokens"]] += r["length"]
    times = collections.Counter(r["doc_id"] for r in mixed)
    assert per_doc == {(d, n): times[d] * n for d, n in per_doc} and {d for d, _ in per_doc} == set(times)
    by_sequence = collections.Counter()
    for r in pieces:
        by_sequence[r["sequence_id"]] += r["length"]
    assert max(by_sequence.values()) <= 1024


def test_empty_table(spark, tmp_path):
    path = str(tmp_path)
    spark.createDataFrame([], SCHEMA).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    assert corpus_pipeline.run(spark, path).count() == 0
