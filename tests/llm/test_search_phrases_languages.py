"""Language identification, collocations and lexical search against brute force, with the odd cases, and on nothing."""

from __future__ import annotations

import collections
import math
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from loglake.llm import language_id, lexical_search, phrases

#: Extra columns with names that operators use.
SCHEMA = "doc_id long, text string, lang string, source string, key string, word string, n long, state binary"
VOCABULARY = {
    "en": "the of and house water thing with ship",
    "de": "der und das haus wasser schön über schiff",
    "fr": "le et la maison eau déjà où bateau",
    "es": "el y la casa agua niño año barco",
}
LETTER = re.compile(r"[^\W\d_]")


def _rows() -> list[tuple]:
    rng = random.Random(3)
    rows = []
    for i in range(400):
        lang = ("en", "de", "fr", "es", "en")[i % 5]
        words = VOCABULARY[lang].split()
        n = 30_000 if i == 7 else rng.randint(3, 40)
        text = "".join(rng.choice(words) + rng.choice([" ", " ", " ", ". ", ",", "\n", "\t", "  "]) for _ in range(n))
        rows.append((i, text if i % 9 else text.upper(), None if i % 17 == 5 else lang, None, "x", "y", 1, None))
    odd = [None, "", " \n\t ", "123 !!", "²", "water", "Water water", "a\x1cb \x85c", "der\x0bdas", "😀 emoji"]
    rows += [(500 + i, t, (None, "und", "en")[i % 3], None, None, None, None, None) for i, t in enumerate(odd)]
    rows += [(3, rows[3][1], "es", None, None, None, None, None)] * 3
    rows += [(None, "the house and the water", "en", None, None, None, None, None)]
    # 900 copies of one text, as a hot group is
    rows += [(1_000 + i, "cold water of the house, thing with ship", "en", None, None, None, None, None) for i in range(900)]
    return rows


ROWS = _rows()


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, SCHEMA).repartition(4).cache()


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


# languages


def _features(text: str | None) -> dict[int, float]:
    lowered = (text or "").lower().encode()
    cleaned = bytes(c if c >= 128 or 97 <= c <= 122 else c + 32 if 65 <= c <= 90 else 32 for c in lowered)
    words = cleaned.split()
    data = b" " + b" ".join(words) + b" "
    counts: collections.Counter = collections.Counter()
    for n in (1, 2, 3):
        for at in range(len(data) - n + 1 if words else 0):
            key = n
            for byte in data[at : at + n]:
                key = (key * 257 + byte) % 2**32
            counts[(key * 2_654_435_761) % 2**32 >> 19] += 1
    return {k: math.sqrt(v / counts.total()) for k, v in counts.items()}


@pytest.mark.parametrize("block", [1 << 20, 5])
def test_features_are_those_of_a_slow_count(monkeypatch, block):
    monkeypatch.setattr(language_id, "BLOCK", block)
    for text in ["", "a", "Été à la mer", "x1y2 z", None, "niño " * 50, "ÀÉ!" * 7]:
        found = language_id.features(text)
        assert {int(i): pytest.approx(found[i]) for i in np.flatnonzero(found)} == _features(text)


def _decided(text: str, model: language_id.Model) -> tuple[str, float]:
    x = _features(text)

    def winner(classes, pairs):
        votes, shares = collections.Counter(), collections.Counter()
        for (first, second), (w, b) in pairs.items():
            if first in classes:
                p = 1 / (1 + math.exp(-language_id.STEEP * (sum(float(w[i]) * v for i, v in x.items()) + b)))
                votes[first if p > 0.5 else second] += 1
                shares[first] += p
                shares[second] += 1 - p
        best = sorted(classes, key=lambda c: (-votes[c], -shares[c], c))[0]
        return best, shares[best] / (len(classes) - 1) if len(classes) > 1 else 1

    family, likely = winner(list(model.members), model.families)
    lang, share = winner(model.members[family], model.languages)
    return lang, likely * share


def test_languages_are_told_as_slowly_decided_and_right(docs):
    held = language_id.held_out(docs["doc_id"])
    model = language_id.fit(docs.where(~held))
    assert model.members == {"=und": ("und",), "germanic": ("de", "en"), "romance": ("es", "fr")}
    assert set(model.languages) == {("de", "en"), ("es", "fr")}
    assert set(model.families) == {("=und", "germanic"), ("=und", "romance"), ("germanic", "romance")}
    told = language_id.predict(docs, model).collect()
    assert len(told) == len(ROWS)
    texts = collections.defaultdict(set)
    for i, t, *_ in ROWS:
        texts[i].add(t)
    right = collections.Counter()
    for r in told:
        (text,) = texts[r["doc_id"]]
        if not text or not LETTER.search(text) or text == "²":
            assert (r["lang_pred"], r["score"]) == ("und", 0.0)
        elif r["doc_id"] is None or r["doc_id"] < 900:
            lang, score = _decided(text, model)
            assert r["lang_pred"] == lang and r["score"] == pytest.approx(score, abs=1e-9) and 0 <= r["score"] <= 1
    langs = {i: ("en", "de", "fr", "es", "en")[i % 5] for i in range(400)}
    for r in language_id.predict(docs.where(held), model).collect():
        if r["doc_id"] < 400:
            right[r["lang_pred"] == langs[r["doc_id"]]] += 1
    assert right[True] >= 0.98 * right.total()


def test_language_sample_is_bounded_and_drops_repeats(docs):
    chosen = language_id._sample(docs, 20).groupBy("lang").count().collect()
    assert {r["lang"]: r["count"] for r in chosen} == {"en": 20, "de": 20, "fr": 20, "es": 20, "und": 1}
    same = docs.where("doc_id = 3").union(docs.where("doc_id = 3"))
    assert language_id._sample(same, 20).count() == 1


def test_language_models_of_little(docs, none):
    assert language_id.fit(none) is None
    assert language_id.predict(none, None).collect() == []
    assert {tuple(r)[1:] for r in language_id.predict(docs, None).collect()} == {("und", 0.0)}
    one = language_id.fit(docs.where("lang = 'fr'"))
    assert {r["lang_pred"] for r in language_id.predict(docs.where("doc_id < 50"), one).collect()} == {"fr"}
    unlisted = language_id.fit(docs.where("lang IN ('fr', 'es')"), families={})
    assert set(unlisted.families) == {("=es", "=fr")} and not unlisted.languages


def test_separation_is_the_optimum():
    rng = np.random.default_rng(4)
    x = rng.normal(size=(200, 6))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    y = np.where(x @ rng.normal(size=6) + 0.2 + 0.2 * rng.normal(size=200) > 0, 1, -1)
    w, b = language_id.separate(x, y)
    share = np.where(y > 0, 0.5 / (y > 0).sum(), 0.5 / (y < 0).sum())

    def loss(v):
        slack = np.maximum(0, 1 - y * (x @ v[:-1] + v[-1]))
        return language_id.REGULARISATION / 2 * v @ v + share @ slack**2

    found = loss(np.append(w, b))
    assert all(loss(np.append(w, b) + 0.02 * rng.normal(size=7)) >= found - 2e-3 for _ in range(300))
    assert (np.sign(x @ w + b) == y).mean() > 0.8 and loss(np.zeros(7)) == 1


# collocations


def _collocations(rows, least: int, top: int) -> list[tuple]:
    count, total = collections.Counter(), collections.Counter()
    for _, text, lang, *_ in rows:
        lang = "und" if lang is None else lang
        lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lowered):
            words = re.findall(r"[^\x20\x09]+", piece)
            total[lang] += len(words)
            for size in range(1, 5):
                for at in range(len(words) - size + 1):
                    count[lang, tuple(words[at : at + size])] += 1
    candidates = {k: n for k, n in count.items() if len(k[1]) > 1 and n >= least}
    gone = set()
    for (lang, words), n in candidates.items():
        for size in range(2, len(words)):
            for at in range(len(words) - size + 1):
                inner = lang, words[at : at + size]
                if 100 * n >= 80 * count[inner]:
                    gone.add(inner)
    found = collections.defaultdict(list)
    for (lang, words), a in candidates.items():
        if (lang, words) not in gone:
            cuts = [(count[lang, words[:k]], count[lang, words[k:]], k) for k in range(1, len(words))]
            score, _, left, right = min((2_000_000 * a // (x + y), k, x, y) for x, y, k in cuts)
            found[lang].append((-score, -a, " ".join(words).encode(), left, right))
    return sorted(
        (lang, rank, phrase.decode(), -a, left, right, total[lang], -score)
        for lang, rows in found.items()
        for rank, (score, a, phrase, left, right) in enumerate(sorted(rows)[:top], 1)
    )


@pytest.mark.parametrize(("least", "top", "small"), [(30, 2_000, False), (8, 25, True)])
def test_collocations(docs, monkeypatch, least, top, small):
    if small:  # several dictionaries, tries and blobs
        for name, value in (("ENTRIES", 16), ("SPAN_BITS", 5), ("BLOB", 50), ("GATHERED", 300), ("HELD", 5)):
            monkeypatch.setattr(phrases, name, value)
        docs = docs.where("doc_id < 200 OR doc_id > 1700")
        rows = [r for r in ROWS if r[0] is not None and (r[0] < 200 or r[0] > 1_700)]
    else:
        rows = ROWS
    want = _collocations(rows, least, top)
    assert sorted(tuple(r) for r in phrases.collocations(docs, least, top).collect()) == want
    assert len(want) > 60 and {"en", "fr"} <= {w[0] for w in want}


def test_collocations_of_nothing(none, docs):
    assert phrases.collocations(none).collect() == []
    assert phrases.collocations(docs, least=10**6).collect() == []


def test_many_tries_take_one_pass_a_level(docs, monkeypatch):
    for name, value in (("ENTRIES", 16), ("EDGES", 8), ("STEPPED", 500), ("BLOB", 200)):
        monkeypatch.setattr(phrases, name, value, raising=False)
    kept, built, passes, tries = phrases._kept, phrases.Trie.__init__, [], []
    monkeypatch.setattr(phrases, "_kept", lambda df: (passes.append(df.columns), kept(df))[1])
    monkeypatch.setattr(phrases.Trie, "__init__", lambda self, *x: (tries.append(len(x[0])), built(self, *x))[1])
    few = [r for r in ROWS if r[0] is not None and r[0] < 100]
    found = phrases.collocations(docs.where("doc_id < 100"), 15, 25).collect()
    assert sorted(tuple(r) for r in found) == _collocations(few, 15, 25) and found
    assert len(tries) > 6 and sum("state" in columns for columns in passes) <= 3
    assert max(tries) <= 20  # a block is dealt by a hash, so not quite evenly


def test_tries_are_dealt_by_ranges_of_words(spark, monkeypatch):
    for name, value in (("EDGES", 40), ("SPAN_BITS", 12)):
        monkeypatch.setattr(phrases, name, value)
    hot = [(p, 17) for p in range(1, 300)]
    edges = sorted({(1 + 7 * i % 9_000, 1 + i * i % 6_000) for i in range(1_500)} | set(hot))
    cells = phrases._cells(spark.createDataFrame(edges, "parent int, word int"))
    of = collections.Counter(
        cell for p, w in edges for cell in cells
        if p >> 12 == cell[0] and cell[1] <= w <= cell[2] and (p ^ w) % cell[4] == cell[3]
    )
    assert of.total() == len(edges) and max(of.values()) <= 60  # a block is dealt by a hash, so not quite evenly
    assert all(first >> 12 == last >> 12 for _, first, last, *_ in cells)


def test_workers_get_little_at_a_time(spark):
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name)

    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.nbytes])], names=["n"])

    blobs = spark.range(0, 64, 1, 1).select(F.expr("repeat(cast(id % 10 AS string), 1000000)").cast("binary").alias("words"))
    found = [r[0] for r in phrases._kept(phrases.map_arrow(blobs, sizes, "n long")).collect()]
    assert sum(found) >= 64e6 and max(found) < 8e6
    assert spark.conf.get(name) == before


def test_workers_do_not_keep_what_is_lent(spark):
    shared = [spark.sparkContext.broadcast([n] * 9) for n in range(3)]

    def held(batches):
        for _ in batches:
            for _ in range(2):
                for n, one in enumerate(shared):
                    assert phrases._lent(one) == [n] * 9
            yield pa.RecordBatch.from_arrays([pa.array([sum("_value" in vars(one) for one in shared)])], names=["n"])

    assert phrases.map_arrow(spark.range(1), held, "n long").first()[0] == 0


def test_double_array_finds_its_edges_and_no_others():
    rng = np.random.default_rng(5)
    edges = np.unique(rng.zipf(1.3, (60_000, 2)) % [5_000, 3_000] + 1, axis=0)
    parent, word = edges.T.astype(np.int64)
    child = np.arange(1, len(edges) + 1)
    trie = phrases.Trie(parent, word, child, 0, 0)
    assert (trie.step(parent.astype(np.int32), word.astype(np.int32)) == child).all()
    known = {(p, w): c for p, w, c in zip(parent.tolist(), word.tolist(), child.tolist(), strict=True)}
    state, after = rng.integers(0, 6_000, 200_000, np.int32), rng.integers(0, 4_000, 200_000, np.int32)
    want = [known.get(pair, 0) for pair in zip(state.tolist(), after.tolist(), strict=True)]
    assert trie.step(state, after).tolist() == want
    assert len(trie.lower[1]) < 24 * len(edges) + 1_000


# search

ITEMS = [(1, "cold WATER, bateau"), (2, "haus schön agua water"), (3, None), (4, "nobody knows"), (5, "!!"), (2, "haus schön agua water"),
         (None, "niño"), (7, "the of and house water thing with ship der und das"), (8, "emoji 123 ² c")]


def _ranked(rows, items, top: int = 10) -> list[tuple]:
    find = lambda t: re.findall(
        r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")
    )
    docs = [(i, collections.Counter(found), len(found)) for i, t, *_ in rows if (found := find(t))]
    size, length = len(docs), sum(n for *_, n in docs)
    frequency = collections.Counter(t for _, c, _ in docs for t in c)
    out = []
    for item, text in items:
        scored = []
        for i, counts, n in docs:
            m = 100 - 90 + 90 * n * size // length
            score = sum(
                math.floor(1000 * math.log((2 * size + 2) / (2 * frequency[t] + 1))) * (10**9 * counts[t] // (1000 * counts[t] + 8 * m))
                for t in set(find(text)) if t in counts
            )
            if score > 0 and i is not None:
                scored.append((-score, i))
        out += [(item, rank, i, -score) for rank, (score, i) in enumerate(sorted(scored)[:top], 1)]
    return sorted(out, key=repr)


@pytest.mark.parametrize(("cells", "block", "terms"), [(1 << 22, 24, 1 << 14), (1, 3, 4)])
def test_search(spark, docs, monkeypatch, cells, block, terms):
    for name, value in (("CELLS", cells), ("BLOCK", block), ("TERMS", terms)):
        monkeypatch.setattr(lexical_search, name, value)
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    found = lexical_search.search(docs, items)
    assert sorted((tuple(r) for r in found.collect()), key=repr) == _ranked(ROWS, ITEMS)
    assert [f.simpleString() for f in found.schema] == ["item_id:bigint", "rank:int", "doc_id:bigint", "score:bigint"]


def test_search_skips_blocks_and_loses_nothing():
    rng = np.random.default_rng(2)
    topics = rng.random((40, 120)) < 0.08
    scores = np.where(topics[rng.integers(0, 40, 1_000)] & (rng.random((1_000, 120)) < 0.7), rng.integers(500, 1_000, (1_000, 120)), 0)
    shard, ids = lexical_search.Shard(scores), np.arange(1_000)
    opened = 0
    for _ in range(30):
        item = np.flatnonzero(topics[rng.integers(0, 40)])
        best: list[tuple[int, int]] = []
        shard.search(item, 0, best, ids, 10)
        total = scores[:, item].sum(1)
        want = sorted(((int(s), -i) for i, s in enumerate(total.tolist()) if s), reverse=True)[:10]
        assert sorted(best, reverse=True)[: len(want)] == want
        # a second pass with the floor reached opens few of the blocks
        floor = best[0][0]
        for term in item:
            docs, starts, summary = shard.blocks(int(term))
            tops = np.maximum.reduceat(total[docs], starts)
            bound = summary[:, item].sum(1)
            assert (bound >= tops).all()
            opened += (bound >= floor).mean() / len(item)
    assert opened / 30 < 0.5


def test_search_of_nothing(spark, docs, none):
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    assert lexical_search.search(none, items).collect() == []
    assert lexical_search.search(docs, items.where("item_id > 100")).collect() == []
    assert lexical_search.search(docs.where("text IS NULL"), items).collect() == []
