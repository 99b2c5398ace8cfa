"""Every operator against brute force on a small table with the odd cases in it, and on an empty one."""

from __future__ import annotations

import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from loglake.llm import (
    bit_model,
    lm_score,
    mixing,
    near_dedup,
    packing,
    quality_classifier,
    quality_rules,
    registry,
    secrets,
    shingles,
    surrogates,
    training_order,
)
from loglake.llm import tokens as tokens_
from loglake.llm.common import shared_dir, stored
from loglake.llm.components import connected_components
from loglake.llm.exact_dedup import exact_dedup

TOKENIZER = str(public_tokenizers.path("byte_bpe_50k.json"))
#: Extra columns with names that operators use.
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, digest string, row string, w array<string>"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def _texts() -> list[tuple]:
    rng = random.Random(7)
    vocabulary = ["".join(rng.choice("abcdeiklmnorstuy") for _ in range(rng.randint(2, 9))) for _ in range(400)]
    prose = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    base = prose(120)
    near = base.split()
    near[5] = "otherword"
    long_ = "\n".join(prose(40) for _ in range(150))
    junk = " ".join(w + "%%%" for w in prose(80).split())
    boiler = prose(30)
    secret = f"{prose(60)} API_KEY = 'Zx81kq/77aa' and AKIA{'Q7' * 9} then {'0af3' * 10} token: ab password=secretpassw0rd"
    personal = (
        f"{prose(55)} mail Anna.Smith7@mail3.example.com or ANNA.SMITH7@MAIL3.EXAMPLE.COM, call +1 (017) 555-7713 "
        "or +1 017 555 7713, from 10.20.30.40, card 4952-9359-0025-3052, Frau Müller met Mr. Adam Stone"
    )
    texts = [base, base, " ".join(near), base.upper(), long_, junk, boiler + " " + boiler, secret, personal, personal,
             None, "", "   \n\t ", "one", "One", "two  words", prose(49), prose(50), "é ü x  y\n\n z ", long_,
             "<|endoftext|> plain", "a\x1cb \x85 c"]
    rows = [(i, t, "en", ("src0", "src1", None, "src2")[i % 4], None, "x", "y", ["z"]) for i, t in enumerate(texts)]
    for i in range(100, 130):
        rows.append((i, prose(rng.randint(55, 90)), "en", "src0", 1, None, None, None))
    rows.append((3, base, "en", "src0", 1, "again", None, None))  # an id and text that were there
    rows.append((3, base, "en", "src0", 1, "again", None, None))
    rows.append((None, prose(60), None, None, None, None, None, None))
    return rows


ROWS = _texts()


@pytest.fixture(scope="module")
def docs(spark):
    return stored(spark.createDataFrame(ROWS, SCHEMA).repartition(3)).select("*")


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def labels(spark):
    rows = [(i, 1, 0) for i in range(100, 120)] + [(5, 0, 0), (0, 1, 0), (None, 1, 0), (101, 1, 0), (102, None, None)]
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")


def _sorted(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=repr)


# exact duplicates


def _exact_truth():
    groups = collections.defaultdict(list)
    for i, t, *_ in ROWS:
        groups[t or ""].append(i)
    return {t: (max((i for i in ids if i is not None), default=None), len(ids)) for t, ids in groups.items()}


def test_exact_groups(docs):
    truth = _exact_truth()
    found = exact_dedup(docs).collect()
    assert sorted((r["text_sha256"], r["keep_id"], r["group_size"]) for r in found if r["kept"]) == sorted(
        ((hashlib.sha256(t.encode()).hexdigest(), *x) for t, x in truth.items()),
    )
    want = collections.Counter((i, *truth[t or ""]) for i, t, *_ in ROWS)
    assert collections.Counter((r["doc_id"], r["keep_id"], r["group_size"]) for r in found) == want


def test_exact_keeps_one_row_of_each_text_and_all_columns(docs):
    found = exact_dedup(docs, carry=tuple(docs.columns)).where("kept").select("row.*")
    assert found.schema.names == docs.schema.names
    assert sorted(r["text"] or "" for r in found.collect()) == sorted(_exact_truth())


def test_exact_salts_hot_text_and_compares_contents(spark):
    rows = [(i, "hot" if i % 3 else f"t{i % 20}") for i in range(3_000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    weak = lambda text: F.length(text).cast("string")  # noqa: E731  equal for different texts
    for digest in ({}, {"digest": weak}):
        found = exact_dedup(df, **digest).collect()
        by_text = collections.defaultdict(list)
        for i, t in rows:
            by_text[t].append(i)
        text = dict(rows)
        assert len(found) == len(rows)
        assert all(r["keep_id"] == max(by_text[text[r["doc_id"]]]) for r in found)
        assert all(r["group_size"] == len(by_text[text[r["doc_id"]]]) for r in found)


# secrets


def _spans(text, rules=secrets.RULES):
    out = []
    for k, rule in enumerate(rules):
        for m in re.finditer(rule.pattern, text, re.ASCII):
            if len(m.group(rule.group)) >= rule.least:
                out.append((m.start(), k, m.end()))
    return sorted(out)


def _base_spans(text):
    """By the patterns as they are given, short matches dropped afterwards."""
    assign = re.compile(
        r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A
    )
    out = [(m.start(), 0, m.end()) for m in assign.finditer(text) if len(m.group(2)) >= 6]
    out += [(m.start(), 1, m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m.group()) >= 20]
    out += [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9a-f]+", text) if len(m.group()) >= 24]
    return sorted(out)


ODD_SECRETS = ["secret=token:abcdefg", "token = \"password=abcdef1\"", "😀😀 passwd: 'abcdef' 😀" + "a" * 24,
               "AKIAAKIA" + "B" * 15, "AKIA" + "C" * 15 + " x", "0" * 23 + " " + "f" * 25 + "g", "apikey==abcde",
               "API_KEY:abc def token='abcdefgh' " * 30]


def test_secret_spans(spark, docs):
    odd = spark.createDataFrame([(1000 + i, t) for i, t in enumerate(ODD_SECRETS)], "doc_id long, text string")
    both = docs.select("doc_id", "text").union(odd)
    texts = collections.Counter((i, t) for i, t, *_ in [*ROWS, *((1000 + i, t) for i, t in enumerate(ODD_SECRETS))])
    want = collections.Counter()
    for (i, t), n in texts.items():
        want[i, tuple(_spans(t or ""))] += n
        assert [x for x in _spans(t or "") if x[1] < 3] == _base_spans(t or "")
    found = secrets.findings(both, secrets.scan_into(both, shared_dir(spark))).collect()
    assert collections.Counter((r["doc_id"], tuple(tuple(s) for s in r["spans"])) for r in found) == want
    assert sum(bool(s) for _, s in want) > 6


def test_ledger_scans_only_what_is_new(spark):
    make = lambda *rows: spark.createDataFrame(rows, "doc_id long, text string")
    path = shared_dir(spark)
    one = make((1, "token=abcdef1"), (2, "token=abcdef1"), (3, None))
    ledger = secrets.scan_into(one, path)
    assert ledger.count() == 2
    two = make((4, "token=abcdef1"), (5, "secret: 1234567"))
    assert secrets.unseen(two, ledger).count() == 1
    ledger = secrets.scan_into(two, path)
    assert ledger.count() == 3 and secrets.unseen(two, ledger).count() == 0
    newer = (*secrets.BASE[:2], secrets.Rule("hex", "[0-9a-f]{6,}", version=2))
    todo = secrets.unseen(two, ledger, newer).collect()
    assert all(r["todo"] == ["hex@2"] for r in todo) and len(todo) == 2
    found = {r["doc_id"]: len(r["spans"]) for r in secrets.findings(one.union(two), ledger).collect()}
    assert found == {1: 1, 2: 1, 3: 0, 4: 1, 5: 1}


# mixing


def test_targets_share_and_cap():
    got = mixing.targets({"a": 10, "b": 1000, None: 500})
    assert got["a"] == 30 and sum(got.values()) == pytest.approx(1510)
    assert got["b"] == pytest.approx(1480 * 2 / 3) and got[None] == pytest.approx(1480 / 3)
    assert mixing.targets({}) == {} and mixing.targets({"a": 0}) == {"a": 0.0}


def test_mixture(docs):
    found = mixing.mix(docs).collect()
    sizes = collections.Counter((i, len(WORD.findall(t or ""))) for i, t, *_ in ROWS)
    assert collections.Counter((r["doc_id"], r["size"]) for r in found) == sizes
    by_source = collections.Counter()
    for _, t, _, s, *_ in ROWS:
        by_source[s] += len(WORD.findall(t or ""))
    goal = mixing.targets(dict(by_source))
    assert sum(goal.values()) == pytest.approx(sum(by_source.values()))
    taken = collections.Counter()
    for r in found:
        assert 0 <= r["taken"] <= 3 * r["size"] and r["taken"] == r["copies"] * r["size"]
        taken[r["target"]] += r["taken"]
    for s, want in goal.items():  # src2 has little beside one long document
        assert abs(taken[want] - want) <= (1705 if s == "src2" else 0.02 * want), (s, want, taken[want])
    assert _sorted(mixing.mix(docs), "doc_id", "size", "copies") == sorted(
        ((r["doc_id"], r["size"], r["copies"]) for r in found), key=repr
    )


def test_rates_are_exponential_in_size(docs):
    rows = [r for r in mixing.mix(docs).collect() if r["size"] and r["rate"] < 3]
    by_target = collections.defaultdict(set)
    for r in rows:
        by_target[r["target"]].add(round(math.log(r["rate"]) / r["size"], 9))
    assert all(max(x) - min(x) < 1e-6 for x in by_target.values())


# quality rules


def _repeats(words):
    at = collections.defaultdict(list)
    for i in range(len(words) - 2):
        at[tuple(words[i : i + 3])].append(i)
    return len({j for places in at.values() if len(places) > 1 for i in places for j in (i, i + 1, i + 2)})


def test_base_statistics_and_ratio(docs, labels):
    found = quality_rules.quality_rules(docs, labels).collect()
    trusted = set(range(100, 120)) | {0}

    def grams(words):
        h = lambda x, s=42: xxhash.xxh64_intdigest(x, s)
        one = [h(w.encode()) for w in words]
        pack = lambda v: (v if v < 1 << 63 else v - (1 << 64)).to_bytes(8, "little", signed=True)
        two = [h(pack(b), h(pack(a))) for a, b in zip(one, one[1:], strict=False)]
        signed = lambda v: v if v < 1 << 63 else v - (1 << 64)
        return [signed(v) % quality_rules.BUCKETS for v in one + two]

    good, raw = collections.Counter(), collections.Counter()
    for i, t, *_ in ROWS:
        g = grams(WORD.findall(t or ""))
        raw.update(g)
        if i in trusted:
            good.update(g)
    total_good, total_raw, prior = sum(good.values()), sum(raw.values()), quality_rules.PRIOR
    ratio = {b: math.log((good[b] + prior * r / total_raw) / (total_good + prior) / (r / total_raw)) for b, r in raw.items()}
    want = collections.Counter()
    means = collections.defaultdict(list)
    for i, t, *_ in ROWS:
        t = t or ""
        words, lines = WORD.findall(t), [x for x in t.split("\n") if WORD.search(x)]
        repeat = _repeats(words)
        failed = len(words) < 50 or 100 * repeat > 50 * len(words)
        want[i, len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)),
             repeat, failed] += 1
        g = grams(words)
        means[i].append(sum(ratio[b] for b in g) / len(g) if g else 0.0)
    columns = ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    assert collections.Counter(tuple(r[c] for c in columns) for r in found) == want
    for r in found:
        assert any(abs(r["ratio"] - m) < 1e-5 for m in means[r["doc_id"]])
        assert r["kept"] == (not r["base_failed"] and r["ratio"] >= quality_rules.THRESHOLD)


def test_rules_without_labels(docs, labels):
    found = quality_rules.quality_rules(docs, labels.where("false"))
    assert found.where("kept = base_failed").count() == 0


# packing, tokens, training order


@pytest.fixture(scope="module")
def reference_ids():
    tokenizer = Tokenizer.from_file(TOKENIZER)
    return {t or "": [*tokenizer.encode(t or "", add_special_tokens=False).ids, 0] for _, t, *_ in ROWS}


def test_ids_are_those_of_the_plain_tokenizer(monkeypatch):
    rng = random.Random(12)
    bits = ["<|endoftext|>", " ", "  ", "a", "'s", "'", "\n", "\t", "é", "x y", "<|endof", "text|>", "…", " ", "\u3000z", "!", "9 9", "word"]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randint(0, 25))) for _ in range(2_000)]
    texts += [" ".join(f"w{rng.randrange(5_000)}" for _ in range(300)) for _ in range(20)]
    plain = Tokenizer.from_file(TOKENIZER)
    want = [plain.encode(t, add_special_tokens=False).ids for t in texts]
    assert any(50256 in ids for ids in want)
    known = tokens_.PieceIds(TOKENIZER)
    assert [x.tolist() for x in tokens_.token_ids(texts, known)] == want
    monkeypatch.setattr(tokens_, "JOINED", 3)
    known = tokens_.PieceIds(TOKENIZER)
    known.spaced = ["9 9"]  # as if it were an added token with a space in it
    assert [x.tolist() for at in range(0, len(texts), 40) for x in tokens_.token_ids(texts[at : at + 40], known)] == want


def test_pieces_hold_every_id_once(docs, reference_ids):
    parts = packing.packed(docs, TOKENIZER).collect()
    want = collections.Counter((i, tuple(reference_ids[t or ""])) for i, t, *_ in ROWS)
    texts = {i: t or "" for i, t, *_ in ROWS}
    got = collections.Counter()
    for r in parts:
        ids = np.frombuffer(r["ids"], "<u4").tolist()
        assert len(ids) == r["length"] <= 1024
        full = next(x for i, x in want if i == r["doc_id"] and len(x) == r["doc_tokens"])
        assert list(full[r["start"] : r["start"] + r["length"]]) == ids
        got[r["doc_id"], r["doc_tokens"]] += r["length"]
    assert got == collections.Counter({(i, len(x)): n * len(x) for (i, x), n in want.items()}) and texts
    by_sequence = collections.defaultdict(list)
    for r in parts:
        by_sequence[r["sequence_id"]].append((r["offset"], r["length"]))
    for places in by_sequence.values():
        places.sort()
        assert [o for o, _ in places] == np.cumsum([0, *(n for _, n in places)])[:-1].tolist()
        assert sum(n for _, n in places) <= 1024


@pytest.mark.parametrize("n", [1, 40, 5_000])
def test_patterns_hold_the_histogram(n):
    rng = random.Random(n)
    histogram = collections.Counter(min(1024, 1 + int(rng.expovariate(1 / 400))) for _ in range(n))
    patterns = packing.pack_lengths(histogram)
    held = collections.Counter()
    for count, lengths in patterns:
        assert sum(lengths) <= 1024 and lengths == sorted(lengths, reverse=True)
        for x in lengths:
            held[x] += count
    assert held == histogram
    if n == 5_000:
        tokens = sum(k * v for k, v in histogram.items())
        assert tokens / 1024 / sum(c for c, _ in patterns) > 0.97


@pytest.mark.parametrize("n", [1, 2, 3, 10, 257, 4096, 5000])
def test_permutation_is_one(n):
    slots = training_order.permute(np.arange(n), n, key=99)
    assert sorted(slots.tolist()) == list(range(n))
    assert training_order.permute(slots, n, key=99, back=True).tolist() == list(range(n))
    if n > 100:
        assert training_order.permute(np.arange(n), n, key=98).tolist() != slots.tolist()


def test_shards_round_trip(spark, docs, reference_ids):
    path = shared_dir(spark)
    contents = training_order.materialise(docs, path, TOKENIZER, key=5, sequence=128, shard=16).collect()
    about = training_order.manifest(spark, path)
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(f"{path}/shards").collect()
    records = {}
    for f in files:
        shard = int(re.search(r"shard=(\d+)", f["path"])[1])
        assert f["length"] % about["stride"] == 0
        for i in range(f["length"] // about["stride"]):
            record = f["content"][i * about["stride"] : (i + 1) * about["stride"]]
            assert record[-1:] == b"\n"
            records[shard * 16 + i] = np.frombuffer(record[:-1], "<u2").tolist()
    n = about["sequences"]
    assert sorted(records) == list(range(n)) and n == len(contents)
    back = training_order.permute(np.arange(n), n, key=5, back=True)
    stream = [x for k in np.argsort(back) for x in records[int(k)]]
    assert about["tokens"] == sum(len(reference_ids[t or ""]) for _, t, *_ in ROWS)
    documents, now = collections.Counter(), []
    for x in stream[: about["tokens"]]:
        now.append(x)
        if x == 0 and tuple(now) in {tuple(v) for v in reference_ids.values()}:
            documents[tuple(now)] += 1
            now = []
    assert documents == collections.Counter(tuple(reference_ids[t or ""]) for _, t, *_ in ROWS)
    assert all(x == 0 for x in stream[about["tokens"] :])
    read = {r["slot"]: r for r in training_order.read_slots(spark, path).collect()}
    for r in contents:
        assert r["slot"] == int(training_order.permute(np.array([r["sequence_id"]]), n, key=5)[0])
        assert read[r["slot"]]["whole"]
        assert read[r["slot"]]["ids_crc32"] == zlib.crc32(np.array(records[r["slot"]], "<u2").tobytes())


# near duplicates


def _shingles(text):
    w = (text or "").encode().lower().split()
    return frozenset(zip(w, w[1:], strict=False)) if len(w) > 1 else frozenset([tuple(w)] if w else [])


def _components(rows):
    sets = {}
    for i, t in rows:
        sets.setdefault(i, _shingles(t))
    parent = {i: i for i in sets}

    def find(a):
        while parent[a] != a:
            a = parent[a]
        return a

    ids = sorted(sets)
    for x, a in enumerate(ids):
        for b in ids[:x]:
            both = len(sets[a] & sets[b])
            if sets[a] and 100 * both >= 80 * len(sets[a] | sets[b]):
                parent[max(find(a), find(b))] = min(find(a), find(b))
    return {i: find(i) for i in ids}, sets


def test_near_duplicates(spark):
    rng = random.Random(3)
    words = [f"w{i}" for i in range(3_000)]
    rows, at = [], 0
    for _ in range(60):
        base = [rng.choice(words) for _ in range(rng.choice([3, 6, 12, 40, 150, 400]))]
        for _ in range(rng.choice([1, 2, 6])):
            other = list(base)
            for _ in range(rng.randint(0, max(1, len(base) // 18))):
                other[rng.randrange(len(other))] = rng.choice(words)
            rows.append((at, " ".join(other)))
            at += 1
    rows += [(at, None), (at + 1, ""), (at + 2, "Solo"), (at + 3, "solo"), (at + 4, " ")]
    truth, sets = _components(rows)
    found = near_dedup.near_dedup(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()
    assert {r["doc_id"]: r["component_id"] for r in found} == truth
    assert all(r["n_shingles"] == len(sets[r["doc_id"]]) and r["kept"] == (r["doc_id"] == truth[r["doc_id"]]) for r in found)


def test_short_sets_share_a_band():
    """Thousands of pairs of short sets at 0.8 to 0.95: each pair has a band in common and a high enough estimate."""
    rng = np.random.default_rng(5)
    for union, common in [(5, 4), (10, 8), (10, 9), (20, 16), (20, 18), (20, 19), (50, 40), (100, 80)]:
        for _ in range(1_000):
            x = rng.permutation(np.unique(rng.integers(0, 1 << 64, union, dtype=np.uint64)))
            own = int(rng.integers(common, union + 1))
            a, b = (shingles.registers(np.sort(s)) for s in (x[:own], np.concatenate([x[:common], x[own:]])))
            bands = [np.frombuffer(r, np.uint16).reshape(shingles.BANDS, shingles.ROWS) for r in (a, b)]
            assert (bands[0] == bands[1]).all(1).any()
            error = (0.16 / min(shingles.REGISTERS, union)) ** 0.5
            assert shingles.estimate(a, b) > common / union - near_dedup.ERRORS * error


def test_short_near_duplicates(spark):
    """Texts of 5 to 24 words with the last one or two changed, all against brute force."""
    rng = random.Random(17)
    rows = []
    for i in range(400):
        base = [f"v{rng.randrange(4_000)}" for _ in range(rng.randint(5, 24))]
        rows += [(2 * i, " ".join(base)), (2 * i + 1, " ".join([*base[: len(base) - rng.randint(0, 1 + len(base) // 16)], "end"]))]
    truth, _ = _components(rows)
    found = near_dedup.near_dedup(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()
    assert {r["doc_id"]: r["component_id"] for r in found} == truth and len(set(truth.values())) < 700


def test_near_duplicates_of_odd_rows(docs):
    truth, _ = _components([(i, t) for i, t, *_ in ROWS if i is not None and not (i == 3 and "otherword" in (t or ""))])
    found = near_dedup.near_dedup(docs).collect()
    assert len(found) == len(ROWS)
    assert all(r["component_id"] == truth[r["doc_id"]] for r in found if r["doc_id"] is not None)


def test_components(spark):
    rng = random.Random(5)
    edges = [(rng.randrange(400), rng.randrange(400)) for _ in range(250)] + [(i, i + 1) for i in range(1000, 1100)]
    parent = {}

    def find(a):
        parent.setdefault(a, a)
        while parent[a] != a:
            a = parent[a]
        return a

    for a, b in edges:
        if a != b:
            a, b = find(a), find(b)
            parent[max(a, b)] = min(a, b)
    got = connected_components(spark.createDataFrame(edges, "u long, v long")).collect()
    assert {r["node"]: r["component"] for r in got} == {a: find(a) for a in parent}


# scores


def test_parity_bits_never_differ_more_than_the_sets():
    rng = np.random.default_rng(6)
    for n in (1, 3, 90, 500, 700, 9_000):
        for share in (0.0, 0.02, 0.2, 1.0):
            a = np.unique(rng.integers(0, 2**63, n).astype(np.uint64))
            fresh = rng.integers(0, 2**63, int(share * n)).astype(np.uint64)
            b = np.unique(np.concatenate([a[len(fresh) :], fresh, fresh[: n // 9]]))
            sets = len(np.setxor1d(a, b))
            x, y = shingles.parity(a), shingles.parity(b)
            size = min(len(x), len(y))
            differ = lambda p, q: int(np.bitwise_count((p ^ q).view(np.uint64)).sum())
            whole = differ(shingles.folded(x, size), shingles.folded(y, size))
            assert differ(shingles.folded(x), shingles.folded(y)) <= whole <= sets
            assert whole > 0.6 * sets or share == 1 or not sets


def test_large_group_of_unlike_members_makes_few_pairs(spark, monkeypatch):
    """1,500 texts of 100 words, five edits each: their pairs are at about 0.69, and hardly any is ever made."""
    rng = random.Random(9)
    base, rows = [f"w{i}" for i in range(100)], []
    for i in range(1_500):
        words = list(base)
        for at in rng.sample(range(100), 5):
            words[at] = f"x{rng.randrange(10**9)}"
        rows.append((i, " ".join(words)))
    made = []
    real = near_dedup._linked
    monkeypatch.setattr(near_dedup, "_linked", lambda pairs, *a: made.append(pairs.count()) or real(pairs, *a))
    found = near_dedup.near_dedup(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()
    assert sum(made) < 10 * len(rows)
    sets = [set(zip(w, w[1:])) for _, t in rows for w in [t.split()]]
    component = list(range(len(rows)))

    def root(i):
        while component[i] != i:
            i = component[i]
        return i

    for i, x in enumerate(sets):
        for j in range(i):
            if 10 * len(x & sets[j]) >= 8 * len(x | sets[j]):
                component[max(root(i), root(j))] = min(root(i), root(j))
    assert {r["doc_id"]: r["component_id"] for r in found} == {i: root(i) for i in range(len(rows))}


def test_lm_base_and_bits(docs):
    found = lm_score.lm_score(docs).collect()
    held = lambda i: zlib.crc32(str(i).encode() if i is not None else b"") % 10 == 0
    tokens = lambda t: [*(t or "").encode().lower().split(), None]
    counts = collections.Counter(w for i, t, *_ in ROWS if not held(i) for w in tokens(t))
    n, v = sum(counts.values()), len(counts)
    want = collections.Counter()
    for i, t, *_ in ROWS:
        base = sum(math.log10((counts[w] + 0.1) / (n + 0.1 * (v + 1))) for w in tokens(t))
        want[i, held(i), len(tokens(t)), sum(w in counts for w in tokens(t)), n, round(base, 6)] += 1
    columns = ("doc_id", "held_out", "n_tokens", "n_known", "train_tokens")
    assert collections.Counter((*(r[c] for c in columns), round(r["base_score"], 6)) for r in found) == want
    assert all(r["score"] < 0 for r in found)


def test_rare_tokens_are_joined(docs, monkeypatch):
    whole = _sorted(lm_score.lm_score(docs), "doc_id", "n_known", F.round("base_score", 6))
    monkeypatch.setattr(lm_score, "FREQUENT", 3)
    assert _sorted(lm_score.lm_score(docs), "doc_id", "n_known", F.round("base_score", 6)) == whole


def test_bit_model_is_a_distribution_and_learns():
    texts = [b"the cat sat on the mat " * 20, b"a dog ran off " * 30]
    triples = np.zeros(1 << 24, np.int64)
    found, n = bit_model.triple_counts(texts)
    triples[found] = n
    code = bit_model.prefix_code(triples.reshape(1 << 16, 256))
    counts = bit_model.new_counts(code)
    bit_model.count_bits(texts, code, counts)
    tables = [bit_model.stretch(c) for c in counts]
    # the paths of all bytes after a context form a complete code
    assert np.sum(0.5 ** code.length.reshape(-1, 256), 1) == pytest.approx(np.ones(code.nodes // 256))
    # probabilities of all texts of one byte, and of none, add up to less than one and nearly to what is left
    single = bit_model.log_losses([bytes([b]) for b in range(255)] + [b""], code, tables)
    assert 0 < np.exp(-single).sum() <= 1.0001
    losses = bit_model.log_losses([b"the cat sat on the mat", b"zqxjkv wpfgh zzqq xx yy"], code, tables)
    assert losses[0] < losses[1] / 2
    alone = bit_model.log_losses([texts[1]], code, tables)
    assert bit_model.log_losses([*texts, b"x"], code, tables)[1] == pytest.approx(alone[0], rel=1e-12)


def test_classifier(spark):
    rng = random.Random(1)
    words = ["".join(rng.choice("abcdefghij") for _ in range(5)) for _ in range(200)]
    rows, marks = [], []
    for i in range(300):
        good = i % 4 > 0
        text = " ".join(rng.choice(words) + ("" if good else "%%%") for _ in range(rng.randint(30, 200)))
        rows.append((i, text))
        marks.append((i, int(good)))
    rows += [(1000, None), (1001, ""), (1002, rows[0][1] * 50)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame(marks, "doc_id long, quality int")
    held = quality_classifier.held_out(F.col("doc_id"), 5)
    model = quality_classifier.fit(df.where(~held), labels.where(~held))
    got = {r["doc_id"]: r for r in quality_classifier.classify(df, model).collect()}
    hits = [got[i]["predicted"] == q for i, q in marks if zlib.crc32(str(i).encode()) % 5 == 0]
    assert len(hits) > 30 and sum(hits) / len(hits) > 0.95
    assert all(0 <= r["score"] <= 1 for r in got.values()) and got[1000]["score"] == got[1001]["score"]
    assert quality_classifier.fit(df, labels.where("quality = 1")) is None
    assert quality_classifier.classify(df, None).where("score = 0.5").count() == len(rows)


def test_prior_does_not_depend_on_the_sample(spark):
    rng = random.Random(2)
    rows = [(i, " ".join(rng.choice(("ab", "cd", "ef", "gh")) + str(rng.randrange(50)) for _ in range(40))) for i in range(700)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 7 > 0)) for i in range(700)], "doc_id long, quality int")
    for sample in (40, 1_500):
        model = quality_classifier.fit(df, labels, sample)
        shares = 1 / (1 + np.exp(-model.offset))
        assert abs(shares - 6 / 7) < 0.12


def test_classifier_learns_from_whole_texts(spark):
    """Texts that differ only after their first 4,096 characters are told apart."""
    rng = random.Random(4)
    words = ["".join(rng.choice("abcdefghij") for _ in range(5)) for _ in range(200)]
    prose = lambda n, end="": " ".join(rng.choice(words) + end for _ in range(n))
    rows = [(i, prose(700) + " " + prose(500, "" if i % 2 else "%%%")) for i in range(120)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    model = quality_classifier.fit(df, spark.createDataFrame([(i, i % 2) for i in range(120)], "doc_id long, quality int"))
    score = {r["doc_id"]: r["score"] for r in quality_classifier.classify(df, model).collect()}
    assert sum((score[i] > 0.5) == (i % 2) for i in range(120)) > 114


# surrogates


def test_surrogates(docs):
    found = surrogates.replace_personal_data(docs, "key").collect()
    texts = collections.defaultdict(list)
    for i, t, *_ in ROWS:
        texts[i].append(t)
    one = {r["doc_id"]: r for r in found}
    kinds = ("email", "phone", "ip", "card", "name")
    assert {k: one[8][f"n_{k}"] for k in kinds} == {"email": 2, "phone": 2, "ip": 1, "card": 1, "name": 2}
    for r in found:
        if not r["entities"]:
            assert r["text"] in texts[r["doc_id"]]
    text = one[8]["text"]
    for old in ("nna.Smith7", "mail3", "555-7713", "555 7713", "10.20.30.40", "4952-9359", "Müller", "Adam Stone"):
        assert old not in text
    assert one[9]["text"] == text
    pairs = [(e["type"], e["original"], e["replacement"]) for e in one[8]["entities"]]
    mails = [p for p in pairs if p[0] == "email"]
    assert mails[0][2].upper() == mails[1][2] and mails[0][2].endswith(".example")
    phones = [re.sub(r"\D", "", p[2]) for p in pairs if p[0] == "phone"]
    assert phones[0] == phones[1] and re.fullmatch(r"\+1 \(\d{3}\) \d{3}-\d{4}", pairs[2][2])
    names = [p[2] for p in pairs if p[0] == "name"]
    assert names[0].startswith("Frau ") and re.fullmatch(r"Mr\. \w+ \w+", names[1])
    assert names[1].split()[1] in surrogates._GIVEN["male"]
    other = {r["doc_id"]: r for r in surrogates.replace_personal_data(docs, "other").collect()}
    assert other[8]["text"] != text


def test_every_match_has_the_hint(spark):
    rng = random.Random(23)
    digits = lambda n: "".join(rng.choice("0123456789") for _ in range(n))
    made = ["+33 12 34 56 78", "+41-22-33-44-55", "+33 1 23 45 67 89", "+49 30 12 34 56 78", "+49 1 51 23 45 67 89",
            "1 2 3 4 5 6 7 8 9 0 1 2 3", "12-34-56-78-90-12-34", "Mr. Stone", "a@b.cd", "1.2.3.4", "123-45-6789"]
    for _ in range(2_000):
        sep = rng.choice([" ", "-", "."])
        made.append(f"+{digits(rng.randint(1, 3))}{sep}" + sep.join(digits(rng.randint(1, 4)) for _ in range(rng.randint(2, 7))))
        made.append(rng.choice(" -").join(digits(rng.randint(1, 2)) for _ in range(rng.randint(7, 16))))
    df = spark.createDataFrame([(i, t) for i, t in enumerate(made)], "doc_id long, text string")
    assert not df.where(F.col("text").rlike(surrogates.PATTERN) & ~F.col("text").rlike(surrogates.HINT)).count()
    whole = surrogates.replace_personal_data(df.where("doc_id < 5"), "k").collect()
    assert all(r["n_phone"] == 1 and r["entities"][0]["original"] == made[r["doc_id"]] for r in whole)
    assert all(r["text"] != made[r["doc_id"]] for r in whole)


def test_surrogates_stay_distinct(spark, monkeypatch):
    rows = [(i, f"from 10.0.{i // 250}.{i % 250} now") for i in range(600)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    few = surrogates.surrogate

    def clashing(kind, value, seed):
        """Draws among few addresses, so that most collide."""
        return F.concat(F.lit("9.9."), F.pmod(F.xxhash64(seed), F.lit(30)).cast("string"), F.lit("."),
                        F.pmod(F.xxhash64(seed, F.lit(1)), F.lit(200)).cast("string"))

    monkeypatch.setattr(surrogates, "surrogate", clashing)
    found = surrogates.replace_personal_data(df, "k").collect()
    assert len({r["text"] for r in found}) == 600 and few is not clashing


def test_surnames_never_run_out(spark):
    """Far more surnames of one gender than a surname of three syllables has values."""
    letters = "abcdefghijklmnopqrstuvwxyz"
    names = [f"male/X{letters[i % 26]}{letters[i // 26 % 26]}{letters[i // 676 % 26]}{letters[i // 17576]}" for i in range(50_000)]
    df = spark.createDataFrame([("name", n) for n in names], "type string, value string")
    drawn = [r["drawn"] for r in surrogates.draw(df, "k").collect()]
    assert len(drawn) == len(set(drawn)) == 50_000 and not set(drawn) & set(names)


# tables without rows


@pytest.mark.parametrize("name", ["exact", "secrets", "mix", "rules", "pack", "order", "near", "lm", "classify", "pii"])
def test_empty_tables(spark, none, labels, name):
    run = {
        "exact": lambda: exact_dedup(none, carry=tuple(none.columns)),
        "secrets": lambda: secrets.findings(none, secrets.scan_into(none, shared_dir(spark))),
        "mix": lambda: mixing.mix(none, carry=tuple(none.columns)),
        "rules": lambda: quality_rules.quality_rules(none, labels, carry=tuple(none.columns)),
        "pack": lambda: packing.packed(none, TOKENIZER),
        "order": lambda: training_order.training_order(none, TOKENIZER, 1),
        "near": lambda: near_dedup.near_dedup(none),
        "lm": lambda: lm_score.lm_score(none),
        "classify": lambda: quality_classifier.classify(none, quality_classifier.fit(none, labels)),
        "pii": lambda: surrogates.replace_personal_data(none, "k"),
    }[name]
    assert run().count() == 0


def test_every_operator_has_a_query():
    assert {re.match(r"op(\d+)_", n)[1] for n in registry.QUERIES} == {str(n) for n in range(1, 11)}
