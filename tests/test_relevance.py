"""Documents by relevance against a plain computation, and as the documents of rules."""

import math
import random
from collections import Counter
from datetime import datetime, timedelta, timezone

import pytest

from loglake.functions.text import query_terms
from loglake.operators.relevance import most_relevant
from loglake.operators.rules import rule_documents
from loglake.sources import config as C

NOW = datetime(2024, 1, 2, tzinfo=timezone.utc)
LOG = "id string, application string, ts timestamp, level string, message string"


@pytest.fixture(scope="module")
def rows():
    draw = random.Random(2)
    words = "disk full slow can't open file timeout 1.5 retry node_7".split()
    rows = [
        (str(i), "aab"[i % 3], NOW - timedelta(minutes=i), "ERROR" if i % 4 else "INFO", " ".join(draw.choices(words, k=draw.randint(1, 25))))
        for i in range(150)
    ]
    return [*rows, ("x", "b", NOW, "ERROR", None), ("y", "b", NOW, "ERROR", "!!"), ("z", "b", NOW, "ERROR", "only ONCE Disk")]


@pytest.fixture(scope="module")
def logs(spark, rows):
    return spark.createDataFrame(rows, LOG).repartition(3).cache()


def scores(rows, application, text):
    docs = {i: Counter(query_terms(m)) for i, a, _, _, m in rows if a == application and query_terms(m or "")}
    average = sum(c.total() for c in docs.values()) / len(docs)
    out = {}
    for i, c in docs.items():
        found = set(query_terms(text)) & set(c)
        if found:
            df = {t: sum(t in other for other in docs.values()) for t in found}
            out[i] = sum(
                math.log(1 + (len(docs) - df[t] + 0.5) / (df[t] + 0.5)) * c[t] * 2.2
                / (c[t] + 1.2 * (0.25 + 0.75 * c.total() / average)) for t in found
            )
    return out


def test_most_relevant(logs, rows):
    searches = {"q1": "Disk full", "q2": "can't 1.5 node_7 DISK", "q3": "once", "q4": "!!", "q5": "absent"}
    found = most_relevant(logs, searches, n=7, carry=("level",)).collect()
    for a in "ab":
        for name, text in searches.items():
            want = sorted(((-round(s, 9), i) for i, s in scores(rows, a, text).items()))[:7]
            got = sorted((r["rank"], r["id"], r["score"]) for r in found if (r["application"], r["search"]) == (a, name))
            assert [(i, pytest.approx(-s)) for s, i in want] == [(i, s) for _, i, s in got]
    assert {r["search"] for r in found} == {"q1", "q2", "q3"}
    assert {r["id"]: r["level"] for r in found}.items() <= {i: level for i, _, _, level, _ in rows}.items()


def test_documents_of_rules_by_relevance(logs, rows):
    rule = lambda query, **more: C.AlertRule(query, 10, ("ops",), 0, **more)
    rules = (
        rule("level = 'ERROR'", ranked_by="disk full"), rule("level = 'ERROR'"), rule("level = 'INFO'", ranked_by="timeout", lookback=100),
        rule("level = 'ERROR'", ranked_by="absent"),
    )
    assert len({r.rule_id for r in rules}) == 4
    found = rule_documents(logs, [C.Application("a", rules)], NOW, ["id"], 5)
    got = {r["rule_id"]: [d["id"] for d in r["documents"]] for r in found.collect()}
    time = {i: ts for i, _, ts, _, _ in rows}
    for r in rules:
        level = r.query[9:-1]
        hits = [i for i, a, ts, lv, _ in rows if a == "a" and lv == level and (r.lookback is None or ts >= NOW - timedelta(minutes=100))]
        score = scores(rows, "a", r.ranked_by) if r.ranked_by else {}
        want = sorted(hits, key=lambda i: (-round(score.get(i, 0), 9), -time[i].timestamp(), i))[:5]
        assert got[r.rule_id] == want, r


def test_field_terms_tokenize_once(spark):
    from loglake.operators.relevance import field_terms

    length, terms = field_terms("message", ["a", "c", "z"])
    assert terms._jc.toString().count("regexp_extract_all") == 1
    row = spark.createDataFrame([("A b a c a",), ("",)], "message string").select(length.alias("n"), terms.alias("t")).collect()
    assert [(r["n"], sorted((e["term"], e["tf"]) for e in r["t"])) for r in row] == [(5, [("a", 3), ("c", 1)]), (0, [])]
