"""Conditions that share shapes: how they are read, that the index finds what each alone finds, and what plans cost."""

import random
from datetime import datetime, timedelta, timezone

import pytest

from loglake.operators import rules as J
from loglake.operators.rule_index import read_condition
from loglake.sources import config as C

NOW = datetime(2024, 1, 2, tzinfo=timezone.utc)
LOG = "id string, application string, ts timestamp, level string, message string, version bigint, load double, fields map<string,string>"


def rule(query, **more):
    return C.AlertRule(query, 10, ("ops",), 0, **more)


@pytest.fixture(scope="module")
def logs(spark):
    draw = random.Random(11)
    rows = [
        (str(i), draw.choice("abc"), NOW - timedelta(minutes=i), draw.choice(["ERROR", "WARN", "INFO", None]),
         draw.choice(["slow", "fast", "it's", "5", None]), draw.choice([None, *range(12)]), draw.choice([None, 1.0, 2.5]),
         {"k": str(draw.randint(0, 9))} if i % 3 else None)
        for i in range(300)
    ]
    return spark.createDataFrame(rows, LOG).cache()


@pytest.mark.parametrize(
    ("text", "conjuncts", "constants"),
    [
        ("level = 'ERROR' AND version >= 12", [("level = _", "level"), ("version >= _", None)], [("ERROR",), (12,)]),
        ("hour(ts) = 4 AND a BETWEEN 1 AND 5", [("hour(ts) = _", "hour(ts)"), ("a BETWEEN _ AND _", None)], [(4,), (1, 5)]),
        ("(a = 1 OR b = 'x') AND c = 5", [("(a = _ OR b = _)", None), ("c = _", "c")], [(1, "x"), (5,)]),
        ("a = 1 AND b = 2 OR c = 3", [("a = _ AND b = _ OR c = _", None)], [(1, 2, 3)]),
        ("NOT a = 1 and b = 2", [("NOT a = _", None), ("b = _", "b")], [(1,), (2,)]),
        ("a = 1 = b AND c = 1 + x AND d = 1.5 AND e = -1 AND f = DATE '2024-01-01'",
         [("a = 1 = b", None), ("c = 1 + x", None), ("d = 1.5", None), ("e = -1", None), ("f = DATE '2024-01-01'", None)],
         [(), (), (), (), ()]),
        ("a BETWEEN (b = 1 AND c) AND 5 AND d IN (1, 2)", [("a BETWEEN (b = _ AND c) AND _", None), ("d IN (1, 2)", None)], [(1, 5), ()]),
        (r"x = 'it''s' AND y = 'a\'b'", [("x = 'it''s'", None), (r"y = 'a\'b'", None)], [(), ()]),
        ("CASE WHEN a THEN b = 2 AND c ELSE d END AND e = 'AND'", [("CASE WHEN a THEN b = _ AND c ELSE d END", None), ("e = _", "e")], [(2,), ("AND",)]),
    ],
)
def test_reading(text, conjuncts, constants):
    found = read_condition(text)
    assert [(c.text.replace("\x00", "_"), c.equal_to) for c in found.conjuncts] == conjuncts
    assert list(found.constants) == constants


@pytest.mark.parametrize("text", ["", "a = 1 -- no", "a = 1 /* no */ AND b = 2", "(a = 1", "end = 3"])
def test_not_read(text):
    assert read_condition(text) is None


def _pool(draw: random.Random) -> str:
    level, word = draw.choice(["ERROR", "WARN", "INFO"]), draw.choice(["slow", "fast", "nothing"])
    low = draw.randint(0, 9)
    return draw.choice(
        [
            f"level = '{level}' AND version >= {low}",
            f"level = '{level}' AND message = '{word}'",
            f"hour(ts) = {low} AND level <=> '{level}'",
            f"version = {low}",
            f"load = {draw.randint(1, 2)}",
            f"message = {draw.randint(4, 6)}",
            f"try_cast(fields['k'] AS INT) BETWEEN {low} AND {low + 3} AND (level = '{level}' OR message = '{word}')",
            f"NOT (level = '{level}') AND version <> {low}",
            f"ts >= '2024-01-01 2{draw.randint(0, 3)}:00:00'",
            f"level = '{level}' AND version > {low} OR message = '{word}'",
            f"version = {3_000_000_000 + low} OR version < {low}",
            f"message LIKE '%{word[:2]}%'",
        ]
    )


@pytest.mark.parametrize("seed", [1, 2])
def test_counts_equal_one_query_per_rule(spark, logs, seed):
    draw = random.Random(seed)
    spark.conf.set("spark.sql.ansi.enabled", "false")
    try:
        apps = [
            C.Application(n, tuple({(t := _pool(draw)): rule(t, lookback=draw.choice([None, 30, 200])) for _ in range(80)}.values()))
            for n in "abc"
        ]
        found = {(r["application"], r["rule_id"]): r["total_num_found"] for r in J.evaluate_rules(logs, apps, NOW).collect()}
        assert len(found) == sum(len(a.alert_rules) for a in apps)
        for a in apps:
            ours = J.at_time(logs.filter(f"application = '{a.name}'"), NOW).cache()
            for r in a.alert_rules:
                assert found[a.name, r.rule_id] == ours.filter(r.condition()).count(), r
        assert any(found.values())
    finally:
        spark.conf.unset("spark.sql.ansi.enabled")


def test_documents_of_indexed_rules(logs):
    rules = tuple(rule(f"level = 'ERROR' AND version >= {i}") for i in range(8))
    found = J.rule_documents(logs, [C.Application("a", rules)], NOW, ["id"], 3).collect()
    for r in rules:
        want = logs.filter("application = 'a'").filter(r.query).orderBy("ts", ascending=False).limit(3).collect()
        (documents,) = [f["documents"] for f in found if f["rule_id"] == r.rule_id]
        assert [d["id"] for d in documents] == [w["id"] for w in want]


def test_bad_shapes_cost_only_themselves(logs):
    bad = [rule(f"nope = {i}") for i in range(3)] + [rule(f"level ==== {i}") for i in range(3)]
    good = [rule(f"version = {i}") for i in range(3)]
    found = J.evaluate_rules(logs, [C.Application("a", (*bad, *good))], NOW).collect()
    assert sorted(r["query"] for r in found) == [r.query for r in good]


def _plan(logs, n: int) -> str:
    rules = tuple(rule(f"level = 'ERROR' AND version = {i % 97} AND message <> 'm{i}'") for i in range(n))
    found = J.evaluate_rules(logs, [C.Application("a", rules)], NOW)
    return found._jdf.queryExecution().optimizedPlan().toString()


def test_plan_does_not_grow_with_the_rules(spark, tmp_path, logs):
    logs.write.parquet(f"{tmp_path}/logs")
    stored = spark.read.parquet(f"{tmp_path}/logs")
    few, many = _plan(stored, 20), _plan(stored, 3_000)
    assert many.count("parquet") == few.count("parquet") == 1
    assert many.count("\n") == few.count("\n")
    unlisted = lambda plan: [line for line in plan.split("\n") if "LocalRelation" not in line]
    assert abs(sum(map(len, unlisted(many))) - sum(map(len, unlisted(few)))) < 200
