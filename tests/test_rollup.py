"""Counts stored by ingest: what rounds read from them, conditions that come later, replays and runs that break off."""

import json
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from loglake.operators import rollup as U
from loglake.operators import rules as J
from loglake.plans.alerting import run_round
from loglake.schema import COLLECTIONS
from loglake.sources import config as C
from loglake.streaming.alerts import alert_rounds
from loglake.streaming.ingest import ingest_stream

BASE = datetime(2024, 1, 1, tzinfo=timezone.utc)
LOG = "id string, application string, collection string, ts timestamp, level string, message string"


def rule(query, threshold=0, **more):
    return C.AlertRule(query, 1, ("ops",), threshold, **more)


def row(i, minute, application="a", level="ERROR", collection="_0"):
    return (str(i), application, application + collection, BASE + timedelta(minutes=minute, seconds=7), level, f"m{i}")


@pytest.fixture
def logs(spark):
    rows = [row(i, i // 2, "ab"[i % 3 == 0], ["ERROR", "INFO"][i % 5 == 0], ["_0", "_1"][i > 60]) for i in range(120)]
    return spark.createDataFrame(rows, LOG)


APPS = [
    C.Application("a", (rule("level = 'ERROR'", lookback=10), rule("level = 'ERROR'"), rule("message = 'm4'", lookback=100), rule("ts > eval_ts"))),
    C.Application("b", (rule("level = 'INFO'", lookback=30), rule("level = 'ERROR'", lookback=10), rule("nope = 1"))),
]


def totals(df):
    return {(r["application"], r["query"], r["rule_id"]): r["total_num_found"] for r in df.collect()}


def test_round_from_counts_equals_round_from_logs(spark, logs, tmp_path):
    path = str(tmp_path)
    U.cover(spark, path, None, APPS)
    for batch, part in enumerate([F.col("id") < "4", F.col("id") >= "4"]):
        U.write_rollup(logs.filter(part), APPS, path, batch)
    U.write_rollup(logs.filter(F.col("id") >= "4"), APPS, path, 1)  # replayed
    fitting, others = U.can_roll_up(APPS)
    assert [[r.query for r in a.alert_rules] for a in others] == [["ts > eval_ts"], []]
    fitting = [C.Application(a.name, tuple(r for r in a.alert_rules if r.query != "nope = 1")) for a in fitting]
    for minute in (5, 40, 300):
        now = BASE + timedelta(minutes=minute)
        found = U.evaluate_rollup(U.read_rollup(spark, path), fitting, now)
        before = logs.filter(F.col("ts") < F.lit(now))
        assert totals(found) == totals(J.evaluate_rules(before, fitting, now))
    assert U.evaluate_rollup(U.read_rollup(spark, str(tmp_path / "none")), fitting, BASE).filter("total_num_found > 0").count() == 0


def test_a_round_reads_no_log_row_for_counts(spark, logs, tmp_path):
    path = str(tmp_path)
    U.cover(spark, path, logs, APPS)
    unreadable = logs.withColumn("message", F.raise_error(F.lit("a log row was read"))).filter("message IS NOT NULL")
    quiet = [C.Application("a", (rule("level = 'ERROR'", 10_000), rule("message = 'm4'", -1)))]
    assert run_round(unreadable, quiet, BASE + timedelta(hours=2), rollup=U.read_rollup(spark, path)).count() == 0
    firing = [C.Application("a", (rule("level = 'ERROR'", 5),))]
    (alert,) = run_round(logs, firing, BASE + timedelta(hours=2), rollup=U.read_rollup(spark, path)).collect()
    assert alert["total_num_found"] == logs.filter("application = 'a' AND level = 'ERROR'").count()
    assert len(alert["documents"]) == 10


def test_new_conditions_are_counted_once(spark, logs, tmp_path, monkeypatch):
    path = str(tmp_path)
    errors, infos = [C.Application("a", (rule(f"level = '{level}'"),)) for level in ("ERROR", "INFO")]
    both = [C.Application("a", (*errors.alert_rules, *infos.alert_rules))]
    assert U.cover(spark, path, logs.filter("collection = 'a_0'"), [errors]) == 1
    U.write_rollup(logs.filter("collection = 'a_1'"), [errors], path, 0)
    # a run that breaks off after the counts are written
    with monkeypatch.context() as broken, pytest.raises(RuntimeError):
        broken.setattr(U, "write_rollup", _break_after(U.write_rollup))
        U.cover(spark, path, logs, both)
    assert U.cover(spark, path, logs, both) == 1
    assert U.cover(spark, path, logs, both) == 0
    now = BASE + timedelta(days=1)
    found = totals(U.evaluate_rollup(U.read_rollup(spark, path), both, now))
    assert found == totals(J.evaluate_rules(logs.filter("application = 'a'"), both, now))


def _break_after(write):
    def run(*args):
        write(*args)
        raise RuntimeError

    return run


def test_a_rule_that_fails_on_the_data_costs_only_itself(spark, logs, tmp_path):
    path = str(tmp_path)
    apps = [C.Application("a", (rule("cast(message AS INT) > 0"), rule("level = 'ERROR'"), rule("level = 'INFO'")))]
    U.write_rollup(logs, apps, path, 0)
    found = totals(U.evaluate_rollup(U.read_rollup(spark, path), apps, BASE + timedelta(days=1)))
    want = {q: logs.filter(f"application = 'a' AND {q}").count() for q in ("level = 'ERROR'", "level = 'INFO'")}
    assert {q: n for (_, q, _), n in found.items()} == {"cast(message AS INT) > 0": 0, **want}


def test_ingest_rolls_up_and_rounds_read_it(spark, tmp_path):
    source, path, counts, checkpoint = (str(tmp_path / x) for x in ("in", "logs", "counts", "cp"))
    catalogues, rounds = [spark.createDataFrame([], COLLECTIONS)], []
    apps = [C.Application("a", (rule("level = 'ERROR'", 3, lookback=10), rule("level = 'FATAL'", -1, lookback=10)))]
    (tmp_path / "in").mkdir()
    for i in range(3):
        events = [
            {"id": f"{i}-{j}", "application": "a", "category": "c", "level": "ERROR", "message": "m", "threadName": "t",
             "timestamp": f"2024-01-01T00:{5 * i + j:02d}:00Z"} for j in range(4)
        ]
        (tmp_path / "in" / f"{i}.json").write_text("\n".join(map(json.dumps, events)))
        stream = spark.readStream.schema("id string, application string, category string, timestamp string, level string, "
                                         "message string, threadName string, throwable string, properties map<string,string>, hostname string")  # fmt: skip
        ingest_stream(
            stream.json(source), lambda: catalogues[-1], catalogues.append, path, checkpoint, None,
            clock=lambda: BASE, rollup=counts, applications=apps,
        ).awaitTermination()
    (tmp_path / "ticks").mkdir()
    (tmp_path / "ticks" / "0.json").write_text('{"n": 1}')
    alert_rounds(
        spark.readStream.schema("n int").json(str(tmp_path / "ticks")), lambda: spark.read.parquet(path), apps,
        str(tmp_path / "state"), str(tmp_path / "cp2"), lambda alerts: rounds.append(alerts.collect()), interval=None,
        clock=lambda: BASE + timedelta(minutes=15, seconds=30), read_counts=lambda: U.read_rollup(spark, counts),
    ).awaitTermination()
    found = {r["query"]: (r["total_num_found"], len(r["documents"])) for r in rounds[0]}
    # minutes 5 to 14 hold the second and the third file
    assert found["level = 'ERROR'"][0] == 8 and found["level = 'FATAL'"] == (0, 0)
