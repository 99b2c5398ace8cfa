"""Streams over several files and restarts."""

import json
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from loglake.operators import suppression as W
from loglake.operators import windows as T
from loglake.operators.rules import triggered
from loglake.schema import COLLECTIONS
from loglake.sinks.wire import kafka_messages
from loglake.sources import config as C
from loglake.sources.events import decode_kafka_value, read_log_events
from loglake.streaming.alerts import alert_rounds, alert_stream, suppress_stream
from loglake.streaming.ingest import ingest_stream
from loglake.streaming.windows import sliding_count_stream, unique_events

BASE = datetime(2024, 1, 1, tzinfo=timezone.utc)
LOG = "id string, application string, ts timestamp, level string"


def put(path, name, events):
    path.mkdir(exist_ok=True)
    (path / name).write_text("\n".join(json.dumps(e) for e in events))


def log_event(n, minute, level="ERROR", app="a"):
    at = (BASE + timedelta(minutes=minute)).strftime("%Y-%m-%dT%H:%M:%SZ")
    return {"id": str(n), "application": app, "ts": at, "level": level}


def stream_of(spark, path, schema=LOG):
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("latestFirst", False).json(str(path))


def wire(n, app):
    return {"id": str(n), "category": "c", "timestamp": "2024-01-01T00:00:00Z", "level": "INFO", "message": f"m{n}",
            "threadName": "t", "application": app, "properties": {"n_i": str(n)}}


def test_ingest_resumes_without_loss_or_repeats(spark, tmp_path):
    source, out, checkpoint = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "cp")
    catalogues = [spark.createDataFrame([], COLLECTIONS)]

    def run():
        events = read_log_events(spark, str(source), streaming=True)
        ingest_stream(
            events, lambda: catalogues[-1], catalogues.append, out, checkpoint, None, clock=lambda: BASE
        ).awaitTermination()
        return sorted(int(r["id"]) for r in spark.read.parquet(out).collect())

    put(source, "1.json", [wire(n, "a") for n in range(4)] + [{"a": "b"}])
    assert run() == [0, 1, 2, 3]
    put(source, "2.json", [wire(n, "b") for n in range(4, 8)])
    assert run() == list(range(8))
    assert run() == list(range(8))
    row = spark.read.parquet(out).filter("id = '5'").first()
    assert row["collection"] == "b_1704067200" and row["fields"] == {"n_i": "5"}


def error_apps(threshold=0, retry=10, names=("a", "b")):
    return [C.Application(n, (C.AlertRule("level = 'ERROR'", retry, ("ops",), threshold),)) for n in names]


def test_alert_stream_across_batches(spark, tmp_path):
    source, path, checkpoint = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "cp")
    minutes = [0, 1, 2, 30, 31, 55, 56, 90, 120, 121, 200, 260, 300]
    rows = []
    for i, part in enumerate([minutes[:4], minutes[4:7], minutes[7:11], minutes[11:]]):
        events = [log_event(10 * i + j, m) for j, m in enumerate(part)]
        put(source, f"{i}.json", events)
        rows += events
        # Each part arrives in a run of its own: the state has to survive a restart.
        alert_stream(stream_of(spark, source), error_apps(), path, checkpoint, interval=None).awaitTermination()
    sent = {(r["application"], r["eval_ts"]) for r in spark.read.parquet(f"{path}/alerts").collect()}

    logs = spark.createDataFrame([(r["id"], r["application"], r["ts"], r["level"]) for r in rows], "id string, application string, ts string, level string")
    logs = logs.withColumn("ts", F.to_timestamp("ts"))
    closed = BASE + timedelta(minutes=290)
    firings = triggered(T.rule_counts_by_tick(logs, error_apps(), 10)).filter(F.col("eval_ts") <= F.lit(closed))
    assert sent == {(r["application"], r["eval_ts"]) for r in W.suppress_repeats(firings).collect()}
    assert len(sent) > 5


@pytest.mark.parametrize("retry", [10, 60, 1440])
def test_dense_alert_stream_across_batches(spark, tmp_path, retry):
    """An error every minute for five hours: the waits reach over the ends of the batches."""
    source, path = tmp_path / "in", str(tmp_path / "out")
    for i in range(3):
        put(source, f"{i}.json", [log_event(1000 * i + m, 100 * i + m) for m in range(100)])
        alert_stream(stream_of(spark, source), error_apps(retry=retry), path, str(tmp_path / "cp"), interval=None).awaitTermination()
    sent = sorted(r["eval_ts"] for r in spark.read.parquet(f"{path}/alerts").collect())
    closed = BASE.replace(tzinfo=None) + timedelta(minutes=289)
    at, expected = BASE.replace(tzinfo=None) + timedelta(minutes=1), []
    while at <= closed:
        expected.append(at)
        at += timedelta(minutes=retry + 1)
    assert sent == expected


def test_absence_rules_on_a_stream(spark, tmp_path):
    """Two rules watch for silence: one application logs now and then, the other never does."""
    source, path = tmp_path / "in", str(tmp_path / "out")
    hits = [0, 3, 4, 31, 60, 61, 95, 140]
    for i, part in enumerate([hits[:3], hits[3:5], hits[5:]]):
        put(source, f"{i}.json", [log_event(10 * i + j, m) for j, m in enumerate(part)])
        stream = stream_of(spark, source)
        alert_stream(stream, error_apps(-1, retry=3), path, str(tmp_path / "cp"), interval=None, since=BASE).awaitTermination()
    rows = spark.read.parquet(f"{path}/alerts").collect()
    assert {r["total_num_found"] for r in rows} == {0}

    def expected(hits):
        sent, last = [], None
        for t in range(131):  # the watermark ends at minute 130
            silent = not any(t - 10 <= h < t for h in hits)
            if silent and (last is None or t >= last + 4):
                sent.append(BASE.replace(tzinfo=None) + timedelta(minutes=t))
                last = t
        return sent

    assert sorted(r["eval_ts"] for r in rows if r["application"] == "a") == expected(hits)
    assert sorted(r["eval_ts"] for r in rows if r["application"] == "b") == expected([])


def test_alert_state_ends(spark, tmp_path):
    """A rule keeps state while it looks back on counts or waits; afterwards none is left."""
    source, path, left = tmp_path / "in", str(tmp_path / "out"), []
    for i, minute in enumerate([0, 25, 400]):
        # rows without a hit move the watermark on
        put(source, f"{i}.json", [{**log_event(i, minute), "level": "ERROR" if i == 0 else "INFO"}])
        query = alert_stream(stream_of(spark, source), error_apps(retry=60), path, str(tmp_path / "cp"), interval=None)
        query.awaitTermination()
        left.append([o["numRowsTotal"] for o in query.recentProgress[-1]["stateOperators"] if "transform" in o["operatorName"]])
    assert spark.read.parquet(f"{path}/alerts").count() == 1
    assert left[1][0] > 0 and left[2] == [0]


def test_threshold_counts_rows_not_files(spark, tmp_path):
    source, path = tmp_path / "in", str(tmp_path / "out")
    put(source, "1.json", [log_event(i, 1) for i in range(3)])
    put(source, "2.json", [log_event(9, 2), log_event(10, 60)])
    alert_stream(stream_of(spark, source), error_apps(3), path, str(tmp_path / "cp"), interval=None).awaitTermination()
    rows = spark.read.parquet(f"{path}/alerts").collect()
    assert [(r["eval_ts"], r["total_num_found"]) for r in rows] == [(datetime(2024, 1, 1, 0, 3), 4)]


def test_suppress_stream_keeps_state(spark, tmp_path):
    source = tmp_path / "in"
    schema = "application string, rule_id string, retry_interval int, eval_ts timestamp"
    firing = lambda m: {"application": "a", "rule_id": "r", "retry_interval": 10,
                        "eval_ts": (BASE + timedelta(minutes=m)).isoformat()}
    got = []

    def run():
        df = suppress_stream(stream_of(spark, source, schema))
        q = df.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp"))
        q.trigger(availableNow=True).start().awaitTermination()

    put(source, "1.json", [firing(0), firing(5), firing(11)])
    run()
    put(source, "2.json", [firing(15), firing(21), firing(22)])
    run()
    got = sorted(r["eval_ts"] for r in spark.read.parquet(str(tmp_path / "out")).collect())
    assert got == [datetime(2024, 1, 1) + timedelta(minutes=m) for m in (0, 11, 22)]


def test_suppress_stream_state_ends(spark, tmp_path):
    source = tmp_path / "in"
    schema = "application string, rule_id string, retry_interval int, eval_ts timestamp"
    firing = lambda r, m: {"application": "a", "rule_id": r, "retry_interval": 10,
                           "eval_ts": (BASE + timedelta(minutes=m)).isoformat()}
    left = []
    for i, rows in enumerate([[firing("r", 0), firing("s", 1)], [firing("t", 15)], [firing("t", 300)], [firing("r", 900)]]):
        put(source, f"{i}.json", rows)
        df = suppress_stream(stream_of(spark, source, schema), "1 minute")
        q = df.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp"))
        query = q.trigger(availableNow=True).start()
        query.awaitTermination()
        left.append(query.recentProgress[-1]["stateOperators"][0]["numRowsTotal"])
    assert spark.read.parquet(str(tmp_path / "out")).count() == 5
    assert left == [2, 1, 1, 1]


def test_alert_rounds(spark, tmp_path):
    """Rounds at minutes 0, 5 and 11 over the same logs: the second is held back, absence rules included."""
    logs = spark.createDataFrame([("1", "a", BASE, "ERROR", "m")], LOG + ", message string")
    apps = [C.Application("a", (C.AlertRule("level = 'ERROR'", 10, ("ops",)), C.AlertRule("level = 'FATAL'", 3, ("ops",), -1)))]
    source, rounds, clock = tmp_path / "ticks", [], iter([0, 5, 11])
    for i in range(3):
        put(source, f"{i}.json", [{"n": i}])
    alert_rounds(
        stream_of(spark, source, "n int"), lambda: logs, apps, str(tmp_path / "state"), str(tmp_path / "cp"),
        lambda alerts: rounds.append(sorted(r["query"] for r in alerts.collect())),
        interval=None, clock=lambda: BASE + timedelta(minutes=next(clock)),
    ).awaitTermination()
    assert rounds == [["level = 'ERROR'", "level = 'FATAL'"], ["level = 'FATAL'"], ["level = 'ERROR'", "level = 'FATAL'"]]


def test_late_rows_are_not_counted(spark, tmp_path):
    source = tmp_path / "in"
    parts = [
        [log_event(1, 0), log_event(2, 60)],
        [log_event(3, 0), log_event(4, 55), log_event(5, 120)],
        [log_event(6, 240)],
    ]
    for i, part in enumerate(parts):
        put(source, f"{i}.json", part)
        df = sliding_count_stream(stream_of(spark, source), ["application"], "10 minutes", "10 minutes", "10 minutes")
        q = df.writeStream.format("parquet").option("path", str(tmp_path / "out"))
        q.option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination()
    counts = {r["start"].hour * 60 + r["start"].minute: r["n"] for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert counts == {0: 1, 50: 1, 60: 1, 120: 1}


def test_unique_events(spark, tmp_path):
    source = tmp_path / "in"
    put(source, "1.json", [log_event(1, 0), log_event(1, 1), log_event(2, 1)])
    put(source, "2.json", [log_event(1, 2), log_event(3, 2)])
    q = unique_events(stream_of(spark, source)).writeStream.format("parquet").option("path", str(tmp_path / "out"))
    q.option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination()
    assert sorted(r["id"] for r in spark.read.parquet(str(tmp_path / "out")).collect()) == ["1", "2", "3"]


def test_kafka_round_trip_through_files(spark, tmp_path):
    source = tmp_path / "topic"
    events = [wire(n, "a" if n % 2 else "") for n in range(4)]
    df = spark.createDataFrame([(e["application"], e["message"]) for e in events], "application string, message string")
    kafka_messages(df).write.text(str(source))
    stream = decode_kafka_value(spark.readStream.text(str(source)))
    q = stream.writeStream.format("memory").queryName("kafka_files").trigger(availableNow=True).start()
    q.awaitTermination()
    rows = spark.table("kafka_files").collect()
    assert sorted(r["fields"]["message"] for r in rows) == ["m0", "m1", "m2", "m3"]
    assert sorted(r["application"] for r in rows) == ["", "", "a", "a"]
