"""Sources, projections and sinks on literal events."""

import json
from datetime import datetime, timezone

import pytest
from pyspark.sql import functions as F

from loglake.functions import events as E
from loglake.functions import timestamps as Tm
from loglake.operators import documents as D
from loglake.operators.metrics import first_metrics, new_metrics
from loglake.plans.ingest import normalise, place
from loglake.schema import COLLECTIONS, LOG_EVENT
from loglake.sinks.logs import write_logs
from loglake.sinks.metrics import write_metrics
from loglake.sinks.wire import to_event_json
from loglake.sources import events as S
from loglake.sources.metrics import read_metric_table, read_metrics
from loglake.sources.stored import read_latest

EVENT = {
    "category": "ERROR", "timestamp": "1970-01-01T00:00:00Z", "level": "ERROR", "message": "disk nearly full",
    "threadName": "worker-7", "throwable": "java.io.IOException: no space left",
}


def events(spark, *changes):
    rows = [{**EVENT, **c} for c in changes]
    return spark.createDataFrame([tuple(r.get(f) for f in LOG_EVENT.fieldNames()) for r in rows], LOG_EVENT)


def test_flatten(spark):
    df = events(spark, {"id": "7", "properties": {"property1": "15", "property2": "true"}})
    row = E.flatten_event(df).first()
    assert row["fields"] == {**EVENT, "application": "", "property1": "15", "property2": "true"}
    assert row["id"] == "7"


def test_flatten_override_and_missing(spark):
    df = events(spark, {"throwable": None, "properties": {"level": "odd"}, "application": "a"}, {"properties": None})
    first, second = E.flatten_event(df).collect()
    assert first["fields"]["level"] == "odd" and first["fields"]["throwable"] == ""
    assert first["fields"]["application"] == "a" and len(second["fields"]) == 7


def test_read_events_and_reject(spark, tmp_path):
    lines = [json.dumps(EVENT), '{"a":"b"}', "broken", json.dumps({**EVENT, "ndc": "x", "thrown": ["y"]})]
    (tmp_path / "in.json").write_text("\n".join(lines))
    df = S.read_log_events(spark, str(tmp_path), "app")
    assert D.valid_events(df).count() == 2 and D.rejected_events(df).count() == 2
    assert {r["application"] for r in df.collect()} == {"app"}


def test_event_array(spark):
    bodies = [(json.dumps([EVENT, EVENT]), "a"), ("[]", "b"), ("nothing", "c")]
    df = spark.createDataFrame(bodies, "body string, app string")
    rows = S.explode_event_array(df, "body", F.col("app")).collect()
    assert [(r["application"], r["message"]) for r in rows] == [("a", "disk nearly full")] * 2


def test_json_maps(spark):
    df = spark.createDataFrame([('[{"id": 5, "n": 1.5, "o": {"x": 1}}, {"b": "c"}]',)], "body string")
    rows = S.read_json_maps(df, "body", F.lit("app")).collect()
    assert [r["id"] for r in rows] == ["5", None]
    assert rows[0]["fields"] == {"id": "5", "n": "1.5", "o": '{"x":1}'}


def test_kafka_values(spark):
    values = [json.dumps({**EVENT, "application": "app"}), '{"level": "INFO"}', "oops", None]
    df = spark.createDataFrame([(v.encode() if v else None,) for v in values], "value binary")
    decoded = S.decode_kafka_value(df)
    assert [r["application"] for r in decoded.collect()] == ["app", "", "", ""]
    assert D.rejected_messages(decoded).count() == 2


def test_log_lines(spark):
    lines = ["19/05/07 12:00:01 INFO a.b.C: hello: world", "\tat some.stack(frame)", "19/13/45 12:00:01 WARN x: y"]
    rows = S.parse_log_lines(spark.createDataFrame([(x,) for x in lines], "value string"), "app").collect()
    assert rows[0]["ts"] == datetime(2019, 5, 7, 12, 0, 1) and rows[0]["timestamp"] == "2019-05-07T12:00:01Z"
    assert (rows[0]["level"], rows[0]["category"], rows[0]["message"]) == ("INFO", "a.b.C", "hello: world")
    assert rows[1]["ts"] is None and rows[1]["message"] == "\tat some.stack(frame)"
    assert rows[2]["ts"] is None and rows[2]["level"] == "WARN"


def test_paths(spark):
    paths = [
        "/data1/yarn/container-logs/application_1542215373081_0707/container_1542215373081_0707_01_000002", "x", None, "",
        "a/b",
    ]
    df = spark.createDataFrame([(p,) for p in paths], "p string")
    rows = df.select(E.spark_application_id("p").alias("a"), E.spark_container_id("p").alias("c")).collect()
    assert [(r["a"], r["c"]) for r in rows] == [
        ("application_1542215373081_0707", "01_000002"), ("", ""), ("", ""), ("", ""), ("a", "")
    ]


def test_timestamps(spark):
    df = spark.createDataFrame([(1, "2018-04-06T10:15:00.25")], "ms bigint, t string")
    row = df.select(
        Tm.epoch_millis_to_iso("ms").alias("iso"), Tm.unix_time_micros("t", Tm.DEFAULT_STRFTIME).alias("us")
    ).first()
    assert row["iso"] == "1970-01-01T00:00:00Z"
    assert row["us"] == int(datetime(2018, 4, 6, 10, 15, tzinfo=timezone.utc).timestamp()) * 10**6 + 250_000
    with pytest.raises(ValueError):
        Tm.spark_pattern("%Q")


def test_typed_fields(spark):
    fields = {"a_i": "1", "b_i": "x", "c_l": "5000000000", "d_f": "1.5", "e_d": "2.5", "host": "h", "_s": "s"}
    row = E.typed_fields(spark.createDataFrame([(fields,)], "fields map<string,string>")).first()
    assert row["ints"] == {"a_i": 1, "b_i": None} and row["longs"] == {"c_l": 5_000_000_000}
    assert row["floats"] == {"d_f": 1.5} and row["doubles"] == {"e_d": 2.5}
    assert row["strings"] == {"host": "h", "_s": "s"} and row["fields"] == fields


def test_gauge(spark):
    rows = [(datetime(2024, 1, 1), "app", m) for m in ("metric: queue_length_i=10", "metric: s=up", "x metric: a=1")]
    out = E.extract_gauge(spark.createDataFrame(rows, "ts timestamp, application string, message string")).collect()
    assert [(r["key"], r["tag"], r["value"]) for r in out] == [("app", "queue_length_i", 10.0)]


def test_mdc_and_stack(spark):
    df = spark.createDataFrame([({"a": "1", "k": "p"}, {"k": "m"}, ["x", "y"])], "p map<string,string>, m map<string,string>, s array<string>")
    row = df.select(E.merge_mdc("p", "m").alias("m"), E.join_stack("s").alias("t")).first()
    assert row["m"] == {"a": "1", "k": "m"} and row["t"] == "x\ny"


def test_wire_json(spark):
    df = events(spark, {"throwable": None, "properties": {"key": "value"}}).withColumn("ndc", F.lit("n"))
    body = json.loads(to_event_json(df).first()["body"])
    assert body["properties"] == {"key": "value"} and body["thrown"] == [] and "throwable" not in body
    assert list(body) == ["category", "timestamp", "level", "message", "threadName", "ndc", "properties", "thrown"]


def test_ids(spark):
    df = spark.createDataFrame([("x", 1), (None, 2), (None, 2)], "id string, n int")
    random = [r["id"] for r in D.assign_id(df).collect()]
    assert random[0] == "x" and len(set(random)) == 3
    fixed = [r["id"] for r in D.assign_id(df, deterministic=True).collect()]
    assert fixed[0] == "x" and fixed[1] == fixed[2]


def test_upsert(spark):
    rows = [("a", 1, "old"), ("a", 3, "new"), ("b", 2, "only")] + [("hot", i, str(i)) for i in range(500)]
    out = D.upsert_latest(spark.createDataFrame(rows, "id string, version int, doc string").repartition(6))
    assert {r["id"]: r["doc"] for r in out.collect()} == {"a": "new", "b": "only", "hot": "499"}


def test_write_logs_and_read_back(spark, tmp_path):
    df = events(
        spark,
        {"application": "a", "timestamp": "2024-01-01T00:00:00Z", "properties": {"hostname": "host1.com", "n_i": "4"}},
        {"application": "a", "timestamp": "2024-01-02T00:00:01Z"},
        {"application": "b", "timestamp": "2024-01-05T00:00:00Z"},
        {"level": None},
    )
    known = [("a", "a_1704067200", 1704067200), ("a", "a_1704153600", 1704153600), ("b", "b_1704412800", 1704412800)]
    catalogue = spark.createDataFrame(known, COLLECTIONS)
    write_logs(place(normalise(df), catalogue, by_time=True), str(tmp_path / "logs"))
    rows = spark.read.parquet(str(tmp_path / "logs")).orderBy("ts").collect()
    assert [r["collection"] for r in rows] == ["a_1704067200", "a_1704153600", "b_1704412800"]
    assert rows[0]["hostname"] == "host1.com" and rows[0]["fields"] == {"n_i": "4"}
    assert all(r["id"] for r in rows)


def test_metric_request(spark):
    body = {"table_name": "metrics", "payload": [{"ts": 1, "key": "key", "tag": "tag", "value": 1.4}]}
    rows = read_metrics(spark.createDataFrame([(json.dumps(body),), ("x",)], "b string"), "b").collect()
    assert [tuple(r) for r in rows] == [("metrics", datetime(1970, 1, 1, 0, 0, 0, 1), "key", "tag", 1.4)]


def metric_rows(spark, *rows):
    df = spark.createDataFrame(list(rows), "ts bigint, key string, tag string, value double")
    return df.withColumn("ts", F.timestamp_micros("ts"))


def test_metrics_table(spark, tmp_path):
    path = str(tmp_path / "metrics")
    write_metrics(metric_rows(spark), path)
    many = metric_rows(spark, *[(n, "id", "metric", 1.5) for n in range(1001)])
    write_metrics(many, path)
    assert read_metric_table(spark, path).count() == 1001
    again = metric_rows(spark, (5, "id", "metric", 9.0), (5000, "id", "metric", 2.0), (5000, "id", "metric", 3.0))
    with pytest.raises(ValueError):
        write_metrics(again, path, on_conflict="error")
    assert read_metric_table(spark, path).count() == 1001
    write_metrics(again, path)
    stored = {r["ts"].microsecond: r["value"] for r in read_metric_table(spark, path).collect()}
    assert len(stored) == 1002 and stored[5] == 1.5 and stored[5000] == 2.0


def test_a_wrong_folder_is_an_error(spark, tmp_path):
    (tmp_path / "metrics").mkdir()
    (tmp_path / "metrics" / "part.parquet").write_text("no parquet")
    with pytest.raises(Exception, match="(?i)parquet|schema"):
        write_metrics(metric_rows(spark, (1, "k", "t", 1.0)), str(tmp_path / "metrics"))


def test_unreadable_time_is_rejected_with_its_text(spark):
    df = events(spark, {"timestamp": "not a date"}, {"timestamp": None}, {})
    assert normalise(df.withColumn("application", F.lit("a"))).count() == 1
    assert {r["timestamp"] for r in D.rejected_events(df).collect()} == {"not a date", None}


def test_a_property_does_not_move_a_row(spark):
    df = events(spark, {"application": "a", "properties": {"application": "other"}}, {"application": None, "properties": {"application": "b"}})
    rows = normalise(df).collect()
    assert [(r["application"], r["fields"].get("application")) for r in rows] == [("a", "other"), ("b", None)]


def test_free_form_rows_are_stored(spark):
    body = json.dumps([{**EVENT, "id": "9", "extra_i": "4"}, {"level": "INFO"}])
    maps = S.read_json_maps(spark.createDataFrame([(body,)], "body string"), "body", F.lit("app"))
    rows = normalise(maps).collect()
    assert [(r["id"], r["application"], r["fields"]) for r in rows] == [("9", "app", {"extra_i": "4"})]
    assert D.rejected_events(maps).count() == 1


def test_new_metrics_keep_order_of_arrival(spark):
    rows = [(1, "k", "t", 5.0, 2), (1, "k", "t", 7.0, 1)]
    df = spark.createDataFrame(rows, "ts bigint, key string, tag string, value double, seq int")
    assert first_metrics(df, "seq").first()["value"] == 7.0
    assert new_metrics(df, df).count() == 0


@pytest.mark.parametrize("swapped", [False, True])
def test_rows_of_one_write_are_read_alike_in_any_order(spark, tmp_path, swapped):
    schema = "id string, application string, ts timestamp, message string, fields map<string,string>"
    at = lambda m: datetime(2024, 1, 1, 0, m)
    rows = [("x", "a", at(0), "first", {"k": "1"}), ("x", "a", at(5), "second", {"k": "2"}), ("x", "a", at(5), "third", None),
            ("y", "a", at(1), "same", {"k": "1"}), ("y", "a", at(1), "same", {"k": "2"})]
    catalogue = spark.createDataFrame([("a", "a_0", 0)], COLLECTIONS)
    df = spark.createDataFrame(rows[::-1] if swapped else rows, schema).repartition(3 if swapped else 1)
    write_logs(place(df, catalogue, version=1), str(tmp_path / "logs"))
    found = {r["id"]: (r["message"], r["fields"]) for r in read_latest(spark.read.parquet(str(tmp_path / "logs"))).collect()}
    other = {r["id"]: (r["message"], r["fields"]) for r in read_latest(place(df.orderBy("message"), catalogue, version=1)).collect()}
    assert found == other and found["x"][0] in ("second", "third")
    chosen = {"x": ("third", None) if found["x"][0] == "third" else ("second", {"k": "2"}), "y": found["y"]}
    assert found == chosen
