"""Rules, suppression, routing and notifications on literal fixtures, plus brute-force checks."""

import random
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from loglake.functions import predicates as P
from loglake.operators import routing as R
from loglake.operators import rules as J
from loglake.operators import suppression as W
from loglake.operators import windows as T
from loglake.plans.alerting import active_applications, notifications, run_round, triggered_alerts
from loglake.sources import config as C
from loglake.sources.stored import read_sql_rule

NOW = datetime(2024, 1, 2, tzinfo=timezone.utc)
LOG = "id string, application string, ts timestamp, level string, message string"


def rule(query, threshold=None, profiles=("ops",), retry=10, **more):
    return C.AlertRule(query, retry, profiles, threshold, **more)


def minutes_ago(n):
    return NOW - timedelta(minutes=n)


@pytest.fixture(scope="module")
def logs(spark):
    rows = [(str(i), "a", minutes_ago(i), "ERROR", f"slow {i}") for i in range(25)]
    rows += [("x", "b", minutes_ago(5), "INFO", "fast"), ("y", "b", minutes_ago(90), "ERROR", "very slow")]
    return spark.createDataFrame(rows, LOG)


def test_counts_and_zeroes(logs):
    apps = [
        C.Application("a", (rule("level = 'ERROR'", lookback=10), rule("level = 'WARN'"))),
        C.Application("b", (rule("level = 'ERROR'", lookback=10),)),
    ]
    rows = J.evaluate_rules(logs, apps, NOW).collect()
    assert {(r["application"], r["query"]): r["total_num_found"] for r in rows} == {
        ("a", "level = 'ERROR'"): 11, ("a", "level = 'WARN'"): 0, ("b", "level = 'ERROR'"): 0,
    }


def test_threshold_above_the_document_cap(logs):
    fired = triggered_alerts(logs, [C.Application("a", (rule("level = 'ERROR'", 10),))], NOW).collect()
    assert fired[0]["total_num_found"] == 25
    assert [d["id"] for d in fired[0]["documents"]] == [str(i) for i in range(10)]
    assert fired[0]["documents"][0]["timestamp"] == "2024-01-02T00:00:00Z"


def test_absence_rule(logs):
    apps = [C.Application("b", (rule("level = 'FATAL'", -1), rule("level = 'ERROR'", -1)))]
    rows = triggered_alerts(logs, apps, NOW).collect()
    assert [(r["query"], r["total_num_found"], r["documents"]) for r in rows] == [("level = 'FATAL'", 0, [])]
    strict = triggered_alerts(logs, apps, NOW, strict_reference=True)
    assert strict.count() == 2


def test_unresolvable_rule_costs_only_itself(logs):
    apps = [C.Application("a", (rule("no_such_column = 1"), rule("level = 'ERROR'"), rule("level ==== 1")))]
    assert [r["query"] for r in J.evaluate_rules(logs, apps, NOW).collect()] == ["level = 'ERROR'"]
    assert J.evaluate_rules(logs, [C.Application("a", (rule("nope = 1"),))], NOW).count() == 0


def test_rule_failing_on_the_data_costs_only_itself(logs):
    apps = [C.Application("a", (rule("cast(message AS INT) > 0"), rule("level = 'ERROR'")))]
    assert [r["query"] for r in run_round(logs, apps, NOW).collect()] == ["level = 'ERROR'"]


def test_counts_equal_one_query_per_rule(logs):
    """Random rule sets, some conditions shared between applications, with and without a look-back."""
    draw = random.Random(3)
    names = ["a", "b", "c"]
    pool = [f"message = 'slow {i}'" for i in range(6)] + ["level = 'INFO'", "level = 'ERROR'", "message LIKE '%slow%'"]
    apps = [C.Application(n, tuple(rule(q, lookback=draw.choice([None, 10_000_000])) for q in draw.sample(pool, 5))) for n in names]
    rows = J.evaluate_rules(logs, apps, NOW).collect()
    assert len(rows) == 15
    for r in rows:
        assert r["total_num_found"] == logs.filter(f"application = '{r['application']}' AND {r['query']}").count(), r


def test_a_thousand_conditions(logs):
    apps = [C.Application("a", tuple(rule(f"message = 'slow {i}'") for i in range(1200)))]
    rows = J.evaluate_rules(logs, apps, NOW).collect()
    assert len(rows) == 1200 and sum(r["total_num_found"] for r in rows) == logs.filter("application = 'a' AND message LIKE 'slow %'").count()


def test_predicate_builder_as_rule(logs):
    built = rule("slow", predicate=lambda now: P.match("message", "SLOW") & P.time_range("ts", "NOW-2HOURS", "NOW", now))
    rows = J.evaluate_rules(logs, [C.Application("b", (built,))], NOW).collect()
    assert rows[0]["total_num_found"] == 1


def test_round_with_history(spark, logs):
    apps = [C.Application("a", (rule("level = 'ERROR'"),)), C.Application("b", (rule("level = 'ERROR'"),))]
    first = run_round(logs, apps, NOW)
    assert first.count() == 2
    state = W.mark_triggered(spark.createDataFrame([], "application string, rule_id string, retry_interval int, last_triggered timestamp"), first)
    assert run_round(logs, apps, NOW, state).count() == 0
    assert run_round(logs, apps, NOW + timedelta(minutes=10, seconds=59), state).count() == 0
    assert run_round(logs, apps, NOW + timedelta(minutes=11), state).count() == 2
    # Another application with the same rule is not held back.
    assert run_round(logs, apps, NOW, state.filter("application = 'a'")).first()["application"] == "b"
    assert W.active_suppressions(state, NOW + timedelta(minutes=11)).count() == 0


def test_sql_rules(spark):
    rows = [(1, True, "slow"), (3, True, "very slow"), (2, False, "fast")]
    spark.createDataFrame(rows, "ID int, error boolean, MESSAGE string").createOrReplaceTempView("sql_rule")
    text = "SELECT * FROM sql_rule WHERE error = true ORDER BY id"
    out = read_sql_rule(spark, text)
    assert out.columns == ["id", "error", "message"] and [r["id"] for r in out.collect()] == [1, 3]
    apps = [C.Application("a", (rule(text, alert_type="sql"), rule("SELECT * FROM missing", alert_type="sql"),
                                rule("SELECT * FROM sql_rule WHERE id > 5", -1, alert_type="sql")))]
    alerts = {r["query"]: r for r in J.triggered(J.evaluate_sql_rules(spark, apps, NOW)).collect()}
    assert len(alerts) == 2 and alerts[text]["total_num_found"] == 2
    assert alerts[text]["documents"][0] == {"id": "1", "error": "true", "message": "slow"}
    assert alerts["SELECT * FROM sql_rule WHERE id > 5"]["documents"] == []


def greedy(times, wait):
    sent = []
    for t in sorted(set(times)):
        if not sent or t - sent[-1] > wait:
            sent.append(t)
    return sent


@pytest.mark.parametrize("block_minutes", [7, 60, 1440])
def test_suppression_equals_greedy(spark, block_minutes):
    """Random firings at evaluation minutes, sparse and dense, waits shorter and longer than a block."""
    draw = random.Random(block_minutes)
    base = datetime(2024, 1, 1)
    rows, expected = [], set()
    for group, (wait, count, span) in enumerate(
        [(0, 200, 300), (1, 50, 4000), (10, 2000, 3000), (10, 30, 9000), (45, 500, 5000), (3000, 300, 9000), (5, 1, 1)]
    ):
        minutes = [draw.randrange(span) for _ in range(count)]
        rows += [("app", f"r{group}", wait, base + timedelta(minutes=m)) for m in minutes]
        expected |= {(f"r{group}", base + timedelta(minutes=m)) for m in greedy(minutes, wait)}
    firings = spark.createDataFrame(rows, "application string, rule_id string, retry_interval int, eval_ts timestamp")
    sent = W.suppress_repeats(firings.repartition(5), block_minutes=block_minutes).collect()
    assert {(r["rule_id"], r["eval_ts"]) for r in sent} == expected and len(sent) == len(expected)


def test_suppression_starts_from_history(spark):
    base = datetime(2024, 1, 1)
    rows = [("app", "r", 10, base + timedelta(minutes=m)) for m in (0, 5, 8, 20, 21)]
    firings = spark.createDataFrame(rows, "application string, rule_id string, retry_interval int, eval_ts timestamp")
    history = spark.createDataFrame([("app", "r", base - timedelta(minutes=4))], "application string, rule_id string, last_triggered timestamp")
    sent = [r["eval_ts"] for r in W.suppress_repeats(firings, history).collect()]
    assert sorted(sent) == [base + timedelta(minutes=8), base + timedelta(minutes=20)]


@pytest.mark.parametrize("retry", [0, 10, 60, 1440, 3000])
def test_suppression_in_parts_equals_greedy(spark, retry):
    """Firings cut at random places; each part starts from the state the parts before it left."""
    draw = random.Random(retry)
    base, span = datetime(2024, 1, 1), 6_000
    minutes = sorted(draw.sample(range(span), 1500))
    schema = "application string, rule_id string, retry_interval int, eval_ts timestamp"
    state = spark.createDataFrame([], "application string, rule_id string, retry_interval int, last_triggered timestamp")
    cuts = [0, *sorted(draw.sample(range(span), 3)), span]
    sent = []
    for lo, hi in zip(cuts, cuts[1:], strict=False):
        part = [("app", "r", retry, base + timedelta(minutes=m)) for m in minutes if lo <= m < hi]
        found = W.suppress_repeats(spark.createDataFrame(part, schema), state)
        sent += [r["eval_ts"] for r in found.collect()]
        state = spark.createDataFrame(W.mark_triggered(state, found).groupBy("application", "rule_id").agg(
            F.max("retry_interval").alias("retry_interval"), F.max("last_triggered").alias("last_triggered")).collect(), state.schema)
    newest = W.mark_triggered  # the newest alert of a part is its state
    assert sorted(sent) == [base + timedelta(minutes=m) for m in greedy(minutes, retry)] and newest


def test_silent_stretches(spark):
    base = datetime(2024, 1, 1)
    at = lambda m: base + timedelta(minutes=m)
    apps = [C.Application("a", (rule("level = 'FATAL'", -1),)), C.Application("b", (rule("level = 'FATAL'", -1),))]
    rules = C.rules_frame(spark, apps)
    hits = rules.filter("application = 'a'").select("application", "rule_id", F.explode(F.array(*[F.lit(at(m)) for m in (0, 3, 4, 20)])).alias("eval_ts"))
    found = T.silent_stretches(hits, rules, at(0), at(10)).collect()
    got = sorted((r["application"], r["first_tick"], r["last_tick"]) for r in found)
    assert got == [("a", at(1), at(2)), ("a", at(5), at(10)), ("b", at(0), at(10))]
    assert T.absence(hits, rules, at(0), at(10)).count() == 8 + 11


def test_mark_triggered(spark):
    at = datetime(2024, 1, 1)
    schema = "application string, rule_id string, retry_interval int, last_triggered timestamp"
    state = spark.createDataFrame([("a", "r1", 10, at), ("a", "r2", 10, at)], schema)
    fired = spark.createDataFrame(
        [("a", "r1", 10, at - timedelta(hours=1)), ("b", "r1", 5, at)],
        "application string, rule_id string, retry_interval int, eval_ts timestamp",
    )
    marked = {(r["application"], r["rule_id"]): r["last_triggered"] for r in W.mark_triggered(state, fired).collect()}
    assert marked == {("a", "r1"): at - timedelta(hours=1), ("a", "r2"): at, ("b", "r1"): at}


def test_micro_batches_of_a_hot_second(spark):
    """A third of all rows in one millisecond of one application: still whole batches of at most `size`."""
    df = spark.range(30_000).select(
        F.col("id").cast("string").alias("id"),
        F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("a"), (F.col("id") % 7).cast("string"))).alias("application"),
        F.timestamp_millis(F.when(F.col("id") % 3 == 0, 1_000_500).otherwise(F.col("id") * 37)).alias("ts"),
    )
    numbered = T.micro_batches(df, 1, 1000)
    assert numbered.select("id").distinct().count() == 30_000
    batches = numbered.groupBy("application", "batch_second", "batch_no").count().collect()
    assert sum(b["count"] for b in batches) == 30_000
    hot = sorted((b["batch_no"], b["count"]) for b in batches if b["application"] == "hot" and b["batch_second"] == 1000)
    assert hot == [(i, 1000) for i in range(10)]
    assert max(b["count"] for b in batches) <= 1000


def test_batches_do_not_depend_on_the_layout(spark):
    df = spark.range(5_000).select(
        (F.col("id") % 4_000).cast("string").alias("id"), F.lit("a").alias("application"), F.col("id").alias("n"),
        F.timestamp_millis(F.lit(7_000) + F.col("id") % 3).alias("ts"),
    )
    number = lambda x: {r["n"]: r["batch_no"] for r in T.micro_batches(x, 1, 100).collect()}
    first = number(df)
    assert number(df.repartition(7)) == first and number(df.orderBy(F.desc("n")).coalesce(1)) == first
    assert sorted(first.values()) == [i // 100 for i in range(5_000)]


def test_micro_batches_of_copies(spark):
    """All rows are copies of one event."""
    df = spark.range(5000).select(F.lit("same").alias("id"), F.lit("a").alias("application"), F.timestamp_seconds(F.lit(7)).alias("ts"))
    batches = T.micro_batches(df, 1, 1000).groupBy("batch_second", "batch_no").count().collect()
    assert sorted(tuple(b) for b in batches) == [(7, i, 1000) for i in range(5)]


def test_sliding_counts_equal_windows(spark):
    df = spark.range(2000).select(
        F.timestamp_seconds(F.col("id") * 17 % 20_000).alias("ts"), (F.col("id") % 3).cast("string").alias("k")
    )
    ours = {tuple(r) for r in T.sliding_counts(df, ["k"], 10, 2).collect()}
    w = df.groupBy("k", F.window("ts", "10 minutes", "2 minutes").alias("w")).count()
    assert ours == {tuple(r) for r in w.select("k", "w.start", "w.end", "count").collect()}


CONFIG = {
    "applications": [
        {"name": "spark1", "alertRules": [{"query": "q1", "retryInterval": 10, "resultThreshold": 0, "alertProfiles": ["email"]}],
         "emailProfiles": [{"name": "email", "addresses": ["x@example.com", "y@example.com"]}]},
        {"name": "spark2", "alertRules": [
            {"query": "q2", "retryInterval": 10, "alertProfiles": ["slack"], "alertType": "solr"},
            {"query": "q3", "retryInterval": 10, "alertProfiles": ["slack"], "alertType": "sql"}],
         "slackProfiles": [{"name": "slack", "url": "http://chat"}]},
        {"name": "spark3", "alertRules": [{"query": "q4", "retryInterval": 10, "alertProfiles": ["unused"]}]},
    ]
}


@pytest.fixture(scope="module")
def fired(spark):
    apps = C.parse_applications(CONFIG)
    documents = F.array(F.create_map(*[F.lit(x) for x in (
        "id", "123", "category", "test", "timestamp", "2018-04-06 10:15:00", "level", "FATAL", "message",
        'The "service" is down.', "threadName", "thread3")]))
    return C.rules_frame(spark, apps).withColumns({"total_num_found": F.lit(20).cast("bigint"), "documents": documents})


def test_routing(spark, fired):
    apps = C.parse_applications(CONFIG)
    mail, posts, lost = notifications(fired, apps)
    assert [(r["application"], r["targets"]) for r in mail.collect()] == [("spark1", ["x@example.com", "y@example.com"])]
    assert [(r["application"], r["url"]) for r in posts.collect()] == [("spark2", "http://chat")] * 2
    assert [r["application"] for r in lost.collect()] == ["spark3"]
    groups = {(r["application"], r["profile"]): r["alerts"] for r in R.group_alerts(fired).collect()}
    assert groups == {("spark1", "email"): 1, ("spark2", "slack"): 2, ("spark3", "unused"): 1}


def test_notification_text(fired):
    row = fired.filter("application = 'spark1'").select(
        R.alert_subject(brand="Ops").alias("subject"), R.alert_body(brand="Ops").alias("body")
    ).first()
    assert row["subject"] == "Ops alert triggered for 'spark1'"
    assert row["body"].split("\n") == [
        "  'spark1' Application triggered a Ops alert.", "", "  Application Name: spark1", "  Query: q1",
        "  Displaying 1 results of 20 total found:", "", "  ", "      ID: 123", "      Category: test",
        "      Timestamp: 2018-04-06 10:15:00", "      Level: FATAL", '      Message: The "service" is down.',
        "      Thread Name: thread3", "      Throwable: ",
    ]


def test_chat_payload_is_json(spark, fired):
    import json

    post = R.slack_notifications(fired, C.profiles_frame(spark, C.parse_applications(CONFIG))).first()
    text = json.loads(post["payload"])["text"]
    assert text.startswith("Log alert triggered for 'spark2'") and text.endswith("-" * 45) and '"service"' in text


def test_config_types(spark):
    rules = C.rules_frame(spark, C.parse_applications(CONFIG))
    assert {r["query"] for r in C.rules_of_type(rules, "solr").collect()} == {"q1", "q2", "q4"}
    assert {r["alert_type"] for r in C.distinct_alert_types(rules).collect()} == {"solr", "sql"}
    assert C.unknown_alert_types(rules).isEmpty()
    bad = {"applications": [{"name": "a", "alertRules": [{**CONFIG["applications"][0]["alertRules"][0], "alertType": "blarg"}]}]}
    with pytest.raises(ValueError):
        C.parse_applications(bad)


def test_config_file(tmp_path):
    import json

    (tmp_path / "alerts.json").write_text(json.dumps(CONFIG))
    assert C.parse_applications(C.read_config(str(tmp_path / "alerts.json"))) == C.parse_applications(CONFIG)


def test_profiles_required(spark):
    apps = C.parse_applications(CONFIG)
    rules, profiles = C.rules_frame(spark, apps), C.profiles_frame(spark, apps)
    with pytest.raises(ValueError, match="spark3"):
        C.validate_profiles(rules, profiles)
    C.validate_profiles(rules.filter("application <> 'spark3'"), profiles)


def test_silenced(spark, tmp_path):
    (tmp_path / "silenced.txt").write_text("spark3\n\n spark9 \n")
    silenced = C.read_silenced(spark, str(tmp_path / "silenced.txt"))
    apps = C.rules_frame(spark, C.parse_applications(CONFIG)).select("application").distinct()
    assert {r["application"] for r in R.drop_silenced(apps, silenced).collect()} == {"spark1", "spark2"}
    assert C.read_silenced(spark, str(tmp_path / "nothing.txt")).count() == 0
    assert [a.name for a in active_applications(C.parse_applications(CONFIG), ["spark2"])] == ["spark1", "spark3"]


def test_configuration_is_a_local_relation(spark):
    """Its exact size is known, so a broadcast of it is one of checked size."""
    plan = C.rules_frame(spark, C.parse_applications(CONFIG))._jdf.queryExecution().executedPlan().toString()
    assert "LocalTableScan" in plan
