"""Rules, thresholds, suppression, routing and notifications."""

from __future__ import annotations

from datetime import datetime, timedelta, timezone

from pyspark.sql import functions as F

from loglake.frames import shared_dir
from loglake.functions import predicates as P
from loglake.operators import rollup as U
from loglake.operators import routing as R
from loglake.operators import rules as J
from loglake.operators import suppression as W
from loglake.operators import windows as T
from loglake.plans.alerting import triggered_alerts, who_is_told
from loglake.registry.base import LOGS, NOW, ORACLES, SQL_NOW, logs, query, table
from loglake.schema import RULES
from loglake.sinks.logs import write_alert_history
from loglake.sources import config as C
from loglake.sources.stored import read_sql_rule

ERRORS = "level = 'ERROR'"
A_DAY = 24 * 60


def shipped_style(names: list[str] | None = None) -> list[C.Application]:
    """The rule of the shipped configuration for every application: any ERROR in the look-back alerts."""
    rule = C.AlertRule(ERRORS, 10, ("ops",), 0, lookback=A_DAY)
    return [
        C.Application(n, (rule,), (("ops", (f"{n}@example.com", "duty@example.com")),), (("ops", f"http://chat/{n}"),))
        for n in names or [f"app-{i}" for i in range(5)]
    ]


def many_rules(n: int) -> list[C.Application]:
    """``n`` distinct conditions spread over the five applications, alternating rule shapes."""
    apps: dict[str, list[C.AlertRule]] = {f"app-{i}": [] for i in range(5)}
    for i in range(n):
        hour = i % 24
        text = (
            f"level = 'ERROR' AND threadName = 'thread-{i % 8}' AND hour(ts) = {hour}",
            f"category = 'events.purchase' AND hostname = 'host{i % 10}' AND hour(ts) >= {hour}",
            f"level = 'WARN' AND try_cast(fields['k_i'] AS INT) BETWEEN {i % 50} AND {i % 50 + 20}",
        )[i % 3]
        apps[f"app-{i % 5}"].append(C.AlertRule(f"{text} AND version >= {i}", 10, ("ops",), i % 7))
    return [C.Application(name, tuple(rules)) for name, rules in apps.items()]


# Rules with a short name as query text, so that results can be matched by name.
def named_rules() -> list[C.Application]:
    def rule(name, predicate, threshold=None, profiles=("ops",), retry=10):
        return C.AlertRule(name, retry, profiles, threshold, predicate=predicate)

    today = lambda now: P.time_range("ts", "NOW-24HOURS", "NOW", now)
    errors = lambda now: P.term("level", "ERROR") & today(now)
    purchases = lambda now: P.match("message", "purchase") & P.time_range("ts", "NOW-7DAYS", "NOW", now)
    fatal = lambda now: P.term("level", "FATAL")
    rules = (
        rule("errors", errors, 0, ("ops", "chat")),
        rule("many-errors", errors, 1000),
        rule("purchases", purchases, 10, ("chat",)),
        rule("no-fatal", fatal, -1, ("nobody",)),
        rule("some-error", errors, -1),
    )
    return [
        C.Application(f"app-{i}", rules, (("ops", (f"app-{i}@example.com",)),), (("chat", f"http://chat/{i}"),))
        for i in range(5)
    ]


NAMED = f"""{LOGS}, rules(query, threshold, profiles) AS (VALUES
    ('errors', 0, ['ops', 'chat']), ('many-errors', 1000, ['ops']), ('purchases', 10, ['chat']),
    ('no-fatal', -1, ['nobody']), ('some-error', -1, ['ops'])),
  apps AS (SELECT DISTINCT application FROM logs),
  hits AS (
    SELECT application, r.query, id, ts, level, message FROM logs, rules r WHERE CASE r.query
      WHEN 'purchases' THEN contains(' ' || message, ' purchase ') AND ts BETWEEN {SQL_NOW} - INTERVAL 7 DAY AND {SQL_NOW}
      WHEN 'no-fatal' THEN level = 'FATAL'
      ELSE level = 'ERROR' AND ts BETWEEN {SQL_NOW} - INTERVAL 24 HOUR AND {SQL_NOW} END),
  counted AS (
    SELECT a.application, r.query, r.threshold, r.profiles, count(h.id) AS total
    FROM apps a CROSS JOIN rules r LEFT JOIN hits h ON h.application = a.application AND h.query = r.query
    GROUP BY ALL),
  fired AS (SELECT * FROM counted WHERE CASE WHEN threshold = -1 THEN total = 0 ELSE total > threshold END)"""


@query("j01_evaluate_rules", f"WITH {NAMED} SELECT application, query, total AS total_num_found FROM counted")
def evaluate_rules(spark, sf):
    return J.evaluate_rules(logs(spark, sf), named_rules(), NOW).select("application", "query", "total_num_found")


def _shape(i: int) -> str:
    hour = i % 24
    return (
        f"""level = 'ERROR' AND "threadName" = 'thread-{i % 8}' AND hour(ts) = {hour}""",
        f"category = 'events.purchase' AND hostname = 'host{i % 10}' AND hour(ts) >= {hour}",
        f"level = 'WARN' AND CAST(k AS INT) BETWEEN {i % 50} AND {i % 50 + 20}",
    )[i % 3] + f" AND version >= {i} AND application = 'app-{i % 5}'"


def _many_hits(n: int) -> str:
    cases = ", ".join(f"CASE WHEN {_shape(i)} THEN {i} END" for i in range(n))
    return f"""{LOGS}, many AS (SELECT application, id, ts,
                 unnest(list_filter([{cases}], lambda x: x IS NOT NULL)) AS rule FROM logs)"""


def _many_sql(n: int) -> str:
    return f"""WITH {_many_hits(n)}, c AS (SELECT rule, count(*) AS n FROM many GROUP BY rule),
                 r AS (SELECT 'app-' || (i % 5) AS application, CAST(i % 7 AS INT) AS result_threshold, coalesce(n, 0) AS n
                       FROM range({n}) AS t(i) LEFT JOIN c ON c.rule = i)
               SELECT application, result_threshold, count(*) AS rules, CAST(sum(n) AS BIGINT) AS total,
               count(*) FILTER (n > result_threshold) AS firing FROM r GROUP BY ALL"""


def _many(n: int):
    def run(spark, sf):
        found = J.evaluate_rules(logs(spark, sf), many_rules(n), NOW)
        return found.groupBy("application", "result_threshold").agg(
            F.count("*").alias("rules"), F.sum("total_num_found").alias("total"),
            F.count_if(F.col("total_num_found") > F.col("result_threshold")).alias("firing"),
        )

    return run


for _n in (1, 10, 100, 2000):
    query(f"j01_{_n}_rules", _many_sql(_n))(_many(_n))


@query(
    "a01_rule_counts",
    f"""WITH {LOGS} SELECT application, CAST(0 AS INT) AS condition, count(*) AS total_num_found FROM logs
        WHERE level = 'ERROR' GROUP BY application""",
)
def rule_counts(spark, sf):
    df = logs(spark, sf)
    return J.rule_counts(J.condition_hits(df, J.index_conditions(df, error_rule()), "application"))


@query(
    "a02_rule_documents",
    f"""WITH {NAMED}, ranked AS (SELECT *, row_number() OVER (PARTITION BY application, query ORDER BY ts DESC, id) AS r
          FROM hits)
        SELECT application, query, count(*) AS n, string_agg(id, ',' ORDER BY r) AS ids FROM ranked WHERE r <= 10
        GROUP BY application, query""",
)
def rule_documents(spark, sf):
    apps = named_rules()
    names = C.rules_frame(spark, apps).select("application", "rule_id", "query")
    docs = J.rule_documents(logs(spark, sf), apps, NOW, ["id"]).join(names, ["application", "rule_id"])
    ids = F.array_join(F.transform("documents", lambda d: d["id"]), ",")
    return docs.select("application", "query", F.size("documents").cast("bigint").alias("n"), ids.alias("ids"))


def _many_documents_sql(n: int) -> str:
    return f"""WITH {_many_hits(n)}, r AS (SELECT application, rule, row_number() OVER
                 (PARTITION BY application, rule ORDER BY ts DESC, id) AS r FROM many)
               SELECT application, count(DISTINCT rule) AS rules, count(*) AS documents FROM r WHERE r <= 10
               GROUP BY application"""


@query("a02_2000_rules", _many_documents_sql(2000))
def many_rule_documents(spark, sf):
    docs = J.rule_documents(logs(spark, sf), many_rules(2000), NOW, ["id"])
    return docs.groupBy("application").agg(
        F.count("*").alias("rules"), F.sum(F.size("documents")).alias("documents")
    )


@query(
    "l01_cap_documents",
    f"""WITH {LOGS} SELECT application, id, row_number() OVER (PARTITION BY application ORDER BY ts DESC, id) AS rank
        FROM logs WHERE level = 'ERROR' QUALIFY rank <= 10""",
)
def cap_documents(spark, sf):
    df = logs(spark, sf)
    hits = J.condition_hits(df, J.index_conditions(df, error_rule()), "application", "id", "ts")
    return J.cap_documents(hits).select("application", "id", F.col("rank").cast("bigint").alias("rank"))


@query(
    "f11_exceeds_threshold",
    f"""WITH {LOGS}, c AS (SELECT user_id, CAST(CASE user_id % 4 WHEN 0 THEN -1 WHEN 1 THEN 0 WHEN 2 THEN 12 END AS INT)
          AS threshold, count(*) FILTER (level = 'ERROR' AND user_id % 8 <> 0) AS n FROM logs GROUP BY user_id)
        SELECT user_id, n, CASE WHEN threshold = -1 THEN n = 0 ELSE n > coalesce(threshold, 0) END AS fires,
               (coalesce(threshold, 0) = -1 AND n = 0) OR n > coalesce(threshold, 0) AS strict FROM c""",
)
def exceeds_threshold(spark, sf):
    user = F.col("user_id")
    df = table(spark, sf, "events").groupBy("user_id").agg(
        F.count_if((F.col("event_type") == "error") & (user % 8 != 0)).alias("n")
    )
    threshold = F.when(user % 4 == 0, -1).when(user % 4 == 1, 0).when(user % 4 == 2, 12)
    return df.select(
        "user_id", "n", P.exceeds_threshold(F.col("n"), threshold).alias("fires"),
        P.exceeds_threshold(F.col("n"), threshold, strict_reference=True).alias("strict"),
    )


# One suppression entry per user: last error, wait of 0 to 14 days in minutes.
STATE = f"""{LOGS}, state AS (SELECT application, 'user-' || user_id AS rule_id, CAST(user_id % 15 * 1440 AS INT)
  AS retry_interval, max(ts) - to_days(CAST(user_id % 6 AS INTEGER)) AS last_triggered FROM logs WHERE level = 'ERROR'
  GROUP BY application, user_id)"""
WAITING = "CAST(floor((epoch_us({now}) - epoch_us(last_triggered)) / 60000000.0) AS BIGINT) <= retry_interval"


def state(spark, sf):
    user = F.col("user_id")
    errors = table(spark, sf, "events").filter("event_type = 'error'").groupBy("user_id").agg(
        F.max(F.col("ts").cast("timestamp")).alias("newest")
    )
    return errors.select(
        F.concat(F.lit("app-"), (user % 5).cast("string")).alias("application"),
        F.concat(F.lit("user-"), user.cast("string")).alias("rule_id"),
        (user % 15 * 1440).cast("int").alias("retry_interval"),
        (F.col("newest") - F.make_dt_interval(days=(user % 6).cast("int"))).alias("last_triggered"),
    )


@query(
    "f12_inside_wait_period",
    f"WITH {STATE} SELECT application, rule_id, {WAITING.format(now=SQL_NOW)} AS waiting FROM state",
)
def inside_wait_period(spark, sf):
    now = F.lit(NOW).cast("timestamp")
    waiting = P.inside_wait_period(F.col("last_triggered"), now, F.col("retry_interval"))
    return state(spark, sf).select("application", "rule_id", waiting.alias("waiting"))


@query(
    "f19_active_suppressions",
    f"""WITH {STATE} SELECT application, rule_id, epoch_us(last_triggered) AS last_us FROM state
        WHERE {WAITING.format(now=SQL_NOW)}""",
)
def active_suppressions(spark, sf):
    kept = W.active_suppressions(state(spark, sf), NOW)
    return kept.select("application", "rule_id", F.unix_micros("last_triggered").alias("last_us"))


@query(
    "k10_mark_triggered",
    f"""WITH {STATE}, fired AS (SELECT application, 'user-' || user_id AS rule_id, max(ts) AS t FROM logs
          WHERE level = 'WARN' GROUP BY ALL)
        SELECT application, rule_id, epoch_us(coalesce(t, last_triggered)) AS last_us
        FROM state FULL JOIN fired USING (application, rule_id)""",
)
def mark_triggered(spark, sf):
    user = F.col("user_id")
    fired = table(spark, sf, "events").filter("event_type = 'purchase'").select(
        F.concat(F.lit("app-"), (user % 5).cast("string")).alias("application"),
        F.concat(F.lit("user-"), user.cast("string")).alias("rule_id"),
        F.lit(10).alias("retry_interval"),
        F.col("ts").cast("timestamp").alias("eval_ts"),
    )
    marked = W.mark_triggered(state(spark, sf), fired)
    return marked.select("application", "rule_id", F.unix_micros("last_triggered").alias("last_us"))


def error_rule(threshold: int | None = 0, retry: int = 10) -> list[C.Application]:
    rule = C.AlertRule("level = 'ERROR'", retry, ("ops",), threshold)
    return [C.Application(f"app-{i}", (rule,)) for i in range(5)]


# Evaluation ticks, one a minute, that see at least one ERROR in the ten minutes before them.
TICKS = f"""{LOGS}, panes AS (
    SELECT application, CAST(floor(epoch(ts) / 60) AS BIGINT) AS pane, count(*) AS n FROM logs WHERE level = 'ERROR'
    GROUP BY ALL),
  ticks AS (SELECT application, pane + b AS tick, CAST(sum(n) AS BIGINT) AS n FROM panes, range(1, 11) AS r(b) GROUP BY ALL)"""


def greedy_sql(ticks: str, wait: int) -> str:
    """The ticks sent: the first one, then always the first more than ``wait`` minutes after the one before."""
    return f"""following AS MATERIALIZED (
          SELECT t.application, t.tick, n.tick AS next FROM {ticks} t
          ASOF JOIN {ticks} n ON t.application = n.application AND t.tick + {wait} < n.tick),
        sent AS (
          SELECT application, min(tick) AS tick FROM {ticks} GROUP BY application
          UNION ALL SELECT application, next FROM sent JOIN following USING (application, tick))"""


@query(
    "rule_sweep",
    f"WITH {TICKS} SELECT application, tick * 60 AS eval_epoch, n AS total_num_found FROM ticks",
)
def rule_sweep(spark, sf):
    found = T.rule_counts_by_tick(logs(spark, sf), error_rule(), 10)
    return found.select("application", F.unix_seconds("eval_ts").alias("eval_epoch"), "total_num_found")


@query(
    "w03_suppress_repeats",
    f"""WITH RECURSIVE {TICKS}, {greedy_sql('ticks', 10)}
        SELECT application, tick * 60 AS eval_epoch FROM sent""",
)
def suppress_ticks(spark, sf):
    firings = J.triggered(T.rule_counts_by_tick(logs(spark, sf), error_rule(), 10))
    sent = W.suppress_repeats(firings)
    return sent.select("application", F.unix_seconds("eval_ts").alias("eval_epoch"))


# The last alert of every application was sent at 06:05 of the second day, amid its firings.
HISTORY_TICK = 28_402_925


@query(
    "w03_suppress_with_history",
    f"""WITH RECURSIVE {TICKS}, later AS (SELECT * FROM ticks WHERE tick > {HISTORY_TICK} + 10), {greedy_sql('later', 10)}
        SELECT application, tick * 60 AS eval_epoch FROM sent""",
)
def suppress_with_history(spark, sf):
    firings = J.triggered(T.rule_counts_by_tick(logs(spark, sf), error_rule(), 10))
    since = F.timestamp_seconds(F.lit(HISTORY_TICK * 60))
    firings = firings.filter(F.col("eval_ts") > since)
    history = C.rules_frame(spark, error_rule()).select("application", "rule_id", since.alias("last_triggered"))
    return W.suppress_repeats(firings, history).select("application", F.unix_seconds("eval_ts").alias("eval_epoch"))


@query(
    "t03_lookback_per_rule",
    f"""WITH {LOGS}, panes AS (SELECT application, CAST(floor(epoch(ts) / 60) AS BIGINT) AS pane, count(*) AS n
          FROM logs WHERE level = 'ERROR' GROUP BY ALL)
        SELECT application, w AS minutes, (pane + b) * 60 AS eval_epoch, CAST(sum(n) AS BIGINT) AS total_num_found
        FROM panes, (SELECT unnest([1, 10, 60]) AS w), range(1, 61) AS r(b) WHERE b <= w GROUP BY ALL""",
)
def lookback_per_rule(spark, sf):
    rules = tuple(C.AlertRule("level = 'ERROR'", 10, ("ops",), 0, lookback=m) for m in (1, 10, 60))
    apps = [C.Application(f"app-{i}", rules) for i in range(5)]
    minutes = F.create_map(*[F.lit(x) for r in rules for x in (r.rule_id, r.lookback)])
    found = T.rule_counts_by_tick(logs(spark, sf), apps)
    return found.select(
        "application", minutes[F.col("rule_id")].alias("minutes"), F.unix_seconds("eval_ts").alias("eval_epoch"),
        "total_num_found",
    )


@query("t03_rollup_counts", ORACLES["t03_lookback_per_rule"])
def rollup_counts(spark, sf):
    """Counts per minute, stored in two batches with a replay of the first, summed over each rule's look-back."""
    rules = tuple(C.AlertRule("level = 'ERROR'", 10, ("ops",), 0, lookback=m) for m in (1, 10, 60))
    apps = [C.Application(f"app-{i}", rules) for i in range(5)]
    minutes = F.create_map(*[F.lit(x) for r in rules for x in (r.rule_id, r.lookback)])
    path, rows = shared_dir(spark, "rollup"), logs(spark, sf).withColumn("collection", F.concat("application", F.lit("_0")))
    U.cover(spark, path, None, apps)
    for batch in (0, 1, 0):
        U.write_rollup(rows.filter(F.abs(F.hash("id")) % 2 == batch), apps, path, batch)
    found = U.rollup_by_tick(U.read_rollup(spark, path), apps)
    return found.select(
        "application", minutes[F.col("rule_id")].alias("minutes"), F.unix_seconds("eval_ts").alias("eval_epoch"),
        "total_num_found",
    )


@query(
    "t03_rollup_round",
    f"""WITH {LOGS}, r(application, minutes) AS (SELECT 'app-' || a, m FROM range(5) AS x(a), (SELECT unnest([30, 1440, NULL]) AS m))
        SELECT r.application, r.minutes, count(l.id) AS total_num_found FROM r LEFT JOIN logs l
          ON l.application = r.application AND l.level = 'ERROR' AND l.ts < {SQL_NOW}
         AND (r.minutes IS NULL OR l.ts >= {SQL_NOW} - to_minutes(CAST(r.minutes AS INTEGER))) GROUP BY ALL""",
)
def rollup_round(spark, sf):
    rules = tuple(C.AlertRule("level = 'ERROR'", 10, ("ops",), 0, lookback=m) for m in (30, A_DAY, None))
    apps = [C.Application(f"app-{i}", rules) for i in range(5)]
    minutes = F.create_map(*[F.lit(x) for r in rules[:2] for x in (r.rule_id, r.lookback)])
    path, rows = shared_dir(spark, "rollup"), logs(spark, sf).withColumn("collection", F.concat("application", F.lit("_0")))
    U.cover(spark, path, rows, apps)
    found = U.evaluate_rollup(U.read_rollup(spark, path), apps, NOW)
    return found.select("application", F.try_element_at(minutes, F.col("rule_id")).alias("minutes"), "total_num_found")


@query(
    "w03_suppress_event_ticks",
    f"""WITH RECURSIVE {LOGS}, e AS (SELECT DISTINCT application, CAST(floor(epoch(ts) / 60) AS BIGINT) + 1 AS tick
          FROM logs WHERE level = 'ERROR'), {greedy_sql('e', 600)}
        SELECT application, tick * 60 AS eval_epoch FROM sent""",
)
def suppress_event_ticks(spark, sf):
    firings = logs(spark, sf).filter("level = 'ERROR'").select(
        "application", F.lit("errors").alias("rule_id"), F.lit(600).alias("retry_interval"),
        T.evaluation_tick("ts").alias("eval_ts"),
    )
    return W.suppress_repeats(firings).select("application", F.unix_seconds("eval_ts").alias("eval_epoch"))


SPINE_START = datetime(2024, 1, 1, tzinfo=timezone.utc)


@query(
    "t04_absence",
    f"""WITH {TICKS}, spine AS (SELECT application, epoch(TIMESTAMP '2024-01-01')::BIGINT // 60 + 5 * i AS tick
          FROM (SELECT DISTINCT application FROM logs), range(0, 288 * 30 + 1) AS r(i))
        SELECT application, tick * 60 AS eval_epoch FROM spine s
        WHERE NOT EXISTS (SELECT 1 FROM ticks t WHERE t.application = s.application AND t.tick = s.tick)""",
)
def absence(spark, sf):
    apps = error_rule(-1)
    found = T.rule_counts_by_tick(logs(spark, sf), apps, 10)
    rules = C.rules_frame(spark, apps)
    silent = T.absence(found, rules, SPINE_START, SPINE_START + timedelta(days=30), 5)
    return silent.select("application", F.unix_seconds("eval_ts").alias("eval_epoch"))


@query(
    "t03_sliding_counts",
    f"""WITH {LOGS}, panes AS (SELECT application, level, CAST(floor(epoch(ts) / 60) AS BIGINT) AS pane FROM logs)
        SELECT application, level, (pane - b) * 60 AS start_epoch, count(*) AS n
        FROM panes, range(0, 10) AS r(b) GROUP BY ALL""",
)
def sliding_counts(spark, sf):
    counted = T.sliding_counts(logs(spark, sf), ["application", "level"])
    return counted.select("application", "level", F.unix_seconds("start").alias("start_epoch"), "n")


@query(
    "w04_micro_batches",
    f"""WITH {LOGS}, b AS (
          SELECT application, CAST(floor(epoch(ts) / 3600) AS BIGINT) * 3600 AS batch_second, id,
                 row_number() OVER (PARTITION BY application, floor(epoch(ts) / 3600)
                                    ORDER BY epoch_us(ts) % 3600000000 // 3600000, md5(id)) AS r FROM logs)
        SELECT application, batch_second, id, CAST(floor((r - 1) / 3) AS BIGINT) AS batch_no FROM b""",
)
def micro_batches(spark, sf):
    out = T.micro_batches(logs(spark, sf), seconds=3600, size=3)
    return out.select("application", "batch_second", "id", "batch_no")


@query("j01_triggered", f"WITH {NAMED} SELECT application, query, total AS total_num_found FROM fired")
def triggered(spark, sf):
    found = J.triggered(J.evaluate_rules(logs(spark, sf), named_rules(), NOW))
    return found.select("application", "query", "total_num_found")


def alerts(spark, sf):
    return J.triggered(J.evaluate_rules(logs(spark, sf), named_rules(), NOW))


PROFILES = f"""{NAMED}, profiles AS (
    SELECT application, 'mail' AS channel, 'ops' AS profile, application || '@example.com' AS target FROM apps
    UNION ALL SELECT application, 'slack', 'chat', 'http://chat/' || substr(application, 5) FROM apps),
  by_profile AS (SELECT application, query, total, unnest(profiles) AS profile FROM fired)"""


@query(
    "a03_group_alerts",
    f"WITH {PROFILES} SELECT application, profile, count(*) AS alerts FROM by_profile GROUP BY ALL",
)
def group_alerts(spark, sf):
    grouped = R.group_alerts(alerts(spark, sf))
    return grouped.select("application", "profile", "alerts")


@query(
    "j02_route_alerts",
    f"""WITH {PROFILES} SELECT application, profile, query, channel, target FROM by_profile
        JOIN profiles USING (application, profile)""",
)
def route_alerts(spark, sf):
    routed = R.route_alerts(alerts(spark, sf), C.profiles_frame(spark, named_rules()))
    return routed.select("application", "profile", "query", "channel", F.array_join("targets", ",").alias("target"))


@query(
    "j03_unroutable_alerts",
    f"""WITH {PROFILES} SELECT application, profile, query FROM by_profile
        ANTI JOIN profiles USING (application, profile)""",
)
def unroutable_alerts(spark, sf):
    lost = R.unroutable_alerts(alerts(spark, sf), C.profiles_frame(spark, named_rules()))
    return lost.select("application", "profile", "query")


@query(
    "who_is_told",
    f"""WITH {LOGS}, c AS (SELECT application, count(*) AS total_num_found FROM logs WHERE level = 'ERROR'
          AND ts BETWEEN {SQL_NOW} - INTERVAL 24 HOUR AND {SQL_NOW} GROUP BY application)
        SELECT application, total_num_found, 'ops' AS profile, 'mail' AS channel,
               application || '@example.com,duty@example.com' AS targets FROM c
        UNION ALL SELECT application, total_num_found, 'ops', 'slack', 'http://chat/' || application FROM c""",
)
def told(spark, sf):
    """Flagship: which applications logged ERROR in the last 24 hours, above threshold, and who is told."""
    out = who_is_told(logs(spark, sf), shipped_style(), NOW)
    return out.withColumn("targets", F.array_join("targets", ",")).drop("rule_id")


@query(
    "j04_drop_silenced",
    f"""WITH {LOGS} SELECT DISTINCT application FROM logs WHERE application NOT IN
        (SELECT application FROM logs GROUP BY application HAVING count(*) FILTER (level = 'ERROR') % 2 = 0)""",
)
def drop_silenced(spark, sf):
    df = logs(spark, sf)
    errors = df.groupBy("application").agg(F.count_if(F.col("level") == "ERROR").alias("errors"))
    path = shared_dir(spark, "silenced")
    errors.filter("errors % 2 = 0").select("application").write.mode("overwrite").text(path)
    return R.drop_silenced(errors.select("application"), C.read_silenced(spark, path))


@query(
    "s09_read_silenced",
    "SELECT c_name AS application FROM customer WHERE c_acctbal < 0",
)
def read_silenced(spark, sf):
    path = shared_dir(spark, "silenced")
    negative = table(spark, sf, "customer").filter("c_acctbal < 0")
    # Stray blanks and empty lines are not names.
    negative.select(F.concat("c_name", F.lit(" \n"))).write.mode("overwrite").text(path)
    return C.read_silenced(spark, path)


@query(
    "s07_read_sql_rule",
    """SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders WHERE o_orderpriority = '1-URGENT'
       ORDER BY o_totalprice DESC, o_orderkey LIMIT 10""",
)
def sql_rule(spark, sf):
    table(spark, sf, "orders").createOrReplaceTempView("orders")
    text = """SELECT o_orderkey AS O_ORDERKEY, o_orderstatus, o_totalprice FROM orders
              WHERE o_orderpriority = '1-URGENT' ORDER BY o_totalprice DESC, o_orderkey"""
    return read_sql_rule(spark, text)


@query(
    "s07_sql_rule_alerts",
    """WITH r(application, threshold) AS (VALUES ('shop-F', 0), ('shop-O', 1000000), ('shop-P', 10)),
       c AS (SELECT r.*, count(*) AS n FROM orders JOIN r ON r.application = 'shop-' || o_orderstatus
             WHERE o_totalprice > 100000 GROUP BY ALL)
       SELECT application, n AS total_num_found, 10 AS documents FROM c WHERE n > threshold""",
)
def sql_rule_alerts(spark, sf):
    table(spark, sf, "orders").createOrReplaceTempView("orders")
    text = "SELECT * FROM orders WHERE o_totalprice > 100000 AND o_orderstatus = '{}' AND :eval_ts IS NOT NULL"
    thresholds = {"F": 0, "O": 1_000_000, "P": 10}
    apps = [C.Application(f"shop-{s}", (C.AlertRule(text.format(s), 10, ("ops",), t, "sql"),)) for s, t in thresholds.items()]
    fired = J.triggered(J.evaluate_sql_rules(spark, apps, NOW))
    return fired.select("application", "total_num_found", F.size("documents").alias("documents"))


BODY = """'  ''' || application || ''' Application triggered a Log alert.' || chr(10) || chr(10) ||
  '  Application Name: ' || application || chr(10) || '  Query: ' || query || chr(10) ||
  '  Displaying ' || n_docs || ' results of ' || total || ' total found:' || chr(10) || chr(10) || '  ' || docs"""
DOC = """chr(10) || '      ID: ' || id || chr(10) || '      Category: ' || chr(10) || '      Timestamp: ' || chr(10) ||
  '      Level: ' || level || chr(10) || '      Message: ' || message || chr(10) || '      Thread Name: ' || chr(10) ||
  '      Throwable: '"""
TEXTS = f"""{PROFILES}, ranked AS (SELECT *, row_number() OVER (PARTITION BY application, query ORDER BY ts DESC, id) AS r
      FROM hits),
  docs AS (SELECT application, query, count(*) AS n_docs, string_agg({DOC}, chr(10) ORDER BY r) AS docs FROM ranked
           WHERE r <= 10 GROUP BY ALL),
  texts AS (SELECT b.application, b.query, b.profile, 'Log alert triggered for ''' || b.application || '''' AS subject,
              {BODY} AS body
            FROM (SELECT b.*, coalesce(n_docs, 0) AS n_docs, coalesce(docs, '') AS docs
                  FROM by_profile b LEFT JOIN docs USING (application, query)) b)"""


def full_alerts(spark, sf):
    return triggered_alerts(logs(spark, sf), named_rules(), NOW, fields=["id", "level", "message"])


@query("p12_alert_subject", f"WITH {TEXTS} SELECT DISTINCT application, query, subject FROM texts")
def alert_subject(spark, sf):
    return alerts(spark, sf).select("application", "query", R.alert_subject().alias("subject"))


@query("p13_alert_body", f"WITH {TEXTS} SELECT DISTINCT application, query, body FROM texts")
def alert_body(spark, sf):
    return full_alerts(spark, sf).select("application", "query", R.alert_body().alias("body"))


@query(
    "k06_mail_notifications",
    f"""WITH {TEXTS} SELECT application, profile, target, subject, body FROM texts
        JOIN profiles USING (application, profile) WHERE channel = 'mail'""",
)
def mail_notifications(spark, sf):
    mails = R.mail_notifications(full_alerts(spark, sf), C.profiles_frame(spark, named_rules()))
    return mails.select("application", "profile", F.array_join("targets", ",").alias("target"), "subject", "body")


@query(
    "k07_slack_notifications",
    f"""WITH {TEXTS} SELECT application, profile, target AS url, subject || body || chr(10) || repeat('-', 45) AS text
        FROM texts JOIN profiles USING (application, profile) WHERE channel = 'slack'""",
)
def slack_notifications(spark, sf):
    posts = R.slack_notifications(full_alerts(spark, sf), C.profiles_frame(spark, named_rules()))
    return posts.select("application", "profile", "url", F.get_json_object("payload", "$.text").alias("text"))


@query(
    "k08_alert_history",
    f"""WITH {NAMED} SELECT application, query, total AS total_num_found, epoch({SQL_NOW})::BIGINT AS eval_epoch,
        CASE WHEN query = 'errors' THEN 'first' ELSE 'second' END AS round FROM fired""",
)
def alert_history(spark, sf):
    """Two rounds of one instant both stay; the second is replayed and leaves one copy."""
    path = shared_dir(spark, "alerts")
    found = alerts(spark, sf)
    write_alert_history(found.filter("query = 'errors'"), path, "first")
    write_alert_history(found.filter("query <> 'errors'"), path, "second")
    write_alert_history(found.filter("query <> 'errors'"), path, "second")
    return spark.read.parquet(path).select(
        "application", "query", "total_num_found", F.col("eval_epoch").cast("bigint").alias("eval_epoch"), "round"
    )


@query(
    "j01_not_waiting",
    f"""WITH {NAMED}, history AS (SELECT application, max(ts) AS t FROM logs WHERE level = 'ERROR' GROUP BY application)
        SELECT application, query, total AS total_num_found FROM fired JOIN history USING (application)
        WHERE NOT (query = 'errors' AND (epoch_us({SQL_NOW}) - epoch_us(t)) // 60000000 <= 10)""",
)
def not_waiting(spark, sf):
    errors = C.rules_frame(spark, named_rules()).filter("query = 'errors'").select("application", "rule_id")
    last = logs(spark, sf).filter("level = 'ERROR'").groupBy("application").agg(F.max("ts").alias("last_triggered"))
    rest = W.not_waiting(alerts(spark, sf), errors.join(last, "application"))
    return rest.select("application", "query", "total_num_found")


# Configuration kept as a table: one document per customer, with a rule, maybe a mail and maybe a chat profile.
def configs(spark, sf):
    rule = F.struct(
        F.col("c_name").alias("rule_id"),
        F.concat(F.lit("o_custkey = "), F.col("c_custkey").cast("string")).alias("query"),
        (F.col("c_custkey") % 60).cast("int").alias("retry_interval"),
        F.when(F.col("c_custkey") % 3 == 0, -1).cast("int").alias("result_threshold"),
        F.array(F.col("c_mktsegment")).alias("alert_profiles"),
        F.when(F.col("c_custkey") % 4 == 1, "solr").when(F.col("c_custkey") % 4 == 2, "sql")
        .when(F.col("c_custkey") % 100 == 3, "blarg").alias("alert_type"),
    )
    mail = F.struct(F.col("c_name").alias("name"), F.array("c_name", "c_mktsegment").alias("addresses"))
    slack = F.struct(F.col("c_name").alias("name"), F.col("c_mktsegment").alias("url"))
    return table(spark, sf, "customer").select(
        F.concat(F.lit("nation-"), F.col("c_nationkey").cast("string")).alias("application"),
        F.array(rule).alias("rules"),
        F.when(F.col("c_acctbal") >= 5000, F.array(mail)).alias("mail"),
        F.when(F.col("c_acctbal") < 0, F.array(slack)).alias("slack"),
    )


CONFIG_RULES = """rules AS (SELECT 'nation-' || c_nationkey AS application, c_name AS rule_id,
   'o_custkey = ' || c_custkey AS query, CAST(c_custkey % 60 AS INT) AS retry_interval,
   CAST(CASE WHEN c_custkey % 3 = 0 THEN -1 END AS INT) AS result_threshold, c_mktsegment AS profile,
   CASE WHEN c_custkey % 4 = 1 THEN 'solr' WHEN c_custkey % 4 = 2 THEN 'sql' WHEN c_custkey % 100 = 3 THEN 'blarg' END
     AS alert_type FROM customer)"""


def config_rules(spark, sf):
    return C.explode_config(configs(spark, sf))[0].select(*RULES.fieldNames())


@query("s10_rules_frame", f"WITH {CONFIG_RULES} SELECT * FROM rules")
def rules_from_config(spark, sf):
    rules = config_rules(spark, sf)
    return rules.withColumn("profile", F.element_at("alert_profiles", 1)).drop("alert_profiles")


@query(
    "s10_profiles_frame",
    """SELECT 'nation-' || c_nationkey AS application, 'mail' AS channel, c_name AS name, c_name || ',' || c_mktsegment AS targets
       FROM customer WHERE c_acctbal >= 5000
       UNION ALL SELECT 'nation-' || c_nationkey, 'slack', c_name, c_mktsegment FROM customer WHERE c_acctbal < 0""",
)
def profiles_from_config(spark, sf):
    profiles = C.explode_config(configs(spark, sf))[1]
    return profiles.withColumn("targets", F.array_join("targets", ","))


@query("f16_rules_of_type", f"WITH {CONFIG_RULES} SELECT rule_id, 'solr' AS alert_type FROM rules WHERE coalesce(alert_type, 'solr') = 'solr'")
def rules_of_type(spark, sf):
    return C.rules_of_type(config_rules(spark, sf), "solr").select("rule_id", "alert_type")


@query("a04_distinct_alert_types", f"WITH {CONFIG_RULES} SELECT DISTINCT coalesce(alert_type, 'solr') AS alert_type FROM rules")
def distinct_alert_types(spark, sf):
    return C.distinct_alert_types(config_rules(spark, sf))


@query(
    "u03_unknown_alert_types",
    f"WITH {CONFIG_RULES} SELECT alert_type FROM rules WHERE alert_type IS NOT NULL EXCEPT SELECT unnest(['solr', 'sql'])",
)
def unknown_alert_types(spark, sf):
    return C.unknown_alert_types(config_rules(spark, sf))


@query(
    "f17_applications_without_profiles",
    """SELECT DISTINCT c_name AS application FROM customer WHERE c_custkey NOT IN
       (SELECT o_custkey FROM orders WHERE o_totalprice > 400000)""",
)
def applications_without_profiles(spark, sf):
    # Customers as applications, those with a large order as the ones that have a profile.
    customer = table(spark, sf, "customer")
    ordered = table(spark, sf, "orders").filter("o_totalprice > 400000").select(F.col("o_custkey").alias("c_custkey"))
    profiles = customer.join(ordered, "c_custkey", "left_semi").select(F.col("c_name").alias("application"))
    return C.applications_without_profiles(customer.select(F.col("c_name").alias("application")), profiles)
