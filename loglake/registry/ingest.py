"""Ingest and normalisation."""

from __future__ import annotations

from pyspark.sql import functions as F

from loglake.frames import shared_dir
from loglake.functions import events as E
from loglake.functions import timestamps as Tm
from loglake.operators import documents as D
from loglake.plans.ingest import normalise, place
from loglake.registry.base import LOGS, PLACED, POLICIES, collections, logs, query, table
from loglake.sinks.logs import write_logs
from loglake.sinks.wire import WIRE_FIELDS, event_json, export_event_arrays, kafka_messages
from loglake.sources import events as S

ISO = "strftime(ts, '%Y-%m-%dT%H:%M:%SZ')"


def wire_events(spark, sf):
    """Logs in the wire shape: ISO timestamp and a properties map; every seventh row lacks its level."""
    df = logs(spark, sf)
    broken = F.col("version") % 7 == 0
    return df.withColumns(
        {
            "timestamp": Tm.timestamp_to_iso("ts"),
            "level": F.when(~broken, F.col("level")),
            "properties": F.map_concat(
                F.create_map(F.lit("hostname"), F.col("hostname")),
                F.col("fields"),
                # A property named like a core field replaces it.
                F.when(F.col("version") % 5 == 0, F.create_map(F.lit("message"), F.lit("from property")))
                .otherwise(F.create_map().cast("map<string,string>")),
            ),
        }
    )


WIRE = f"""{LOGS}, wire AS (
  SELECT *, {ISO} AS iso, CASE WHEN version % 7 <> 0 THEN level END AS wire_level,
         CASE WHEN version % 5 = 0 THEN 'from property' ELSE message END AS flat_message FROM logs)"""


@query(
    "s01_read_log_events",
    f"""WITH {WIRE} SELECT id, 'app-of-request' AS application, iso AS "timestamp", wire_level AS level, message
        FROM wire""",
)
def read_log_events(spark, sf):
    path = shared_dir(spark, "events-json")
    wire_events(spark, sf).select(F.to_json(F.struct("id", *WIRE_FIELDS[:6], "properties")).alias("value")).write.mode(
        "overwrite"
    ).text(path)
    df = S.read_log_events(spark, path, "app-of-request")
    return df.select("id", "application", "timestamp", "level", "message")


@query(
    "s02_explode_event_array",
    f"""WITH {WIRE} SELECT id, application, iso AS "timestamp", wire_level AS level, "threadName" FROM wire
        UNION ALL SELECT 'again-' || id, application, iso, 'DEBUG', "threadName" FROM wire""",
)
def explode_event_array(spark, sf):
    # Every request holds two events.
    fields = ["id", *WIRE_FIELDS[:6], "properties"]
    changed = {"id": F.concat(F.lit("again-"), "id"), "level": F.lit("DEBUG")}
    second = F.struct(*[changed.get(f, F.col(f)).alias(f) for f in fields])
    requests = wire_events(spark, sf).select("application", F.to_json(F.array(F.struct(*fields), second)).alias("body"))
    df = S.explode_event_array(requests, "body", F.col("application"))
    return df.select("id", "application", "timestamp", "level", "threadName")


@query(
    "s03_read_json_maps",
    f"""WITH {LOGS}
    SELECT application, 'id' AS kind, substr(category, 8) AS item, count(*) AS n FROM logs GROUP BY ALL
    UNION ALL SELECT application, 'k', k, count(*) FROM logs GROUP BY ALL""",
)
def read_json_maps(spark, sf):
    body = F.concat(F.lit('[{"id":"'), "event_type", F.lit('"},'), "props", F.lit("]"))
    df = table(spark, sf, "events").select(F.concat(F.lit("app-"), (F.col("user_id") % 5).cast("string")).alias("app"),
                                          body.alias("body"))
    maps = S.read_json_maps(df, "body", F.col("app"))
    # Each body holds two objects: one with an id, one with the value.
    ids = maps.filter(F.col("id").isNotNull()).groupBy("application", "id").agg(F.count("*").alias("n"))
    values = maps.filter(F.col("id").isNull()).groupBy("application", F.col("fields")["k"].alias("k")).agg(
        F.count("*").alias("n")
    )
    return ids.select("application", F.lit("id").alias("kind"), F.col("id").alias("item"), "n").unionByName(
        values.select("application", F.lit("k").alias("kind"), F.col("k").alias("item"), "n")
    )


@query(
    "s04_kafka_decode",
    f"""WITH {LOGS}, m AS (
      SELECT version, CASE WHEN version % 10 = 0 OR version % 3 = 0 THEN '' ELSE application END AS application
      FROM logs)
    SELECT application, count(*) FILTER (version % 10 <> 0) AS decoded, count(*) FILTER (version % 10 = 0) AS rejected
    FROM m GROUP BY application""",
)
def kafka_decode(spark, sf):
    df = logs(spark, sf)
    message = F.to_json(F.struct(F.when(F.col("version") % 3 != 0, F.col("application")).alias("application"), "level"))
    raw = df.select(F.when(F.col("version") % 10 == 0, "not json").otherwise(message).cast("binary").alias("value"))
    decoded = S.decode_kafka_value(raw)
    return decoded.groupBy("application").agg(
        F.count("fields").alias("decoded"), (F.count("*") - F.count("fields")).alias("rejected")
    )


@query(
    "s06_parse_log_lines",
    f"""WITH {LOGS} SELECT 'shipper' AS application, epoch_us(date_trunc('second', ts)) AS ts_us, {ISO} AS "timestamp",
        level, category, message FROM logs WHERE version % 11 <> 0
        UNION ALL SELECT 'shipper', NULL, NULL, NULL, NULL, 'continued: ' || message FROM logs WHERE version % 11 = 0""",
)
def parse_log_lines(spark, sf):
    line = F.concat_ws(" ", F.date_format("ts", "yy/MM/dd HH:mm:ss"), "level", F.concat("category", F.lit(":")), "message")
    odd = F.concat(F.lit("continued: "), "message")
    lines = logs(spark, sf).select(F.when(F.col("version") % 11 == 0, odd).otherwise(line).alias("value"))
    parsed = S.parse_log_lines(lines, "shipper")
    return parsed.select("application", F.unix_micros("ts").alias("ts_us"), "timestamp", "level", "category", "message")


@query(
    "f13_valid_events",
    f"""WITH {WIRE} SELECT wire_level IS NOT NULL AND version % 11 <> 0 AS valid, count(*) AS n,
        count(*) FILTER (version % 11 = 0) AS unreadable FROM wire GROUP BY ALL""",
)
def valid_events(spark, sf):
    """Every seventh event lacks its level, every eleventh has a time that is none."""
    no_time = F.col("version") % 11 == 0
    df = wire_events(spark, sf).withColumn("timestamp", F.when(no_time, "not a date").otherwise(F.col("timestamp")))
    unreadable = F.count_if(F.col("timestamp") == "not a date").alias("unreadable")
    count = lambda part, ok: part.agg(F.count("*").alias("n"), unreadable).select(F.lit(ok).alias("valid"), "n", "unreadable")
    return count(D.valid_events(df), True).unionByName(count(D.rejected_events(df), False))


@query(
    "p01_flatten_event",
    f"""WITH {WIRE} SELECT id, application, category, iso AS "timestamp", wire_level AS level, flat_message AS message,
        "threadName", coalesce(throwable, '') AS throwable, hostname, k AS k_i,
        CAST(9 AS INT) AS n_fields FROM wire""",
)
def flatten_event(spark, sf):
    flat = E.flatten_event(wire_events(spark, sf).drop("hostname"))
    f = F.col("fields")
    names = [*E.CORE_FIELDS, "hostname", "k_i"]
    return flat.select("id", *[f[n].alias(n) for n in names], F.size(f).alias("n_fields"))


@query(
    "p02_typed_fields",
    f"""WITH {LOGS} SELECT id, CAST(k AS INT) AS k_i, CAST(k AS BIGINT) AS k_l, CAST(k AS DOUBLE) / 2 AS k_d,
        CAST(NULL AS INT) AS bad_i, level AS plain FROM logs""",
)
def typed_fields(spark, sf):
    k = F.col("fields")["k_i"]
    dynamic = F.create_map(
        F.lit("k_i"), k, F.lit("k_l"), k, F.lit("k_d"), (k.cast("double") / 2).cast("string"),
        F.lit("bad_i"), F.col("level"), F.lit("plain"), F.col("level"),
    )
    t = E.typed_fields(logs(spark, sf).withColumn("fields", dynamic))
    return t.select(
        "id", F.col("ints")["k_i"].alias("k_i"), F.col("longs")["k_l"].alias("k_l"), F.col("doubles")["k_d"].alias("k_d"),
        F.col("ints")["bad_i"].alias("bad_i"), F.col("strings")["plain"].alias("plain"),
    )


@query(
    "p05_epoch_millis_to_iso",
    f"WITH {LOGS} SELECT id, {ISO} AS iso FROM logs",
)
def epoch_millis_to_iso(spark, sf):
    return logs(spark, sf).select("id", Tm.epoch_millis_to_iso(F.unix_millis("ts")).alias("iso"))


@query(
    "p06_parse_iso",
    f"WITH {LOGS} SELECT id, CASE WHEN version % 4 <> 0 THEN epoch_us(date_trunc('second', ts)) END AS ts_us FROM logs",
)
def parse_iso(spark, sf):
    text = F.when(F.col("version") % 4 == 0, "yesterday").otherwise(Tm.timestamp_to_iso("ts"))
    return logs(spark, sf).select("id", F.unix_micros(Tm.parse_iso(text)).alias("ts_us"))


@query(
    "p07_unix_time_micros",
    f"""WITH {LOGS} SELECT id, epoch_us(ts) AS from_text, epoch_us(ts) AS from_timestamp,
        epoch_us(date_trunc('second', ts)) - 7200000000 AS from_zoned FROM logs""",
)
def unix_time_micros(spark, sf):
    text = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    zoned = F.concat(F.date_format("ts", "yyyy-MM-dd HH:mm:ss"), F.lit(" +0200"))
    return logs(spark, sf).select(
        "id",
        Tm.unix_time_micros(text, Tm.DEFAULT_STRFTIME).alias("from_text"),
        Tm.unix_time_micros("ts").alias("from_timestamp"),
        Tm.unix_time_micros(zoned, "%Y-%m-%d %H:%M:%S %z").alias("from_zoned"),
    )


CONTAINER_PATH = """'/data/logs/application_15_' || user_id || '/container_15_' || user_id || '_01_' || event_id"""


def container_paths(spark, sf):
    user, event = F.col("user_id").cast("string"), F.col("event_id").cast("string")
    path = F.concat(F.lit("/data/logs/application_15_"), user, F.lit("/container_15_"), user, F.lit("_01_"), event)
    # Every sixth row has no path at all, every tenth a bare name.
    odd = F.when(F.col("event_id") % 6 == 0, F.lit(None)).when(F.col("event_id") % 10 == 1, "plain")
    return table(spark, sf, "events").withColumn(
        "path", F.when((F.col("event_id") % 6 == 0) | (F.col("event_id") % 10 == 1), odd).otherwise(path)
    )


PATHS = f"""paths AS (SELECT *, CASE WHEN event_id % 6 = 0 THEN NULL WHEN event_id % 10 = 1 THEN 'plain'
            ELSE {CONTAINER_PATH} END AS path FROM events)"""
APP_ID = "CASE WHEN path IS NULL OR path = 'plain' THEN '' ELSE 'application_15_' || user_id END"
CONTAINER_ID = "CASE WHEN path IS NULL OR path = 'plain' THEN '' ELSE '01_' || event_id END"


@query(
    "p08_spark_ids_from_path",
    f"WITH {PATHS} SELECT event_id, {APP_ID} AS application_id, {CONTAINER_ID} AS container_id FROM paths",
)
def spark_ids_from_path(spark, sf):
    return container_paths(spark, sf).select(
        "event_id", E.spark_application_id("path").alias("application_id"), E.spark_container_id("path").alias("container_id")
    )


@query(
    "p09_enrich_origin",
    f"""WITH {PATHS} SELECT event_id, CASE WHEN event_id % 2 = 0 THEN 'own' ELSE 'collector' END AS hostname,
        CASE WHEN path IS NOT NULL THEN {APP_ID} END AS application_id,
        CASE WHEN path IS NOT NULL THEN {CONTAINER_ID} ELSE 'old' END AS container_id FROM paths""",
)
def enrich_origin(spark, sf):
    df = container_paths(spark, sf).select(
        "event_id", "path", F.when(F.col("event_id") % 2 == 0, "own").alias("hostname"), F.lit("old").alias("container_id")
    )
    return E.enrich_origin(df, F.lit("collector"), F.col("path")).select(
        "event_id", "hostname", "application_id", "container_id"
    )


@query(
    "p10_join_stack",
    f"""WITH {LOGS} SELECT id, CASE WHEN throwable IS NOT NULL
        THEN throwable || chr(10) || chr(9) || 'at ' || category || chr(10) || chr(9) || 'at main' END AS throwable
        FROM logs""",
)
def join_stack(spark, sf):
    stack = F.array("throwable", F.concat(F.lit("\tat "), "category"), F.lit("\tat main"))
    thrown = F.when(F.col("throwable").isNotNull(), stack)
    return logs(spark, sf).select("id", E.join_stack(thrown).alias("throwable"))


@query(
    "p11_merge_mdc",
    f"""WITH {LOGS} SELECT id, level AS who, CASE WHEN version % 2 = 0 THEN NULL ELSE k END AS k_i, hostname AS host
        FROM logs""",
)
def merge_mdc(spark, sf):
    properties = F.when(F.col("version") % 2 == 1, F.map_concat("fields", F.create_map(F.lit("who"), F.lit("property"))))
    mdc = F.create_map(F.lit("who"), F.col("level"), F.lit("host"), F.col("hostname"))
    m = E.merge_mdc(properties, mdc)
    return logs(spark, sf).select("id", m["who"].alias("who"), m["k_i"].alias("k_i"), m["host"].alias("host"))


@query(
    "p16_lower_columns",
    "SELECT user_id, event_type, count(*) AS n FROM events GROUP BY ALL",
)
def lower_columns(spark, sf):
    df = table(spark, sf, "events").groupBy(F.col("user_id").alias("USER_ID"), F.col("event_type").alias("Event_Type"))
    return E.lower_columns(df.agg(F.count("*").alias("N")))


@query(
    "p17_rows_as_maps",
    f"""WITH {LOGS} SELECT id, level, throwable, CAST(CASE WHEN throwable IS NULL THEN 3 ELSE 4 END AS INT) AS n
        FROM logs""",
)
def rows_as_maps(spark, sf):
    m = E.rows_as_maps(logs(spark, sf).select("id", "level", "throwable", "version"))
    d = F.col("document")
    return m.select(d["id"].alias("id"), d["level"].alias("level"), d["throwable"].alias("throwable"), F.size(d).alias("n"))


@query(
    "p18_extract_gauge",
    f"""WITH {LOGS} SELECT epoch_us(ts) AS ts_us, application AS key, 'load_i' AS tag, CAST(k AS DOUBLE) AS value
        FROM logs WHERE version % 3 = 0""",
)
def extract_gauge(spark, sf):
    line = F.concat(F.lit("metric: load_i="), F.col("fields")["k_i"])
    odd = F.when(F.col("version") % 3 == 1, F.lit("metric: state=up")).otherwise(F.col("message"))
    df = logs(spark, sf).withColumn("message", F.when(F.col("version") % 3 == 0, line).otherwise(odd))
    return E.extract_gauge(df).select(F.unix_micros("ts").alias("ts_us"), "key", "tag", "value")


@query(
    "p20_record_to_event",
    f"""WITH {LOGS} SELECT category, {ISO} AS "timestamp", level, message, "threadName", hostname FROM logs
        UNION ALL SELECT '', {ISO}, level, message, '', NULL FROM logs""",
)
def record_to_event(spark, sf):
    df = logs(spark, sf).withColumn("empty", F.lit(""))
    python_client = E.record_to_event(df, "category", "ts", "level", "message", "threadName", "hostname")
    shell = df.withColumn("level", F.lower("level"))
    return python_client.unionByName(E.record_to_event(shell, "empty", "ts", "level", "message", upper_level=True))


@query(
    "k01_write_logs",
    f"""WITH {WIRE}, {POLICIES}, {PLACED}, newest AS (SELECT application, max(created_epoch) AS e FROM collections
          GROUP BY application)
        SELECT application, application || '_' || e AS collection, count(*) AS n, count(DISTINCT id) AS ids
        FROM wire JOIN newest USING (application) WHERE wire_level IS NOT NULL GROUP BY ALL""",
)
def write_and_read(spark, sf):
    """Rows that arrive go to the open collection of the stored catalogue."""
    path = shared_dir(spark, "logs")
    write_logs(place(normalise(wire_events(spark, sf)), collections(spark, sf)), path)
    df = spark.read.parquet(path)
    return df.groupBy("application", "collection").agg(F.count("*").alias("n"), F.countDistinct("id").alias("ids"))


@query(
    "p01_routed_by_request",
    f"""WITH {LOGS} SELECT application, CASE WHEN version % 4 = 0 THEN 'elsewhere' END AS said, count(*) AS n FROM logs
        GROUP BY ALL""",
)
def routed_by_request(spark, sf):
    """Every fourth event has a property ``application`` that names another one: it stays where it was sent."""
    other = F.when(F.col("version") % 4 == 0, F.create_map(F.lit("application"), F.lit("elsewhere")))
    df = logs(spark, sf).withColumns({"timestamp": Tm.timestamp_to_iso("ts"), "properties": other})
    rows = normalise(df.drop("fields"))
    return rows.groupBy("application", F.col("fields")["application"].alias("said")).agg(F.count("*").alias("n"))


@query(
    "k02_assign_id",
    f"""WITH {LOGS} SELECT CASE WHEN version % 2 = 0 THEN id
        ELSE sha256('{{"level":"' || level || '","host":"' || hostname || '","version":' || version || '}}') END AS id
        FROM logs""",
)
def assign_id(spark, sf):
    df = logs(spark, sf).select(
        "level", F.col("hostname").alias("host"), "version", F.when(F.col("version") % 2 == 0, F.col("id")).alias("id")
    )
    return D.assign_id(df, deterministic=True).select("id")


@query(
    "k03_upsert_latest",
    f"""WITH {LOGS}, sent AS (SELECT *, CASE WHEN version % 3 = 0 THEN 'resent' ELSE hostname || level END AS doc FROM logs)
        SELECT doc AS id, message, version FROM sent QUALIFY row_number() OVER (PARTITION BY doc ORDER BY version DESC) = 1""",
)
def upsert_latest(spark, sf):
    # One id carries a third of all rows.
    doc = F.when(F.col("version") % 3 == 0, "resent").otherwise(F.concat("hostname", "level"))
    return D.upsert_latest(logs(spark, sf).select(doc.alias("id"), "message", "version"))


@query(
    "k03_same_write",
    f"""WITH {LOGS} SELECT hostname || level AS id, version // 1000 AS version, epoch_us(ts) AS ts_us FROM logs
        QUALIFY row_number() OVER (PARTITION BY hostname || level ORDER BY version // 1000 DESC, ts DESC) = 1""",
)
def upsert_same_write(spark, sf):
    """A thousand rows a write: of one write's rows with an id the newest by time is read."""
    doc, write = F.concat("hostname", "level").alias("id"), F.floor(F.col("version") / 1000).alias("version")
    return D.upsert_latest(logs(spark, sf).select(doc, write, "ts")).select("id", "version", F.unix_micros("ts").alias("ts_us"))


@query(
    "k05_event_json",
    f"""WITH {LOGS} SELECT id, '{{"category":"' || category || '","timestamp":"' || {ISO} || '","level":"' || level
        || '","threadName":"' || "threadName" || '"' || CASE WHEN throwable IS NULL THEN '' ELSE ',"throwable":"'
        || throwable || '"' END || ',"thrown":[' || CASE WHEN throwable IS NULL THEN '' ELSE '"' || throwable || '"' END
        || ']}}' AS body FROM logs""",
)
def to_event_json(spark, sf):
    df = logs(spark, sf).select(
        "id", "category", Tm.timestamp_to_iso("ts").alias("timestamp"), "level", "threadName", "throwable",
        F.when(F.col("throwable").isNotNull(), F.array("throwable")).alias("thrown"),
    )
    return df.select("id", event_json(df).alias("body"))


@query(
    "k05_export_event_arrays",
    f"""WITH {LOGS}, b AS (
          SELECT application, CAST(floor(epoch(ts) / 3600) AS BIGINT) * 3600 AS batch_second,
                 row_number() OVER (PARTITION BY application, floor(epoch(ts) / 3600)
                                    ORDER BY epoch_us(ts) % 3600000000 // 3600000, md5(id)) AS r FROM logs)
        SELECT application, batch_second, CAST(floor((r - 1) / 5) AS BIGINT) AS batch_no, count(*) AS events,
               count(*) AS parsed FROM b GROUP BY ALL""",
)
def export_arrays(spark, sf):
    df = logs(spark, sf).withColumn("timestamp", Tm.timestamp_to_iso("ts"))
    out = export_event_arrays(df, seconds=3600, size=5)
    return out.withColumn("parsed", F.json_array_length("body").cast("bigint")).drop("body")


@query(
    "k09_kafka_json",
    f"""WITH {LOGS} SELECT '{{"id":"' || id || '","level":"' || level || '","host":"' || hostname || '"}}' AS value FROM logs""",
)
def kafka_json(spark, sf):
    return kafka_messages(logs(spark, sf).select("id", "level", F.col("hostname").alias("host")))


@query("a05_events_per_application", f"WITH {LOGS} SELECT application, count(*) AS events FROM logs GROUP BY application")
def events_per_application(spark, sf):
    return D.events_per_application(logs(spark, sf))


@query(
    "normalise_events",
    f"""WITH {WIRE} SELECT application, id, epoch_us(date_trunc('second', ts)) AS ts_us, category, wire_level AS level,
        flat_message AS message, hostname, k AS k_i FROM wire WHERE wire_level IS NOT NULL""",
)
def normalise_events(spark, sf):
    rows = normalise(wire_events(spark, sf))
    return rows.select(
        "application", "id", F.unix_micros("ts").alias("ts_us"), "category", "level", "message", "hostname",
        F.col("fields")["k_i"].alias("k_i"),
    )
