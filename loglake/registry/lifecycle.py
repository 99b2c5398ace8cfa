"""Collections, aliases and retention, over the catalogue that the log rows imply."""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import functions as F

from loglake.frames import shared_dir, stored
from loglake.functions import naming as N
from loglake.operators import collections as Co
from loglake.operators.documents import union_collections
from loglake.plans import retention as M
from loglake.plans.aliases import publish_aliases, read_aliases
from loglake.plans.ingest import place
from loglake.registry.base import (
    CATALOGUE,
    LOGS,
    NOW,
    ORACLES,
    POLICIES,
    SQL_NOW,
    collections,
    logs,
    policies,
    query,
    with_collections,
)
from loglake.schema import COLLECTIONS
from loglake.sinks.logs import write_logs
from loglake.sources.config import with_policy_defaults
from loglake.sources.stored import read_application, read_latest

NOW_EPOCH = 1706659200  # NOW in seconds
EARLIER = datetime(2024, 1, 30, 20, tzinfo=timezone.utc)
EARLIER_EPOCH = 1706644800


@query("w02_assign_collection", f"{CATALOGUE} SELECT id, application || '_' || created_epoch AS collection FROM placed")
def assign_collection(spark, sf):
    return with_collections(spark, sf).select("id", "collection")


@query(
    "p14_split_collection_name",
    f"{CATALOGUE} SELECT collection, application, created_epoch FROM collections UNION ALL SELECT 'x' || application, '', NULL FROM collections",
)
def split_collection_name(spark, sf):
    c = collections(spark, sf)
    names = c.select("collection").unionByName(c.select(F.concat(F.lit("x"), "application").alias("collection")))
    return names.select(
        "collection", N.collection_application("collection").alias("application"),
        N.collection_epoch("collection").alias("created_epoch"),
    )


@query(
    "p15_names",
    f"""WITH {LOGS} SELECT DISTINCT application || '_' || CAST(floor(epoch(ts)) AS BIGINT) AS collection,
        application || '_latest' AS latest, application || '_all' AS "all" FROM logs""",
)
def names(spark, sf):
    return logs(spark, sf).select(
        N.collection_name("application", F.unix_seconds("ts")).alias("collection"),
        N.alias_name("application", "latest").alias("latest"), N.alias_name("application", "all").alias("all"),
    ).distinct()


@query(
    "s08_read_application",
    f"WITH {LOGS} SELECT id, level FROM logs WHERE application = 'app-1'",
)
def read_one_application(spark, sf):
    path = shared_dir(spark, "logs")
    write_logs(with_collections(spark, sf), path)
    return read_application(spark.read.parquet(path), "app-1").select("id", "level")


# The roller ran late: collections opened half a day after they were due, so each was open longer than its period.
LATE = f"""{CATALOGUE}, late AS (SELECT application, created_epoch + 43200 AS created_epoch FROM collections),
  target AS (SELECT l.id, l.application, l.ts, coalesce(
      (SELECT max(created_epoch) FROM late c WHERE c.application = l.application
         AND c.created_epoch <= CAST(floor(epoch(l.ts)) AS BIGINT)),
      (SELECT min(created_epoch) FROM late c WHERE c.application = l.application)) AS created_epoch FROM logs l)"""


def late_catalogue(spark, sf):
    opened = F.col("created_epoch") + 43_200
    return stored(
        collections(spark, sf).select(
            "application", N.collection_name("application", opened).alias("collection"), opened.alias("created_epoch")
        ),
        "late",
    )


@query("w02_place_by_time", f"{LATE} SELECT id, application || '_' || created_epoch AS collection FROM target")
def place_by_time(spark, sf):
    return Co.place_by_time(logs(spark, sf), late_catalogue(spark, sf)).select("id", "collection")


@query(
    "s08_read_since_late_roll",
    f"WITH {LOGS} SELECT application, count(*) AS n FROM logs WHERE ts >= {SQL_NOW} - INTERVAL 2 DAY GROUP BY application",
)
def read_since_late_roll(spark, sf):
    path = shared_dir(spark, "logs")
    catalogue = late_catalogue(spark, sf)
    write_logs(Co.place_by_time(logs(spark, sf), catalogue), path)
    since = F.lit(NOW).cast("timestamp") - F.expr("INTERVAL 2 DAYS")
    return Co.read_since(spark.read.parquet(path), catalogue, since).groupBy("application").agg(F.count("*").alias("n"))


@query(
    "s08_read_latest",
    f"WITH {LOGS} SELECT id, CASE WHEN version % 3 = 0 THEN 'corrected' ELSE level END AS level FROM logs",
)
def latest_versions(spark, sf):
    """A third of the rows are sent again with another level: the later write is read."""
    path = shared_dir(spark, "logs")
    catalogue = collections(spark, sf)
    first = logs(spark, sf)
    again = first.filter("version % 3 = 0").withColumn("level", F.lit("corrected"))
    write_logs(place(first.drop("version"), catalogue, version=1), path)
    write_logs(place(again.drop("version"), catalogue, version=2), path)
    return read_latest(spark.read.parquet(path)).select("id", "level")


# Half of the logs arrive, the roller opens new collections, the others arrive, old collections go.
MIDDLE, ROLL_EPOCH = "TIMESTAMP '2024-01-16'", 1705363200
ROLL_TIME = datetime(2024, 1, 16, tzinfo=timezone.utc)


@query(
    "k01_ingest_roll_expire",
    f"""WITH {LOGS}, {POLICIES}, first_half AS (SELECT application, count(*) AS n FROM logs WHERE ts < {MIDDLE} GROUP BY ALL),
        second AS (SELECT application, count(*) AS n FROM logs WHERE ts >= {MIDDLE} GROUP BY ALL),
        halves AS (SELECT l.application, coalesce(f.n, 0) AS before, coalesce(s.n, 0) AS later,
                   p.application IS NOT NULL AS rolls, coalesce(p.num_collections, 7) AS keep
                 FROM (SELECT DISTINCT application FROM logs) l LEFT JOIN first_half f USING (application)
                 LEFT JOIN second s USING (application) LEFT JOIN policies p USING (application))
        SELECT application, before + later AS all_rows, CASE WHEN rolls THEN later ELSE before + later END AS latest_rows
        FROM halves""",
)
def ingest_roll_expire(spark, sf):
    path = shared_dir(spark, "logs")
    rows, keep = logs(spark, sf), policies(spark, sf)
    start = datetime(2024, 1, 1, tzinfo=timezone.utc)
    empty = spark.createDataFrame([], COLLECTIONS)
    catalogue = stored(M.open_missing(M.initialize_applications(keep, empty, start), rows, start), "catalogue")
    middle = F.lit(ROLL_TIME).cast("timestamp")
    write_logs(place(rows.filter(F.col("ts") < middle), catalogue), path)
    rolled = M.roll(keep, catalogue, ROLL_TIME)
    catalogue = stored(rolled.collections, "catalogue")
    write_logs(place(rows.filter(F.col("ts") >= middle), catalogue), path)
    M.expire(spark, path, rolled.retired, confirm=True)
    written = spark.read.parquet(path)
    in_alias = written.join(Co.alias_members(catalogue), "collection").groupBy("application").agg(
        F.count_if(F.col("alias").endswith("_all")).alias("all_rows"),
        F.count_if(F.col("alias").endswith("_latest")).alias("latest_rows"),
    )
    return in_alias.select("application", "all_rows", "latest_rows")


@query(
    "s08_read_since",
    f"WITH {LOGS} SELECT id, application FROM logs WHERE ts >= {SQL_NOW} - INTERVAL 36 HOUR",
)
def read_since(spark, sf):
    path = shared_dir(spark, "logs")
    write_logs(with_collections(spark, sf), path)
    since = F.lit(NOW).cast("timestamp") - F.expr("INTERVAL 36 HOURS")
    return Co.read_since(spark.read.parquet(path), collections(spark, sf), since).select("id", "application")


@query(
    "s11_policies",
    f"{CATALOGUE} SELECT application, CAST(coalesce(num_collections, 7) AS INT) AS num_collections, "
    "CAST(coalesce(roll_period_days, 1) AS INT) AS roll_period_days FROM policies",
)
def policy_defaults(spark, sf):
    return with_policy_defaults(policies(spark, sf))


@query(
    "f15_should_roll",
    f"""{CATALOGUE}, newest AS (SELECT application, max(created_epoch) AS e FROM collections GROUP BY application)
        SELECT application, coalesce(({EARLIER_EPOCH} - e) // 86400 >= coalesce(roll_period_days, 1), true) AS due
        FROM policies LEFT JOIN newest USING (application)""",
)
def due(spark, sf):
    return Co.due_applications(collections(spark, sf), policies(spark, sf), EARLIER).select("application", "due")


RANKED = f"""{CATALOGUE}, ranked AS (SELECT *, row_number() OVER (PARTITION BY application ORDER BY created_epoch DESC) AS r
             FROM collections),
  retired AS (SELECT r.application, collection, created_epoch FROM ranked r JOIN policies USING (application)
              WHERE r > coalesce(num_collections, 7))"""


@query("w01_retired_collections", f"{RANKED} SELECT * FROM retired")
def retired(spark, sf):
    return Co.retired_collections(collections(spark, sf), policies(spark, sf))


@query("u01_retained_collections", f"{RANKED} SELECT * FROM collections EXCEPT SELECT * FROM retired")
def retained(spark, sf):
    return Co.retained_collections(collections(spark, sf), policies(spark, sf))


@query("l02_collections_by_age", f"{CATALOGUE} SELECT * FROM collections ORDER BY created_epoch DESC, collection")
def by_age(spark, sf):
    return Co.collections_by_age(collections(spark, sf))


@query(
    "a06_newest_collection",
    f"{CATALOGUE} SELECT application, arg_max(collection, created_epoch) AS collection, max(created_epoch) AS created_epoch "
    "FROM collections GROUP BY application",
)
def newest(spark, sf):
    return Co.newest_collection(collections(spark, sf))


ALIASES = f"""{CATALOGUE}, aliases AS (SELECT application || '_all' AS alias, collection FROM collections UNION ALL
  SELECT application || '_latest', arg_max(collection, created_epoch) FROM collections GROUP BY application)"""


@query(
    "a07_alias_map",
    f"{ALIASES} SELECT alias, string_agg(collection, ',' ORDER BY collection) AS collections FROM aliases GROUP BY alias",
)
def alias_map(spark, sf):
    return Co.alias_map(collections(spark, sf)).select("alias", F.array_join("collections", ",").alias("collections"))


@query(
    "a08_list_applications",
    f"""{CATALOGUE} SELECT application, arg_max(collection, created_epoch) AS latest,
        string_agg(collection, ',' ORDER BY collection) AS "all" FROM collections GROUP BY application""",
)
def list_applications(spark, sf):
    listed = Co.list_applications(collections(spark, sf), verbose=True)
    return listed.select("application", "latest", F.array_join("all", ",").alias("all"))


@query("a08_application_names", f"{CATALOGUE} SELECT DISTINCT application FROM collections")
def application_names(spark, sf):
    return Co.list_applications(collections(spark, sf))


@query(
    "u02_union_collections",
    f"""WITH {LOGS} SELECT application, id, CASE WHEN application = 'app-0' THEN hostname END AS hostname,
        CASE WHEN application <> 'app-0' THEN level END AS level FROM logs""",
)
def union(spark, sf):
    df = logs(spark, sf)
    first = df.filter("application = 'app-0'").select("application", "id", "hostname")
    others = [df.filter(F.col("application") == a).select("application", "id", "level") for a in ("app-1", "app-2", "app-3", "app-4")]
    return union_collections([first, *others])


@query(
    "j05_resolve_alias",
    f"""{ALIASES} SELECT id FROM placed WHERE application || '_' || created_epoch IN
        (SELECT collection FROM aliases WHERE alias = 'app-2_latest')""",
)
def resolve_alias(spark, sf):
    aliases = Co.alias_members(collections(spark, sf))
    return Co.resolve_alias(with_collections(spark, sf), aliases, "app-2_latest").select("id")


@query(
    "f18_lookups",
    f"""{ALIASES} SELECT application, EXISTS (SELECT 1 FROM aliases a WHERE a.alias = p.application || '_latest') AS has_alias,
        EXISTS (SELECT 1 FROM collections c WHERE c.collection = p.application) AS has_collection,
        (SELECT count(*) FROM aliases a WHERE a.alias = p.application || '_all') AS members
        FROM (SELECT DISTINCT application FROM logs) p""",
)
def lookups(spark, sf):
    catalogue = collections(spark, sf)
    aliases = stored(Co.alias_members(catalogue), "aliases")
    members = Co.members_by_alias(aliases).select("alias", F.size("collections").cast("long").alias("members"))
    found = Co.list_applications(catalogue)
    write = members.select(F.col("alias").alias("write_alias"))
    read = members.withColumnRenamed("alias", "read_alias")
    names = catalogue.select(F.col("collection").alias("name")).distinct()
    found = found.join(write, N.alias_name("application", "latest") == F.col("write_alias"), "left")
    found = found.join(read, N.alias_name("application", "all") == F.col("read_alias"), "left")
    return found.join(names, F.col("application") == F.col("name"), "left").select(
        "application",
        F.col("write_alias").isNotNull().alias("has_alias"),
        F.col("name").isNotNull().alias("has_collection"),
        F.coalesce("members", F.lit(0)).cast("long").alias("members"),
    )


# Retention starts from the collections of all applications but one, so that one has to be initialised.
KNOWN = "SELECT * FROM collections WHERE application <> 'app-1'"


def known(spark, sf):
    return collections(spark, sf).filter("application <> 'app-1'")


@query(
    "m01_initialize_applications",
    f"{CATALOGUE} {KNOWN} UNION ALL SELECT 'app-1', 'app-1_{NOW_EPOCH}', {NOW_EPOCH}::BIGINT",
)
def initialize(spark, sf):
    return M.initialize_applications(policies(spark, sf), known(spark, sf), NOW)


ROLL = f"""{CATALOGUE}, known AS ({KNOWN}),
  newest AS (SELECT application, max(created_epoch) AS e FROM known GROUP BY application),
  due AS (SELECT p.application, coalesce(num_collections, 7) AS keep FROM policies p LEFT JOIN newest USING (application)
          WHERE e IS NULL OR ({EARLIER_EPOCH} - e) // 86400 >= coalesce(roll_period_days, 1)),
  everything AS (SELECT * FROM known UNION ALL
    SELECT application, application || '_{EARLIER_EPOCH}', {EARLIER_EPOCH}::BIGINT FROM due),
  ranked AS (SELECT *, row_number() OVER (PARTITION BY application ORDER BY created_epoch DESC) AS r FROM everything),
  marked AS (SELECT r.application, collection, created_epoch, d.application IS NOT NULL AND r > keep AS retired
             FROM ranked r LEFT JOIN due d USING (application))"""


@query(
    "m02_roll",
    f"""{ROLL} SELECT application, collection, CASE WHEN retired THEN 'retired' WHEN created_epoch = {EARLIER_EPOCH}
        THEN 'opened' ELSE 'kept' END AS fate FROM marked""",
)
def roll(spark, sf):
    r = M.roll(policies(spark, sf), known(spark, sf), EARLIER)
    fate = F.when(F.col("created_epoch") == EARLIER_EPOCH, "opened").otherwise("kept")
    kept = r.collections.select("application", "collection", fate.alias("fate"))
    return kept.unionByName(r.retired.select("application", "collection", F.lit("retired").alias("fate")))


@query(
    "m03_expire",
    f"""{ROLL} SELECT application, collection FROM marked WHERE NOT retired AND created_epoch <> {EARLIER_EPOCH}
        UNION ALL SELECT application, collection FROM collections WHERE application = 'app-1'""",
)
def expire(spark, sf):
    """Logs of all applications are stored; the roll knows all but one, whose folders stay."""
    path = shared_dir(spark, "logs")
    write_logs(with_collections(spark, sf), path)
    M.expire(spark, path, M.roll(policies(spark, sf), known(spark, sf), EARLIER).retired, confirm=True)
    return spark.read.parquet(path).select("application", "collection").distinct()


@query("m04_delete_applications", f"{CATALOGUE} SELECT * FROM collections WHERE application NOT IN (SELECT application FROM policies)")
def delete_applications(spark, sf):
    return M.delete_applications(collections(spark, sf), policies(spark, sf))


@query(
    "m05_create_collection",
    f"{CATALOGUE} SELECT * FROM collections UNION ALL SELECT 'fresh', 'fresh_{NOW_EPOCH}', {NOW_EPOCH}::BIGINT",
)
def create_collection(spark, sf):
    return M.create_collection(collections(spark, sf), "fresh", NOW)


@query(
    "m06_aliases",
    f"""{ALIASES}, newest AS (SELECT arg_max(collection, created_epoch) AS collection FROM collections
          WHERE application = 'app-0')
        SELECT * FROM aliases WHERE alias NOT IN ('app-0_all', 'app-1_all', 'app-3_latest')
        UNION ALL SELECT 'app-1_all', unnest(['c1', 'c2'])
        UNION ALL SELECT 'app-0_all', collection FROM newest""",
)
def aliases(spark, sf):
    catalogue = collections(spark, sf)
    current = M.delete_alias(Co.alias_members(catalogue), "app-3_latest")
    current = M.set_alias(current, "app-1_all", ["c1", "c2"])
    only_newest = Co.newest_collection(catalogue).filter("application = 'app-0'").select(
        N.alias_name("application", "all").alias("alias"), "collection"
    )
    return M.repoint_aliases(current, only_newest)


@query("m06_alias_versions", ORACLES["m06_aliases"])
def alias_versions(spark, sf):
    """The same changes, each published as versions of the aliases it touches."""
    catalogue, path = collections(spark, sf), shared_dir(spark, "aliases")
    publish_aliases(Co.alias_members(catalogue), path)
    pointed = spark.createDataFrame([("app-1_all", "c1"), ("app-1_all", "c2")], "alias string, collection string")
    publish_aliases(pointed, path, gone=["app-3_latest"])
    only_newest = Co.newest_collection(catalogue).filter("application = 'app-0'").select(
        N.alias_name("application", "all").alias("alias"), "collection"
    )
    publish_aliases(only_newest, path)
    return read_aliases(spark, path)
