"""Retention: opening, rolling, aliases, deletion."""

from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from loglake.functions import naming as N
from loglake.frames import shared_dir, stored
from loglake.operators import collections as Co
from loglake.plans import retention as M
from loglake.schema import COLLECTIONS, POLICIES
from loglake.sinks.logs import write_logs
from loglake.sources.config import policies_frame
from loglake.sources.stored import read_application

T0 = datetime(2018, 6, 26, 20, 47, 57, tzinfo=timezone.utc)
DAY = timedelta(days=1)


def policies(spark, *rows):
    return spark.createDataFrame(list(rows), POLICIES)


def catalogue(spark, *names):
    df = spark.createDataFrame([(n,) for n in names], "collection string")
    return df.select(N.collection_application("collection").alias("application"), "collection",
                     N.collection_epoch("collection").alias("created_epoch"))


def names(df):
    return sorted(r["collection"] for r in df.collect())


def run(p, c, now):
    return M.roll(p, M.initialize_applications(p, c, now), now)


def test_names(spark):
    row = catalogue(spark, "my_collection_1530046077").first()
    assert (row["application"], row["created_epoch"]) == ("my_collection", 1530046077)
    assert catalogue(spark, "plain").first()["created_epoch"] is None
    one = spark.range(1).select(N.collection_name(F.lit("a"), F.lit(5)).alias("c"), N.alias_name(F.lit("a"), "all").alias("l"))
    assert tuple(one.first()) == ("a_5", "a_all")
    with pytest.raises(ValueError):
        N.alias_name("a", "other")


def test_keeps_the_newest(spark):
    p = policies(spark, ("app", 2, 1))
    state = spark.createDataFrame([], COLLECTIONS)
    for day in range(5):
        state = stored(run(p, state, T0 + day * DAY).collections, "catalogue")
    expected = [f"app_{int((T0 + d * DAY).timestamp())}" for d in (3, 4)]
    assert names(state) == expected
    assert Co.get_alias(Co.alias_members(state), "app_all") == expected
    assert Co.get_alias(Co.alias_members(state), "app_latest") == expected[1:]


def test_rolls_when_due(spark):
    p = policies(spark, ("app", 7, 1))
    first = stored(run(p, spark.createDataFrame([], COLLECTIONS), T0).collections, "catalogue")
    assert run(p, first, T0 + timedelta(hours=1)).opened.count() == 0
    assert run(p, first, T0 + DAY - timedelta(seconds=1)).opened.count() == 0
    later = run(p, first, T0 + 2 * DAY)
    assert names(later.opened) == [f"app_{int((T0 + 2 * DAY).timestamp())}"]
    assert Co.newest_collection(later.collections).first()["collection"] == names(later.opened)[0]


def test_delete_and_create_again(spark):
    p = policies(spark, ("a", 2, 1), ("b", 2, 1))
    state = stored(run(p, spark.createDataFrame([], COLLECTIONS), T0).collections, "catalogue")
    gone = M.delete_applications(state, p)
    assert gone.count() == 0 and not Co.alias_exists(Co.alias_members(gone), "a_all")
    assert run(p, gone, T0 + DAY).collections.count() == 2


def test_name_prefixes_do_not_touch_each_other(spark):
    c = catalogue(spark, "a_100", "a_200", "a-options_100", "a-options_50", "a_b_10")
    p = policies(spark, ("a", 1, 1))
    r = M.roll(p, c, T0)
    assert names(r.retired) == ["a_100", "a_200"]
    kept = names(M.delete_applications(c, spark.createDataFrame([("a",)], "application string")))
    assert kept == ["a-options_100", "a-options_50", "a_b_10"]


def test_not_due_keeps_everything(spark):
    fresh = int(T0.timestamp())
    c = catalogue(spark, f"a_{fresh}", f"a_{fresh - 10}", f"a_{fresh - 20}")
    r = M.roll(policies(spark, ("a", 1, 1)), c, T0)
    assert r.retired.count() == 0 and r.collections.count() == 3


def test_policy_defaults(spark):
    config = {"applications": [{"name": "a"}, {"name": "b", "numCollections": 2, "rollPeriod": 3}]}
    assert [tuple(r) for r in policies_frame(spark, config).collect()] == [("a", 7, 1), ("b", 2, 3)]


def test_lookups(spark):
    c = catalogue(spark, "a_1", "a_2")
    aliases = Co.alias_members(c)
    assert Co.collection_exists(c, "a_1") and not Co.collection_exists(c, "a_3")
    assert Co.alias_exists(aliases, "a_latest") and Co.get_alias(aliases, "b_latest") is None
    assert names(M.delete_collection(c, "a_1")) == ["a_2"]
    with pytest.raises(ValueError):
        M.create_collection(M.create_collection(c, "new", T0), "new", T0)
    pointed = M.set_alias(aliases, "a_all", ["a_2"])
    assert Co.get_alias(pointed, "a_all") == ["a_2"] and Co.get_alias(pointed, "a_latest") == ["a_2"]
    assert not Co.alias_exists(M.delete_alias(pointed, "a_all"), "a_all")
    with pytest.raises(ValueError):
        M.set_alias(aliases, "a_all", [])


def test_expire_and_prune(spark, tmp_path):
    rows = [("a", f"a_{int((T0 + d * DAY).timestamp())}", T0 + d * DAY, str(d)) for d in range(4)]
    df = spark.createDataFrame(rows, "application string, collection string, ts timestamp, id string")
    path = str(tmp_path / "logs")
    write_logs(df, path)
    c = stored(catalogue(spark, *[r[1] for r in rows]), "catalogue")
    retired = Co.retired_collections(c, policies(spark, ("a", 2, 1)))
    assert len(M.expire(spark, path, retired)) == 2 and spark.read.parquet(path).count() == 4
    M.expire(spark, path, retired, confirm=True)
    left = spark.read.parquet(path)
    assert sorted(r["id"] for r in left.collect()) == ["2", "3"]
    assert M.expire(spark, path, retired, confirm=True) == []

    assert [r["id"] for r in read_application(left, "a", [rows[3][1]]).collect()] == ["3"]


def test_read_since_opens_no_older_collection(spark, tmp_path):
    rows = [("a", T0 + d * DAY + timedelta(hours=h), f"{d}-{h}") for d in range(4) for h in (0, 23)]
    df = spark.createDataFrame(rows, "application string, ts timestamp, id string")
    placed = Co.assign_collection(df, policies(spark, ("a", 7, 1)))
    write_logs(placed.drop("created_epoch"), str(tmp_path / "logs"))
    catalogue_now = stored(Co.collections_of(placed), "catalogue")
    since = F.lit(T0 + 2 * DAY + timedelta(hours=1)).cast("timestamp")
    assert Co.collections_since(catalogue_now, since).count() == 2
    found = Co.read_since(spark.read.parquet(str(tmp_path / "logs")), catalogue_now, since)
    assert sorted(r["id"] for r in found.collect()) == ["2-23", "3-0", "3-23"]


def test_assign_collection(spark):
    rows = [("a", T0), ("a", T0 + DAY), ("a", T0 + 3 * DAY - timedelta(seconds=1)), ("b", T0 + DAY)]
    logs = spark.createDataFrame(rows, "application string, ts timestamp")
    p = policies(spark, ("a", None, 2))
    epoch = int(T0.timestamp())
    got = [r["collection"] for r in Co.assign_collection(logs, p).orderBy("application", "ts").collect()]
    assert got == [f"a_{epoch}", f"a_{epoch}", f"a_{epoch + 172800}", f"b_{epoch + 86400}"]
    fixed = Co.assign_collection(logs, p, T0 - DAY).orderBy("application", "ts").collect()
    assert fixed[0]["collection"] == f"a_{epoch - 86400}" and fixed[1]["collection"] == f"a_{epoch + 86400}"


def test_late_roll_loses_no_rows(spark, tmp_path):
    """The second collection opened 12 hours late: the first took rows for 36 hours, and they are found."""
    c = catalogue(spark, f"a_{int(T0.timestamp())}", f"a_{int((T0 + timedelta(hours=36)).timestamp())}")
    rows = [("a", T0 + timedelta(hours=h), str(h)) for h in (-1, 0, 30, 35, 36, 50)] + [("new", T0, "n")]
    placed = Co.place_by_time(spark.createDataFrame(rows, "application string, ts timestamp, id string"), c)
    got = {r["id"]: r["created_epoch"] for r in placed.collect()}
    first, second = int(T0.timestamp()), int((T0 + timedelta(hours=36)).timestamp())
    assert got == {"-1": first, "0": first, "30": first, "35": first, "36": second, "50": second, "n": None}
    write_logs(placed.filter("collection IS NOT NULL"), str(tmp_path / "logs"))
    since = F.lit(T0 + timedelta(hours=30)).cast("timestamp")
    found = Co.read_since(spark.read.parquet(str(tmp_path / "logs")), c, since)
    assert sorted(r["id"] for r in found.collect()) == ["30", "35", "36", "50"]


def test_rows_go_to_the_open_collection(spark):
    c = M.open_missing(catalogue(spark, "a_100", "a_200"), spark.createDataFrame([("b",)], "application string"), T0)
    rows = spark.createDataFrame([("a", T0, "1"), ("b", T0, "2")], "application string, ts timestamp, id string")
    got = {r["id"]: r["collection"] for r in Co.place_in_open(rows, c).collect()}
    assert got == {"1": "a_200", "2": f"b_{int(T0.timestamp())}"}


def test_no_shared_folder_is_an_error():
    class Session:
        conf = {}
        sparkContext = type("Context", (), {"getCheckpointDir": staticmethod(lambda: None)})

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared_dir(Session, "x")


def test_lookups_query_makes_no_look_up_an_application(spark, monkeypatch):
    from loglake.registry import lifecycle

    def refused(*_):
        raise AssertionError("a look-up of one application")

    rows = [(f"a{i}", f"a{i}_{n}", n) for i in range(40) for n in range(1 + i % 3)] + [("bare", "bare", 5)]
    catalogue = spark.createDataFrame(rows, "application string, collection string, created_epoch long")
    for name in ("alias_exists", "collection_exists", "get_alias"):
        monkeypatch.setattr(Co, name, refused)
    monkeypatch.setattr(lifecycle, "collections", lambda *_: catalogue)
    found = {tuple(r) for r in lifecycle.lookups(spark, "").collect()}
    assert found == {(f"a{i}", True, False, 1 + i % 3) for i in range(40)} | {("bare", True, True, 1)}
