"""What storage spares a reader: files without a word, row groups without an id, fields not asked for; alias versions."""

from datetime import datetime, timedelta, timezone
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from loglake.functions import predicates as P
from loglake.functions.events import typed_fields, variant_field, variant_fields
from loglake.operators import documents as D
from loglake.plans.aliases import compact_aliases, publish_aliases, read_aliases
from loglake.sinks.logs import write_batch, write_logs
from loglake.sources import sidecar as S

BASE = datetime(2024, 1, 1, tzinfo=timezone.utc)
LOG = "id string, application string, collection string, ts timestamp, message string"


def stored(spark, path, groups):
    """One file of logs for each group of messages."""
    for i, messages in enumerate(groups):
        rows = [(f"{i}-{j}", "a", "a_0", BASE + timedelta(minutes=j), m) for j, m in enumerate(messages)]
        spark.createDataFrame(rows, LOG).coalesce(1).write.mode("append").partitionBy("application", "collection").parquet(path)
    return spark.read.parquet(path)


GROUPS = [["disk full", "can't open"], ["slow query", None], ["", "Disk slow"], ["version 1.5 of 東京"]]


def scanned(df):
    """Rows that the scan gives to the plan."""
    plan = df.filter("id IS NOT NULL")._jdf.queryExecution().executedPlan()
    plan.executeCollect()
    return plan.collectLeaves().head().metrics().apply("numOutputRows").value()


@pytest.mark.parametrize(
    ("text", "every", "files"),
    [("disk", False, 2), ("disk slow", False, 3), ("slow disk", True, 1), ("can't", False, 1), ("can", False, 0),
     ("1.5", False, 1), ("京", False, 1), ("absent", False, 0), ("!!", False, 0)],
)
def test_only_matching_files_are_read(spark, tmp_path, text, every, files):
    logs = stored(spark, f"{tmp_path}/logs", GROUPS)
    assert S.index_files(logs, f"{tmp_path}/words") == 4
    sidecar = S.read_sidecar(spark, f"{tmp_path}/words")
    assert S.matching_files(sidecar, text, every).count() == files
    predicate = (P.phrase if every else P.match)("message", text)
    found = S.pruned(logs, sidecar, text, every)
    assert sorted(r["id"] for r in found.filter(predicate).collect()) == sorted(r["id"] for r in logs.filter(predicate).collect())


def test_files_without_the_word_are_not_opened(spark, tmp_path):
    logs = stored(spark, f"{tmp_path}/logs", GROUPS)
    S.index_files(logs, f"{tmp_path}/words")
    sidecar = S.read_sidecar(spark, f"{tmp_path}/words")
    matching = {r["file"] for r in S.matching_files(sidecar, "query", False).collect()}
    for f in S.files_of(logs):
        if f not in matching:  # whoever opens one of these fails
            local = Path(f.removeprefix("file:"))
            local.write_bytes(b"x" * local.stat().st_size)
            Path(local.parent, f".{local.name}.crc").unlink()
    assert [r["id"] for r in S.pruned(logs, sidecar, "query").filter(P.match("message", "query")).collect()] == ["1-0"]
    with pytest.raises(Exception, match="Parquet|magic|footer|FAILED_READ"):
        logs.filter(P.match("message", "query")).collect()


def test_new_files_are_read_and_then_indexed(spark, tmp_path, monkeypatch):
    path = f"{tmp_path}/logs"
    S.index_files(stored(spark, path, GROUPS[:2]), f"{tmp_path}/words")
    logs = stored(spark, path, [["a new disk"]])
    sidecar = S.read_sidecar(spark, f"{tmp_path}/words")
    hits = lambda: S.pruned(logs, S.read_sidecar(spark, f"{tmp_path}/words"), "disk").filter(P.match("message", "disk")).count()
    assert sidecar.filter("word IS NULL").count() == 2 and hits() == 2
    assert S.index_files(logs, f"{tmp_path}/words") == 1 and S.index_files(logs, f"{tmp_path}/words") == 0
    assert S.read_sidecar(spark, f"{tmp_path}/words").filter("word IS NULL").count() == 3 and hits() == 2
    monkeypatch.setattr(S, "NAMED_FILES", 1)
    assert hits() == 2


@pytest.mark.parametrize("batch", [False, True])
def test_row_groups_without_the_id_are_skipped(spark, tmp_path, batch):
    rows = spark.range(2_000).select(
        F.sha2(F.col("id").cast("string"), 256).alias("id"), F.lit("a").alias("application"), F.lit("a_0").alias("collection"),
        F.timestamp_seconds("id").alias("ts"),
    )
    path = str(tmp_path / "logs")
    write_batch(rows.coalesce(1), path, 0) if batch else write_logs(rows.coalesce(1), path)
    logs = spark.read.parquet(path)
    there = rows.orderBy("id").collect()[1_000]["id"]
    assert [r["id"] for r in D.get_by_id(logs, [there]).collect()] == [there]
    # in the middle of the range of ids, so that only the filter tells
    absent = there[:-1] + ("0" if there[-1] != "0" else "1")
    assert scanned(D.get_by_id(logs, [absent])) == 0 < scanned(D.get_by_id(logs, [there]))


def test_variant_fields_equal_typed_maps(spark, tmp_path):
    maps = [{"k_i": "5", "k_d": "1.5", "who": "me", "n_l": "30000000000"}, {"k_i": "x", "f_f": "2.5"}, {}, None, {"k_i": "11", "a b": "c"}]
    df = spark.createDataFrame([(i, m) for i, m in enumerate(maps)], "id int, fields map<string,string>")
    variant_fields(typed_fields(df)).write.parquet(str(tmp_path / "v"))
    rows = spark.read.parquet(str(tmp_path / "v"))
    asked = {"k_i": "ints", "n_l": "longs", "f_f": "floats", "k_d": "doubles", "who": "strings", "a b": "strings"}
    for name, kind in asked.items():
        both = rows.select(variant_field(name).alias("v"), F.col(kind)[name].alias("m")).collect()
        assert [r["v"] for r in both] == [r["m"] for r in both], name
    assert [r["id"] for r in rows.filter(P.num_range(variant_field("k_i"), 5, 10)).collect()] == [0]
    with pytest.raises(ValueError):
        variant_field("a'] b")


def members(df):
    out: dict = {}
    for r in df.collect():
        out.setdefault(r["alias"], set()).add(r["collection"])
    return out


def test_a_reader_sees_an_alias_before_or_after_a_change(spark, tmp_path):
    path = str(tmp_path / "aliases")
    frame = lambda *rows: spark.createDataFrame(list(rows), "alias string, collection string")
    assert members(read_aliases(spark, path)) == {}
    first = publish_aliases(frame(("all", "c1"), ("all", "c2"), ("latest", "c2"), ("all", "c1")), path)
    before = read_aliases(spark, path)
    # a writer that has come half way: two of three rows of the next version are there
    half = frame(("all", "c2"), ("all", "c3")).withColumns({"version": F.lit(first + 1), "members": F.lit(3).cast("bigint")})
    half.coalesce(1).write.mode("append").parquet(path)
    assert members(before) == members(read_aliases(spark, path)) == {"all": {"c1", "c2"}, "latest": {"c2"}}
    rest = frame(("all", "c4")).withColumns({"version": F.lit(first + 1), "members": F.lit(3).cast("bigint")})
    rest.write.mode("append").parquet(path)
    assert members(read_aliases(spark, path)) == {"all": {"c2", "c3", "c4"}, "latest": {"c2"}}
    publish_aliases(frame(("latest", "c4")), path, gone=["all"])
    assert members(read_aliases(spark, path)) == {"latest": {"c4"}}
    assert members(read_aliases(spark, path, at=first)) == {"all": {"c1", "c2"}, "latest": {"c2"}}
    publish_aliases(frame(("latest", "c9")), path, version=first)  # an old version does not win
    assert members(read_aliases(spark, path))["latest"] == {"c4"}
    compact_aliases(spark, path, str(tmp_path / "compacted"))
    assert members(read_aliases(spark, str(tmp_path / "compacted"))) == {"latest": {"c4"}}


def test_stored_documents_grow_with_their_splits(spark, tmp_path):
    from loglake.registry import search

    rows = [(i, "ab"[i % 2], ["en", "de", "fr"][i % 3], f"the license {i}" if i % 5 else f"other {i}") for i in range(1200)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, lang string, text string")
    docs.repartition(12).write.parquet(f"{tmp_path}/documents.parquet")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        assert spark.read.parquet(f"{tmp_path}/documents.parquet").rdd.getNumPartitions() == 12
        stored = search.stored_documents(spark, str(tmp_path))
    finally:
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert len(stored.inputFiles()) > 6
    assert stored.count() == 1200
    found = {r["id"] for r in search.match_pruned(spark, str(tmp_path)).collect()}
    assert found == {str(i) for i in range(1200) if i % 5}
