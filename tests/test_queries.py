"""Every registered query against its SQL twin, and the shape of the plans."""

import pytest
from compare import compare

import __spark_entry__ as entry
from loglake.registry import ORACLES, QUERIES

SMALL = "/root/testdata/sf0.001"
# Running a stream to its end is part of building these.
EAGER = {n for n in QUERIES if n.startswith(("t01", "t02", "t03_sliding_count_stream", "t04_absence_stream", "t05", "k01_ingest"))}


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_matches_sql(spark, name):
    ok, note = compare(spark, SMALL, QUERIES[name], ORACLES.get(name))
    assert ok, note


def test_every_query_has_sql():
    assert set(ORACLES) == set(QUERIES)


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns and df.count() >= 0


@pytest.mark.parametrize("name", sorted(set(QUERIES) - EAGER))
def test_no_cross_join(spark, name):
    plan = QUERIES[name](spark, SMALL)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan
    assert "NestedLoop" not in plan


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_time_range_reaches_the_scan(spark):
    plan = plan_of(QUERIES["f05_time_range"](spark, SMALL))
    assert "GreaterThanOrEqual(ts" in plan and "LessThanOrEqual(ts" in plan


def test_look_back_reaches_the_scan(spark):
    assert "GreaterThanOrEqual(ts" in plan_of(QUERIES["who_is_told"](spark, SMALL))


@pytest.mark.parametrize("name", ["a02_rule_documents", "k03_upsert_latest", "l01_cap_documents"])
def test_ranks_are_cut_before_the_shuffle(spark, name):
    plan = plan_of(QUERIES[name](spark, SMALL))
    assert "row_number(), 1, Partial" in plan or "row_number(), 10, Partial" in plan


def test_rules_share_one_scan(spark):
    assert plan_of(QUERIES["j01_100_rules"](spark, SMALL)).count("FileScan") == 1
