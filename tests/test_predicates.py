"""Predicates on the literal search documents and on hand-made edge cases."""

import random
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from loglake.functions import predicates as P
from loglake.functions.text import query_terms, tokenize

NOW = datetime(2024, 3, 1, 12, tzinfo=timezone.utc)


@pytest.fixture(scope="module")
def docs(spark):
    rows = [("1", "ERROR", "slow"), ("2", "INFO", "fast"), ("3", "ERROR", "very slow")]
    return spark.createDataFrame(rows, "id string, level string, message string")


def ids(df):
    return sorted(r["id"] for r in df.collect())


def test_term(docs):
    assert ids(docs.filter(P.term("level", "ERROR"))) == ["1", "3"]
    assert ids(docs.filter(P.term("level", "WARN"))) == []
    assert ids(docs.filter(P.term("level", "error"))) == []


def test_match_and_phrase(docs):
    assert ids(docs.filter(P.match("message", "slow"))) == ["1", "3"]
    assert ids(docs.filter(P.match("message", "SLOW"))) == ["1", "3"]
    assert ids(docs.filter(P.match("message", "fast slow"))) == ["1", "2", "3"]
    assert ids(docs.filter(P.match("message", "sa"))) == []
    assert ids(docs.filter(P.match("message", "!?"))) == []
    assert ids(docs.filter(P.phrase("message", "very slow"))) == ["3"]
    assert ids(docs.filter(P.phrase("message", "slow very"))) == []


def test_search_over_all_fields(docs):
    hit = P.search("error fast", ["id", "level", "message"])
    assert ids(docs.filter(hit)) == ["1", "2", "3"]


@pytest.mark.parametrize(
    "words",
    [["éa"], ["the", "9"], ["straße"], ["a", "b"], ["x"], ["été"], ["東"], ["京"], ["can't"], ["can"], ["t"], ["1.5"], ["5"], ["1"],
     ["a.b"], ["foo_bar"], ["foo"], ["_x"], ["カタカナ"], ["b", "a"], ["5", "a"], ["東", "京"], ["x1"], ["1,000.5"], ["ไทย"]],
)
def test_match_equals_tokenising(spark, words):
    texts = [
        "The a-b, straße; ÉA 99 9", "the9", "a b", "ab", "", " éa", "éaé", "x_x", "x1", "(x)", None, "Été.", "東京 x",
        "東京都", "a\nb", "b a", "\u0301x", "x\u0301", "b,a,b", "Can't", "can 't", "can't.", "cant'", "1.5", "v1.5", "1.5.", "1. 5", "1.a",
        "a.b", "a.b.c", "a.", ".b", "a..b", "foo_bar", "foo_", "_foo", "_x", "__", "__ x __", "foo _ bar", "カタカナ", "カタカナー語", "1,000.5",
        "1,000.5.6", "x1,5", "5,a", "5 a", "a'b'", "x\u0301.y", "ไทย ไท", "a·b", "a:b", "é:a", "b_a",
    ]
    assert query_terms(" ".join(words)) == words
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    wanted = F.array(*[F.lit(w) for w in words])
    spaced = F.concat(F.lit(" "), F.array_join(tokenize("t"), " "), F.lit(" "))
    rows = df.select(
        "t",
        P.match("t", " ".join(words)).alias("match"),
        F.arrays_overlap(tokenize("t"), wanted).alias("any"),
        P.phrase("t", " ".join(words)).alias("phrase"),
        spaced.contains(f" {' '.join(words)} ").alias("adjacent"),
    ).collect()
    for r in rows:
        assert r["match"] == r["any"], r
        assert r["phrase"] == r["adjacent"], r


def test_word_breaks():
    assert query_terms("Very-Slow, 1.5 foo_bar") == ["very", "slow", "1.5", "foo_bar"]
    assert query_terms("Can't won’t 'quoted' rock'n'roll") == ["can't", "won’t", "quoted", "rock'n'roll"]
    assert query_terms("a.b.c 1,000.50 3;4 v1.5 1.x x.1 10:30") == ["a.b.c", "1,000.50", "3;4", "v1.5", "1", "x", "x", "1", "10", "30"]
    assert query_terms("_id __ a_ _1_") == ["_id", "a_", "_1_"]
    assert query_terms("東京カタカナひら abc漢") == ["東", "京", "カタカナ", "ひ", "ら", "abc", "漢"]
    assert query_terms("e\u0301t x\u200dy") == ["e\u0301t", "x\u200dy"]
    assert query_terms("!? ² ...") == []


def test_stored_text_is_cut_like_queries(spark):
    draw = random.Random(5)
    letters = "abé1２9_‿.,':;· -\n\u0301\u200d東ひカー한ไทม์лЖ!²Ⅷ"
    texts = ["".join(draw.choice(letters) for _ in range(draw.randint(0, 30))) for _ in range(3_000)]
    texts.append("x1" * 200_000 + "." + "a.b" * 50_000)
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", tokenize("t").alias("w")).collect()
    for r in rows:
        assert r["w"] == query_terms(r["t"]), repr(r["t"][:99])


@pytest.mark.parametrize(
    "offset, inside", [(timedelta(minutes=10), True), (timedelta(minutes=10, microseconds=1), False),
                       (timedelta(0), True), (timedelta(minutes=-1), False)],
)
def test_time_range_is_closed(spark, offset, inside):
    df = spark.createDataFrame([(NOW - offset,)], "ts timestamp")
    assert df.filter(P.time_range("ts", "NOW-10MINUTES", "NOW", NOW)).count() == int(inside)


def test_relative_time(spark):
    at = lambda e: spark.range(1).select(P.relative_time(e, NOW).alias("t")).first()["t"]
    assert at("NOW/DAY-2HOURS+30MINUTES") == datetime(2024, 2, 29, 22, 30)
    assert at("NOW-1MONTH") == datetime(2024, 2, 1, 12)
    assert at("NOW-1500MILLIS") == datetime(2024, 3, 1, 11, 59, 58, 500000)
    assert at("2024-01-01T00:00:00Z") == datetime(2024, 1, 1)
    assert P.relative_time("*", NOW) is None
    with pytest.raises(ValueError):
        P.relative_time("NOW-ten", NOW)


def test_ranges_and_strings(spark):
    rows = [("a", 5, "host1.com"), ("b", 10, "host-22"), ("c", None, None), ("d", 11, "50%_x")]
    df = spark.createDataFrame(rows, "id string, n int, host string")
    assert ids(df.filter(P.num_range("n", 5, 10))) == ["a", "b"]
    assert ids(df.filter(P.num_range("n", lo=10))) == ["b", "d"]
    assert ids(df.filter(P.num_range("n"))) == ["a", "b", "d"]
    assert ids(df.filter(P.exists("host"))) == ["a", "b", "d"]
    assert ids(df.filter(P.missing("host"))) == ["c"]
    assert ids(df.filter(P.prefix("host", "host"))) == ["a", "b"]
    assert ids(df.filter(P.wildcard("host", "host?.*"))) == ["a"]
    assert ids(df.filter(P.wildcard("host", "*%_x"))) == ["d"]
    assert ids(df.filter(P.negate(P.term("host", "host1.com")))) == ["b", "c", "d"]
    assert ids(df.filter(P.all_of(P.match_all(), P.any_of(P.term("id", "a"), P.term("id", "d"))))) == ["a", "d"]


def test_level_at_least(spark):
    df = spark.createDataFrame([("TRACE",), ("info",), ("ERROR",), ("FATAL",), ("odd",), (None,)], "level string")
    assert df.filter(P.level_at_least("ERROR")).count() == 2
    assert df.filter(P.level_at_least("info")).count() == 3


@pytest.mark.parametrize(
    "found, threshold, fires, strict",
    [(2, 1, True, True), (0, -1, True, True), (0, None, False, False), (2, None, True, True), (0, 1, False, False),
     (3, -1, False, True), (25, 10, True, True), (10, 10, False, False)],
)
def test_threshold(spark, found, threshold, fires, strict):
    df = spark.createDataFrame([(found, threshold)], "n bigint, t int")
    n, t = F.col("n"), F.col("t")
    row = df.select(P.exceeds_threshold(n, t).alias("a"), P.exceeds_threshold(n, t, True).alias("b")).first()
    assert (row["a"], row["b"]) == (fires, strict)


@pytest.mark.parametrize(
    "later, waiting",
    [(timedelta(0), True), (timedelta(minutes=10), True), (timedelta(minutes=10, seconds=59), True),
     (timedelta(minutes=11), False)],
)
def test_wait_period(spark, later, waiting):
    df = spark.createDataFrame([(NOW, NOW + later, 10)], "last timestamp, now timestamp, retry int")
    hit = P.inside_wait_period(F.col("last"), F.col("now"), F.col("retry"))
    assert df.select(hit.alias("w")).first()["w"] is waiting


def test_never_triggered_does_not_wait(spark):
    df = spark.createDataFrame([(None, NOW, 10)], "last timestamp, now timestamp, retry int")
    hit = P.inside_wait_period(F.col("last"), F.col("now"), F.col("retry"))
    assert df.select(hit.alias("w")).first()["w"] is False
