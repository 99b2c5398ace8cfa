"""Documents by relevance: BM25 over the words of a field, each application's rows being a collection of their own."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loglake.frames import stored
from loglake.functions.text import query_terms, tokenize
from loglake.schema import MAX_DOCUMENTS

# The usual saturation of a word's frequency and weight of a document's length.
SATURATION, LENGTH_WEIGHT = 1.2, 0.75
#: Decimals of a score that count; documents that are equal in them are ordered by id.
DECIMALS = 9


def field_terms(field: Column | str, wanted: list[str]) -> tuple[Column, Column]:
    """The number of words in a field, and ``[(term, tf)]`` of the wanted ones that occur.

    The words are a lambda's variable: an expression used inside a lambda is computed again at each use, once for
    every term found, while the variable is made once per row.
    """
    known = F.array(*[F.lit(t) for t in wanted]) if wanted else F.array().cast("array<string>")

    def counted(words: Column) -> Column:
        found = F.array_intersect(F.array_distinct(words), known)
        tf = lambda t: F.size(F.filter(words, lambda w: w == t))
        terms = F.transform(found, lambda t: F.named_struct(F.lit("term"), t, F.lit("tf"), tf(t)))
        return F.named_struct(F.lit("length"), F.size(words), F.lit("terms"), terms)

    both = F.transform(F.array(tokenize(field)), counted)[0]
    return both["length"], both["terms"]


def statistics(rows: DataFrame) -> DataFrame:
    """``application, documents, words, frequencies`` of rows with ``length`` and ``terms``.

    One aggregation: a row becomes an element for itself and one for each wanted term it has, which the map tasks
    count. What is left is a row per application, with a map of as many entries as there are wanted terms.
    """
    own = F.array(F.struct(F.lit(None).cast("string").alias("term"), F.lit(0).alias("tf")))
    elements = rows.filter("length > 0").select("application", "length", F.explode(F.concat(own, "terms")).alias("e"))
    counts = elements.groupBy("application", F.col("e.term").alias("term")).agg(
        F.count("*").alias("n"), F.sum("length").alias("words")
    )
    entry = F.when(F.col("term").isNotNull(), F.struct("term", "n"))
    return counts.groupBy("application").agg(
        F.max(F.when(F.col("term").isNull(), F.col("n"))).alias("documents"),
        F.max(F.when(F.col("term").isNull(), F.col("words"))).alias("words"),
        F.map_from_entries(F.array_compact(F.collect_list(entry))).alias("frequencies"),
    )


def bm25(terms: Column, of_search: Column, length: Column) -> Column:
    """The score of a document with ``terms`` for the terms of a search; needs the columns of ``statistics``."""
    average = F.col("words") / F.col("documents")
    norm = SATURATION * (1 - LENGTH_WEIGHT + LENGTH_WEIGHT * length / average)

    def gain(e: Column) -> Column:
        frequency = F.col("frequencies")[e["term"]]
        rarity = F.log(1 + (F.col("documents") - frequency + 0.5) / (frequency + 0.5))
        return rarity * e["tf"] * (SATURATION + 1) / (e["tf"] + norm)

    matched = F.array_sort(F.filter(terms, lambda e: F.array_contains(of_search, e["term"])))
    return F.aggregate(matched, F.lit(0.0), lambda s, e: s + gain(e))


def _constant(value: dict[str, list[str]]) -> Column:
    """A map that the optimizer folds into one literal, however many entries it has."""
    return F.from_json(F.lit(json.dumps(value)), "map<string,array<string>>")


def scored(logs: DataFrame, rows: DataFrame, vocabulary: list[str], field: Column | str) -> DataFrame:
    """``rows``, which have ``length`` and ``terms``, with the statistics of all ``logs`` of their application."""
    length, terms = field_terms(field, vocabulary)
    return with_statistics(logs.select("application", length.alias("length"), terms.alias("terms")), rows)


def with_statistics(counted: DataFrame, rows: DataFrame) -> DataFrame:
    """``rows`` with the ``statistics`` of ``counted``, rows of all logs with ``length`` and ``terms``."""
    return rows.join(stored(statistics(counted), "statistics"), "application", "left")


def most_relevant(
    logs: DataFrame, searches: dict[str, str], field: Column | str = "message", n: int = MAX_DOCUMENTS, carry: tuple[str, ...] = ()
) -> DataFrame:
    """``application, search, id, score, rank`` and the columns of ``carry``: for each search (name -> text) the ``n``
    most relevant rows of each application among those with any of its words.

    Equal scores rank by id. A row without words is no document; a search without words finds nothing. Ranks are cut
    in the map tasks; rows meet the statistics by application, and Spark splits one that holds many.
    """
    wanted = {name: list(dict.fromkeys(query_terms(text))) for name, text in searches.items()}
    by_term: dict[str, list[str]] = {}
    for name, terms in wanted.items():
        for t in terms:
            by_term.setdefault(t, []).append(name)
    vocabulary = sorted(by_term)
    length, terms = field_terms(field, vocabulary)
    # the words of each row are counted once, for the statistics and the scores alike
    every = stored(logs.select("application", "id", *carry, length.alias("length"), terms.alias("terms")), "terms")
    rows = every.filter(F.size("terms") > 0)
    names = F.array_distinct(F.flatten(F.transform("terms", lambda e: _constant(by_term)[e["term"]])))
    hits = with_statistics(every, rows).withColumn("search", F.explode(names))
    score = F.round(bm25(F.col("terms"), _constant(wanted)[F.col("search")], F.col("length")), DECIMALS)
    order = Window.partitionBy("application", "search").orderBy(F.col("score").desc(), "id")
    ranked = hits.withColumn("score", score).withColumn("rank", F.row_number().over(order))
    return ranked.filter(F.col("rank") <= n).select("application", "search", "id", "score", "rank", *carry)


def with_relevance(logs: DataFrame, hits: DataFrame, searches: dict[int, str], field: Column | str) -> DataFrame:
    """``hits`` of conditions, which have the columns of ``relevance_columns``, with a ``score``; 0 for a condition
    that has no search."""
    wanted = {str(number): list(dict.fromkeys(query_terms(text))) for number, text in searches.items()}
    joined = scored(logs, hits, _vocabulary(searches), field)
    terms = _constant(wanted)[F.col("condition").cast("string")]
    score = F.round(bm25(F.col("terms"), terms, F.col("length")), DECIMALS)
    return joined.withColumn("score", F.coalesce(F.when(terms.isNotNull(), score), F.lit(0.0)))


def relevance_columns(searches: dict[int, str], field: Column | str) -> list[Column]:
    length, terms = field_terms(field, _vocabulary(searches))
    return [length.alias("length"), terms.alias("terms")]


def _vocabulary(searches: dict[int, str]) -> list[str]:
    return sorted({t for text in searches.values() for t in query_terms(text)})
