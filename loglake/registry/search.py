"""Search predicates and filters."""

from __future__ import annotations

from pyspark.sql import functions as F

from loglake.functions import predicates as P
from loglake.frames import shared_dir
from loglake.functions.events import typed_fields, variant_field, variant_fields
from loglake.functions.text import catch_all_text, tokenize
from loglake.operators import documents as D
from loglake.operators.relevance import most_relevant
from loglake.registry.base import LOGS, NOW, SQL_NOW, logs, query, search_documents, table
from loglake.sinks.logs import write_logs
from loglake.sources.sidecar import index_files, pruned, read_sidecar

# Word breaks of texts in Latin script, spelled out by runs of letters and of digits.
_LETTERS = r"\p{L}[\p{L}\p{M}]*(?:[.:·''‘’]\p{L}[\p{L}\p{M}]*)*"
_DIGITS = r"\p{Nd}+(?:[.,;''‘’]\p{Nd}+)*"


def tokens(column: str) -> str:
    return f"regexp_extract_all(lower({column}), '\\p{{Pc}}*(?:{_LETTERS}|{_DIGITS})(?:\\p{{Pc}}*(?:{_LETTERS}|{_DIGITS}))*\\p{{Pc}}*')"


@query("f01_term", f"WITH {LOGS} SELECT id, application, level FROM logs WHERE level = 'ERROR'")
def term(spark, sf):
    return logs(spark, sf).filter(P.term("level", "ERROR")).select("id", "application", "level")


@query(
    "f02_match",
    f"SELECT CAST(doc_id AS VARCHAR) AS id FROM documents WHERE list_has_any({tokens('text')}, ['the', 'license'])",
)
def match(spark, sf):
    return search_documents(spark, sf).filter(P.match("message", "The license")).select("id")


@query(
    "f03_search",
    f"""WITH {LOGS}, t AS (SELECT id, concat_ws(' ', category, level, message, "threadName", throwable, hostname) AS text
        FROM logs)
        SELECT id FROM t WHERE list_has_any({tokens('text')}, ['purchase', 'host3', 'exception'])""",
)
def search(spark, sf):
    return logs(spark, sf).filter(P.search("purchase HOST3 exception")).select("id")


@query(
    "f04_phrase",
    f"""SELECT CAST(doc_id AS VARCHAR) AS id FROM documents
        WHERE contains(' ' || array_to_string({tokens('text')}, ' ') || ' ', ' of the ')""",
)
def phrase(spark, sf):
    return search_documents(spark, sf).filter(P.phrase("message", "OF the")).select("id")


@query(
    "f05_time_range",
    f"""WITH {LOGS} SELECT id, epoch_us(ts) AS ts_us FROM logs
        WHERE ts >= {SQL_NOW} - INTERVAL 24 HOUR AND ts <= {SQL_NOW}""",
)
def time_range(spark, sf):
    hit = P.time_range("ts", "NOW-24HOURS", "NOW", NOW)
    return logs(spark, sf).filter(hit).select("id", F.unix_micros("ts").alias("ts_us"))


def stored_documents(spark, sf):
    """``search_documents`` as stored logs in several files, each with rows of one language.

    There are as many files as the table has splits to read, six at least: a task writes, and later reads, a split's
    worth of rows however large the table grows.
    """
    path = shared_dir(spark, "documents")
    documents = search_documents(spark, sf)
    files = max(6, documents.rdd.getNumPartitions())
    documents.repartitionByRange(files, "category", "id").write.parquet(path)
    return spark.read.parquet(path)


@query(
    "f02_match_pruned",
    f"SELECT CAST(doc_id AS VARCHAR) AS id FROM documents WHERE list_has_any({tokens('text')}, ['the', 'license'])",
)
def match_pruned(spark, sf):
    stored, path = stored_documents(spark, sf), shared_dir(spark, "words")
    index_files(stored, path)
    files = pruned(stored, read_sidecar(spark, path), "The license")
    return files.filter(P.match("message", "The license")).select("id")


@query(
    "f04_phrase_pruned",
    f"""SELECT CAST(doc_id AS VARCHAR) AS id FROM documents
        WHERE contains(' ' || array_to_string({tokens('text')}, ' ') || ' ', ' of the ')""",
)
def phrase_pruned(spark, sf):
    stored, path = stored_documents(spark, sf), shared_dir(spark, "words")
    index_files(stored, path)
    files = pruned(stored, read_sidecar(spark, path), "OF the", every=True)
    return files.filter(P.phrase("message", "OF the")).select("id")


@query("f06_num_range", f"WITH {LOGS} SELECT id, CAST(k AS INT) AS k FROM logs WHERE CAST(k AS INT) BETWEEN 10 AND 20")
def num_range(spark, sf):
    k = F.col("ints")["k_i"]
    return typed_fields(logs(spark, sf)).filter(P.num_range(k, 10, 20)).select("id", k.alias("k"))


@query("f06_variant_range", f"WITH {LOGS} SELECT id, CAST(k AS INT) AS k FROM logs WHERE CAST(k AS INT) BETWEEN 10 AND 20")
def variant_range(spark, sf):
    path = shared_dir(spark, "variants")
    variant_fields(logs(spark, sf)).select("id", "attributes").write.parquet(path)
    k = variant_field("k_i")
    return spark.read.parquet(path).filter(P.num_range(k, 10, 20)).select("id", k.alias("k"))


@query(
    "f07_boolean",
    f"""WITH {LOGS} SELECT id FROM logs
        WHERE level = 'ERROR' AND (hostname = 'host1' OR hostname = 'host2') AND NOT ("threadName" = 'thread-3')""",
)
def boolean(spark, sf):
    hosts = P.any_of(P.term("hostname", "host1"), P.term("hostname", "host2"))
    hit = P.all_of(P.term("level", "ERROR"), hosts, P.negate(P.term("threadName", "thread-3")))
    return logs(spark, sf).filter(hit).select("id")


@query("f08_match_all", f"WITH {LOGS} SELECT count(*) AS n FROM logs")
def match_all(spark, sf):
    return logs(spark, sf).filter(P.match_all()).agg(F.count("*").alias("n"))


@query(
    "f09_exists_prefix_wildcard",
    f"""WITH {LOGS}
        SELECT id, throwable IS NOT NULL AS has_throwable, throwable IS NULL AS no_throwable,
               starts_with(category, 'events.p') AS prefixed, "threadName" LIKE 'thread-_' AND hostname LIKE '%t1'
                 AS wild
        FROM logs""",
)
def exists_prefix_wildcard(spark, sf):
    return logs(spark, sf).select(
        "id",
        P.exists("throwable").alias("has_throwable"),
        P.missing("throwable").alias("no_throwable"),
        P.prefix("category", "events.p").alias("prefixed"),
        (P.wildcard("threadName", "thread-?") & P.wildcard("hostname", "*t1")).alias("wild"),
    )


@query(
    "f10_get_by_id",
    f"""WITH {LOGS} SELECT id, message FROM logs
        WHERE id IN (SELECT CAST(doc_id AS VARCHAR) FROM labels WHERE toxic = 1) OR id IN ('3', '5')""",
)
def get_by_id(spark, sf):
    wanted = table(spark, sf, "labels").filter("toxic = 1").select(F.col("doc_id").cast("string").alias("id"))
    df = logs(spark, sf).select("id", "message")
    listed = D.get_by_id(df, ["3", "5"])
    return D.get_by_id(df, wanted).unionByName(listed).distinct()


@query(
    "f10_get_by_id_stored",
    f"""WITH {LOGS} SELECT id, message FROM logs WHERE id IN (SELECT CAST(event_id AS VARCHAR) FROM events ORDER BY event_id DESC LIMIT 3)""",
)
def get_by_id_stored(spark, sf):
    """Look-up in stored logs, whose row groups have Bloom filters on the id."""
    path = shared_dir(spark, "logs")
    write_logs(logs(spark, sf).withColumn("collection", F.concat("application", F.lit("_0"))), path)
    newest = table(spark, sf, "events").orderBy(F.desc("event_id")).limit(3).collect()
    return D.get_by_id(spark.read.parquet(path), [str(r["event_id"]) for r in newest]).select("id", "message")


@query(
    "f14_level_at_least",
    f"WITH {LOGS} SELECT level, count(*) AS n FROM logs WHERE level IN ('WARN', 'ERROR', 'FATAL') GROUP BY level",
)
def level_at_least(spark, sf):
    return logs(spark, sf).filter(P.level_at_least("warn")).groupBy("level").agg(F.count("*").alias("n"))


@query(
    "p03_catch_all_text",
    f"""WITH {LOGS} SELECT id, concat_ws(' \ua7f7 ', category, level, message, "threadName", throwable, hostname) AS text
        FROM logs""",
)
def catch_all(spark, sf):
    return logs(spark, sf).select("id", catch_all_text().alias("text"))


@query(
    "p04_tokenize",
    f"""WITH t AS (SELECT unnest({tokens('text')}) AS token FROM documents)
        SELECT token, count(*) AS n FROM t GROUP BY token""",
)
def token_counts(spark, sf):
    token = F.explode(tokenize("message")).alias("token")
    return search_documents(spark, sf).select(token).groupBy("token").agg(F.count("*").alias("n"))


ORDER_TEXT = """'Can''t pay ' || CAST(o_totalprice AS DECIMAL(18,2)) || ' for foo_bar_' || o_orderkey || ', ' || o_orderpriority
    || ';o.k:' || o_orderstatus || ' 1,' || o_custkey || '. __ ' || o_custkey || '.' || o_orderstatus"""


@query(
    "p04_word_breaks",
    f"""WITH t AS (SELECT unnest({tokens('text')}) AS token FROM (SELECT {ORDER_TEXT} AS text FROM orders))
        SELECT token, count(*) AS n FROM t GROUP BY token""",
)
def word_breaks(spark, sf):
    text = F.concat(
        F.lit("Can't pay "), F.col("o_totalprice").cast("decimal(18,2)").cast("string"), F.lit(" for foo_bar_"), "o_orderkey",
        F.lit(", "), "o_orderpriority", F.lit(";o.k:"), "o_orderstatus", F.lit(" 1,"), "o_custkey", F.lit(". __ "), "o_custkey",
        F.lit("."), "o_orderstatus",
    )
    token = F.explode(tokenize(text)).alias("token")
    return table(spark, sf, "orders").select(token).groupBy("token").agg(F.count("*").alias("n"))


@query(
    "s_conversation_search",
    f"""SELECT role AS category, count(*) AS n FROM conversations
        WHERE list_has_any({tokens('text')}, ['what', 'die', 'le']) GROUP BY role""",
)
def conversation_search(spark, sf):
    df = table(spark, sf, "conversations").filter(P.match("text", "what die le"))
    return df.groupBy(F.col("role").alias("category")).agg(F.count("*").alias("n"))


SEARCHES = {"licence": "the license of", "rest": "que die", "nothing": "qqqq"}


@query(
    "l01_by_relevance",
    f"""WITH q(search, term) AS (VALUES ('licence', 'the'), ('licence', 'license'), ('licence', 'of'), ('rest', 'que'),
               ('rest', 'die'), ('nothing', 'qqqq')),
             d AS (SELECT source AS application, CAST(doc_id AS VARCHAR) AS id, {tokens('text')} AS words FROM documents),
             s AS (SELECT application, count(*) AS documents, sum(len(words)) AS total FROM d WHERE len(words) > 0 GROUP BY application),
             t AS (SELECT application, id, len(words) AS length, unnest(words) AS term FROM d),
             f AS (SELECT application, id, length, term, count(*) AS tf FROM t SEMI JOIN q USING (term) GROUP BY ALL),
             n AS (SELECT application, term, count(*) AS df FROM f GROUP BY ALL),
             r AS (SELECT application, search, id, round(sum(ln(1 + (documents - df + 0.5) / (df + 0.5)) * tf * 2.2
                          / (tf + 1.2 * (0.25 + 0.75 * length / (total / documents)))), 9) AS score
                   FROM f JOIN q USING (term) JOIN n USING (application, term) JOIN s USING (application) GROUP BY ALL)
        SELECT application, search, id, round(score, 6) AS score,
               CAST(row_number() OVER (PARTITION BY application, search ORDER BY score DESC, id) AS INT) AS rank
        FROM r QUALIFY rank <= 10""",
)
def by_relevance(spark, sf):
    found = most_relevant(search_documents(spark, sf), SEARCHES)
    return found.withColumn("score", F.round("score", 6))


@query(
    "l02_newest_first",
    f"WITH {LOGS} SELECT id, epoch_us(ts) AS ts_us FROM logs ORDER BY ts DESC, id LIMIT 100",
)
def newest_first(spark, sf):
    return D.newest_first(logs(spark, sf), 100).select("id", F.unix_micros("ts").alias("ts_us"))
