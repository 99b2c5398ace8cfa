"""The operators' queries over the test tables, and their SQL twins where SQL can express them."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loglake.llm import language_id, quality_classifier, secrets
from loglake.llm.common import documents, shared_dir, stored
from loglake.llm.exact_dedup import exact_dedup
from loglake.llm.lexical_search import search
from loglake.llm.lm_score import lm_score
from loglake.llm.mixing import mix
from loglake.llm.near_dedup import near_dedup
from loglake.llm.packing import pack, pieces
from loglake.llm.phrases import collocations
from loglake.llm.quality_rules import quality_rules
from loglake.llm.surrogates import replace_personal_data
from loglake.llm.training_order import training_order

#: Keys of the permutation and of the surrogates; a user passes secret ones.
ORDER_KEY, SURROGATE_KEY = 20_240_229, "example key"


def tokenizer() -> str:
    return str(public_tokenizers.path("byte_bpe_50k.json"))


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(documents(spark, sf_dir))


def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    found = secrets.findings(docs, secrets.scan_into(docs, shared_dir(spark)))
    of = lambda i: F.filter("spans", lambda x: x["kind"] == i)
    base = F.filter("spans", lambda x: x["kind"] < len(secrets.BASE))
    return found.select(
        "doc_id",
        *(F.size(of(i)).cast("long").alias(f"n_{r.kind}") for i, r in enumerate(secrets.BASE)),
        F.sha2(secrets.as_text(base), 256).alias("base_sha256"),
        secrets.as_text(F.col("spans")).alias("spans"),
    )


def op3_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(documents(spark, sf_dir)).select("doc_id", "size", "source_size", "target", "copies", "taken")


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(documents(spark, sf_dir), labels(spark, sf_dir))


def op5_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = pieces(documents(spark, sf_dir), tokenizer()).withColumn("ids_crc32", F.crc32("ids")).drop("ids")
    return pack(stored(parts))


def op6_training_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return training_order(documents(spark, sf_dir), tokenizer(), ORDER_KEY)


def op7_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup(documents(spark, sf_dir))


def op8_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_score(documents(spark, sf_dir))


def op9_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    held = quality_classifier.held_out(F.col("doc_id"), 5)
    model = quality_classifier.fit(docs.where(~held), labels(spark, sf_dir).where(~held))
    scored = quality_classifier.classify(docs, model)
    return scored.select("doc_id", held.alias("held_out"), "score", "predicted")


def op10_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    replaced = replace_personal_data(documents(spark, sf_dir), SURROGATE_KEY)
    kinds = F.transform("entities", lambda x: F.concat_ws(":", x["type"], x["replacement"]))
    return replaced.withColumn("entities", F.array_join(kinds, ","))


def op11_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    held = language_id.held_out(F.col("doc_id"))
    told = language_id.predict(docs, language_id.fit(docs.where(~held)))
    return told.select("doc_id", held.alias("held_out"), "lang_pred", "score")


def op12_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(documents(spark, sf_dir))


def op13_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_exact_dedup,
        op2_secret_scan,
        op3_mix_sources,
        op4_quality_rules,
        op5_pack,
        op6_training_order,
        op7_near_dedup,
        op8_lm_score,
        op9_quality_classifier,
        op10_surrogates,
        op11_language_id,
        op12_phrases,
        op13_lexical_search,
    )
}


def _spans_sql() -> str:
    """Matches of every rule: gaps and matches take turns, so their lengths add up to places."""
    parts = []
    for number, rule in enumerate(secrets.RULES):
        pattern = rule.pattern.replace("'", "''")
        parts.append(f"""
            SELECT doc_id, {number} AS kind, '{rule.kind}' AS name, {rule.least} AS least,
                   list_transform(regexp_split_to_array(body, '{pattern}'), lambda x: length(x)) AS gaps,
                   list_transform(regexp_extract_all(body, '{pattern}', 0), lambda x: length(x)) AS hits,
                   list_transform(regexp_extract_all(body, '{pattern}', {rule.group}), lambda x: length(x)) AS parts
            FROM d WHERE regexp_matches(body, '{pattern}')""")
    return " UNION ALL ".join(parts)


ORACLES = {
    "op1_exact_dedup": """
        WITH d AS (SELECT doc_id, coalesce(text, '') AS body FROM documents),
             g AS (SELECT body, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY body)
        SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(body) AS text_sha256
        FROM d JOIN g USING (body)
    """,
    "op2_secret_scan": f"""
        WITH d AS (SELECT doc_id, coalesce(text, '') AS body FROM documents),
             m AS ({_spans_sql()}),
             e AS (SELECT *, unnest(range(1, len(hits) + 1)) AS i FROM m),
             s AS (SELECT doc_id, kind, name, parts[i] AS part, least,
                          list_sum(gaps[1:i]) + coalesce(list_sum(hits[1:i - 1]), 0) AS start, hits[i] AS size
                   FROM e),
             t AS (SELECT doc_id, kind, CAST(start AS BIGINT) AS start,
                          name || ':' || CAST(start AS BIGINT) || ':' || CAST(start + size AS BIGINT) AS span
                   FROM s WHERE part >= least),
             a AS (SELECT doc_id, count(*) FILTER (kind = 0) AS n_assign, count(*) FILTER (kind = 1) AS n_access,
                          count(*) FILTER (kind = 2) AS n_hex,
                          string_agg(span, ',' ORDER BY start, kind) FILTER (kind < 3) AS base,
                          string_agg(span, ',' ORDER BY start, kind) AS spans
                   FROM t GROUP BY doc_id)
        SELECT d.doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access,
               coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
        FROM d LEFT JOIN a USING (doc_id)
    """,
    "op12_phrases": """
        WITH p AS (SELECT coalesce(lang, 'und') AS lang, doc_id, unnest(regexp_split_to_array(
                     translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                     '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
             w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS words FROM p),
             t AS (SELECT lang, CAST(sum(len(words)) AS BIGINT) AS n FROM w GROUP BY lang),
             g AS (SELECT lang, size, unnest(list_transform(range(1, len(words) - size + 2),
                          lambda i: array_to_string(words[i:i + size - 1], ' '))) AS phrase
                   FROM w, (SELECT unnest([1, 2, 3, 4]) AS size) WHERE len(words) >= size),
             f AS (SELECT lang, size, phrase, count(*) AS f FROM g GROUP BY ALL HAVING count(*) >= 30),
             c AS (SELECT lang, size, phrase, f AS a, string_split(phrase, ' ') AS words, unnest(range(1, size)) AS k
                   FROM f WHERE size > 1),
             s AS (SELECT c.lang, c.size, c.phrase, a, k, x.f AS l, y.f AS r,
                          CAST(CAST(2000000 AS HUGEINT) * a // (x.f + y.f) AS BIGINT) AS score
                   FROM c JOIN f x ON x.lang = c.lang AND x.phrase = array_to_string(words[1:k], ' ')
                          JOIN f y ON y.lang = c.lang AND y.phrase = array_to_string(words[k + 1:], ' ')),
             b AS (SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) AS cut FROM s),
             i AS (SELECT lang, f, words, length, unnest(range(1, size - length + 2)) AS place
                   FROM (SELECT lang, f, size, string_split(phrase, ' ') AS words, unnest(range(2, size)) AS length
                         FROM f WHERE size > 2)),
             m AS (SELECT lang, array_to_string(words[place:place + length - 1], ' ') AS phrase, max(f) AS longer
                   FROM i GROUP BY ALL),
             o AS (SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, encode(phrase)) AS rank,
                          phrase, a, l, r, score
                   FROM b LEFT JOIN m USING (lang, phrase)
                   WHERE cut = 1 AND (longer IS NULL OR CAST(100 AS HUGEINT) * longer < CAST(80 AS HUGEINT) * a))
        SELECT lang, rank, phrase, a, l, r, n, score FROM o JOIN t USING (lang) WHERE rank <= 2000
    """,
    "op13_lexical_search": """
        WITH d AS (SELECT row_number() OVER () AS doc, doc_id, regexp_extract_all(
                     translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                     '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS terms FROM documents),
             s AS (SELECT count(*) AS big_n, CAST(sum(len(terms)) AS BIGINT) AS big_l FROM d WHERE len(terms) > 0),
             p AS (SELECT doc, doc_id, term, n, count(*) AS tf
                   FROM (SELECT doc, doc_id, len(terms) AS n, unnest(terms) AS term FROM d) GROUP BY ALL),
             q AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(
                     translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                     '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark),
             w AS (SELECT term, CAST(floor(1000 * ln((2 * any_value(big_n) + 2) / (2 * count(*) + 1))) AS BIGINT) AS w
                   FROM p, s GROUP BY term),
             r AS (SELECT item_id, doc, doc_id, CAST(sum(w * ((1000000000 * tf)
                          // (1000 * tf + 8 * (100 - 90 + (90 * n * big_n) // big_l)))) AS BIGINT) AS score
                   FROM q JOIN p USING (term) JOIN w USING (term), s GROUP BY item_id, doc, doc_id),
             o AS (SELECT item_id, doc_id, score,
                          CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INT) AS rank
                   FROM r WHERE score > 0)
        SELECT item_id, rank, doc_id, score FROM o WHERE rank <= 10
    """,
}
