"""Secret scans over a ledger of content-addressed blobs."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loglake.llm.common import body, spread_join


@dataclass(frozen=True)
class Rule:
    """Matches of ``pattern`` (leftmost, not overlapping) whose ``group`` has ``least`` characters or more.

    A change of the pattern needs a new ``version``, so that the ledger knows what has not been scanned yet.
    """

    kind: str
    pattern: str
    group: int = 0
    least: int = 0
    version: int = 1

    @property
    def name(self) -> str:
        return f"{self.kind}@{self.version}"


#: The three base kinds and two more, in order of kind. Where a whole run is too short none of its ends is long enough,
#: so ``access`` and ``hex`` have their least length in the pattern.
BASE = (
    Rule(
        "assign",
        r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
        group=2,
        least=6,
    ),
    Rule("access", r"AKIA[A-Z0-9]{16,}"),
    Rule("hex", r"[0-9a-f]{24,}"),
)
RULES = (
    *BASE,
    Rule("pem", r"-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----"),
    Rule("bearer", r"[Bb]earer\x20+[A-Za-z0-9._~+/-]{16,}"),
)

SPANS = "array<struct<start:int,kind:int,end:int>>"


def blob(text: str = "text") -> Column:
    """The address of a text's content."""
    return F.sha2(body(text), 256)


def _matches(text: Column, rule: Rule, number: int) -> Column:
    """``(kind, gap, match, part)`` lengths of every match of ``rule``, in order; empty without one."""
    found = F.arrays_zip(
        F.split(text, rule.pattern, -1).alias("gap"),
        F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(0)).alias("match"),
        F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(rule.group)).alias("part"),
    )
    lengths = F.transform(
        F.filter(found, lambda x: x["match"].isNotNull()),
        lambda x: F.struct(
            F.lit(number).alias("kind"),
            F.length(x["gap"]).alias("gap"),
            F.length(x["match"]).alias("match"),
            F.length(x["part"]).alias("part"),
        ),
    )
    none = F.array().cast("array<struct<kind:int,gap:int,match:int,part:int>>")
    return F.when(text.rlike(rule.pattern), lengths).otherwise(none)


def unseen(docs: DataFrame, ledger: DataFrame | None, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """``blob, body, todo``: each distinct content with the rule versions that the ledger does not have for it."""
    names = F.array(*(F.lit(r.name) for r in rules))
    blobs = docs.select(blob().alias("blob"), body().alias("body")).groupBy("blob").agg(F.first("body").alias("body"))
    if ledger is None:
        return blobs.withColumn("todo", names)
    seen = ledger.select("blob", F.explode("scanned").alias("pair")).groupBy("blob").agg(
        F.collect_set("pair").alias("pairs")
    )
    nothing = F.array().cast("array<string>")
    left = blobs.join(seen, "blob", "left").withColumn(
        "todo", F.array_except(names, F.coalesce("pairs", nothing))
    )
    return left.where(F.size("todo") > 0).select("blob", "body", "todo")


def scan(blobs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Ledger rows ``blob, scanned, spans`` for the unseen blobs; spans are in code points, the end exclusive.

    Lengths of gaps and matches leave the text behind; a running sum over them, which many matches only make longer,
    gives the places.
    """
    per_rule = [
        F.when(F.array_contains("todo", r.name), _matches(F.col("body"), r, i)).otherwise(
            F.array().cast("array<struct<kind:int,gap:int,match:int,part:int>>")
        )
        for i, r in enumerate(rules)
    ]
    found = blobs.select("blob", F.col("todo").alias("scanned"), F.flatten(F.array(*per_rule)).alias("found"))
    placed = found.select("blob", "scanned", F.posexplode_outer("found").alias("at", "m")).select(
        "blob", "scanned", "at", "m.*"
    )
    order = Window.partitionBy("blob", "kind").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    end = F.sum(F.col("gap") + F.col("match")).over(order).cast("int")
    least = F.element_at(F.array(*(F.lit(r.least) for r in rules)), F.col("kind") + 1)
    span = F.when(F.col("part") >= least, F.struct((F.col("end") - F.col("match")).alias("start"), "kind", "end"))
    ends = placed.withColumn("end", end)
    return ends.groupBy("blob").agg(
        F.first("scanned").alias("scanned"), F.sort_array(F.collect_list(span)).cast(SPANS).alias("spans")
    )


def scan_into(docs: DataFrame, path: str, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Scans what the ledger at ``path`` lacks for ``docs``, appends it there and returns the ledger.

    A run that dies leaves the ledger as it was, and the next one scans the same blobs again.
    """
    spark = docs.sparkSession
    kind = f"blob string, scanned array<string>, spans {SPANS}"
    spark.createDataFrame([], kind).write.mode("append").parquet(path)  # so that there is one to read
    ledger = spark.read.schema(kind).parquet(path)
    before = None if not ledger.limit(1).count() else ledger
    scan(unseen(docs, before, rules), rules).write.mode("append").parquet(path)
    return spark.read.schema(kind).parquet(path)


def findings(docs: DataFrame, ledger: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """``doc_id, spans`` for every row of ``docs``: what the ledger has on its content for the ``rules``.

    One content may be a third of all rows: the join is spread over salts of the id. Null texts have the empty content
    and no spans, as have texts the ledger does not know. Rows that repeat come back as often as they come.
    """
    names = F.array(*(F.lit(r.name) for r in rules))
    wanted = ledger.where(F.arrays_overlap("scanned", names)).select("blob", F.explode_outer("spans").alias("span"))
    spans = wanted.groupBy("blob").agg(F.sort_array(F.collect_set("span")).alias("spans"))
    rows = docs.select("doc_id", blob().alias("blob"))
    none = F.array().cast(SPANS)
    return spread_join(rows, spans, "blob", ["doc_id"]).select("doc_id", F.coalesce("spans", none).alias("spans"))


def as_text(spans: Column, rules: tuple[Rule, ...] = RULES) -> Column:
    """``kind:start:end`` of each span, comma-joined."""
    kinds = F.array(*(F.lit(r.kind) for r in rules))
    parts = F.transform(
        spans, lambda x: F.concat_ws(":", F.get(kinds, x["kind"]), x["start"].cast("string"), x["end"].cast("string"))
    )
    return F.array_join(parts, ",")
