"""Personal data replaced by keyed surrogates that keep type, script, gender and format."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loglake.llm.common import body, spread_join, stored

#: Rounds of drawing anew after a collision. Where entities of a type are too many for its format, as with numbers of
#: few digits, the last round may leave some, and then nothing is released.
ROUNDS = 20
#: Types of entities, in the order in which a match is asked for them.
TYPES = ("email", "name", "ip", "ssn", "phone", "card")

_TITLES = {
    "male": ("Mr", "Herr", "Herrn", "Monsieur", "Señor", "Sr", "Господин"),
    "female": ("Mrs", "Ms", "Miss", "Frau", "Madame", "Mme", "Mlle", "Señora", "Sra", "Госпожа"),
    "any": ("Dr", "Prof"),
}
_GIVEN = {
    "male": ("Adam", "Bruno", "Carl", "David", "Emil", "Felix", "Henry", "Ivan", "Jonas", "Leon", "Martin", "Oscar"),
    "female": ("Alma", "Bella", "Clara", "Diana", "Elena", "Flora", "Helen", "Irene", "Julia", "Lena", "Maria", "Nora"),
    "any": ("Alex", "Charlie", "Eden", "Jamie", "Kim", "Luca", "Noa", "Robin", "Sam", "Sascha", "Toni", "Yael"),
    "male Cyrillic": ("Антон", "Борис", "Виктор", "Глеб", "Денис", "Иван", "Кирилл", "Максим"),
    "female Cyrillic": ("Анна", "Вера", "Дарья", "Елена", "Ирина", "Мария", "Нина", "Ольга"),
}
_TITLE = "|".join(t for titles in _TITLES.values() for t in titles)
_SYLLABLES = {
    "Latin": ("ba", "de", "fi", "go", "ka", "lo", "mi", "ra", "se", "tu", "ve", "wi"),
    "Cyrillic": ("ба", "ве", "го", "ду", "ки", "ла", "ме", "ро"),
}
_OCTET = r"(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
PATTERNS = {
    "email": r"(?<![\p{L}\p{N}._%+-])[\p{L}\p{N}._%+-]++@[\p{L}\p{N}-]+(?:\.[\p{L}\p{N}-]+)+",
    "name": rf"(?<!\p{{L}})(?:{_TITLE})\.?\x20\p{{Lu}}\p{{Ll}}+(?:\x20\p{{Lu}}\p{{Ll}}+)?",
    "ip": rf"(?<![\p{{L}}\p{{N}}.])(?:{_OCTET}\.){{3}}{_OCTET}(?![\p{{L}}\p{{N}}]|\.[0-9])",
    "ssn": r"(?<![\p{L}\p{N}-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![\p{L}\p{N}-])",
    "phone": r"(?<![\p{L}\p{N}])(?:\+1[\x20.-]?(?:\([0-9]{3}\)|[0-9]{3})[\x20.-]?[0-9]{3}[\x20.-]?[0-9]{4}"
    r"|\+(?=(?:[\x20.()-]{0,2}[0-9]){7})[0-9]{1,3}[\x20.-]?(?:\([0-9]{1,4}\)|[0-9]{1,4})(?:[\x20.-]?[0-9]{1,4}){1,6}"
    r"|\+[0-9]{1,3}[\x20.-]?(?:\([0-9]{2,4}\)|[0-9]{2,4})(?:[\x20.-]?[0-9]{2,4}){1,3}"
    r"|\([0-9]{3}\)\x20?[0-9]{3}-[0-9]{4}|[0-9]{3}-[0-9]{3}-[0-9]{4})(?![\p{L}\p{N}])",
    "card": r"(?<![\p{L}\p{N}])[0-9](?:[\x20-]?[0-9]){12,18}(?![\p{L}\p{N}])",
}
PATTERN = "|".join(f"(?:{PATTERNS[t]})" for t in TYPES)
#: What every match has: texts without it are passed over.
HINT = rf"@|\+[0-9]|[0-9]{{3}}|[0-9]\.[0-9]|[0-9](?:[\x20-]?[0-9]){{12}}|(?:{_TITLE})\.?\x20"

_HEX = "0123456789abcdef"
_LETTERS = {"[a-z]": "bcdfghklmnprstvw", r"\p{IsCyrillic}": "бвгдзклмнпрстфхц", r"\p{IsGreek}": "βγδζθκλμνξπρστφχ"}


def type_of(match: Column) -> Column:
    """The first type whose pattern is the whole match."""
    out = F.lit(TYPES[-1])
    for t in reversed(TYPES[:-1]):
        plain = PATTERNS[t]
        out = F.when(match.rlike(rf"^(?:{plain})$"), F.lit(t)).otherwise(out)
    return out


def identity(kind: Column, match: Column) -> Column:
    """What two mentions of one entity have in common: digits, a lower-case address, or a name with its gender."""
    digits = F.regexp_replace(match, "[^0-9]", "")
    bare = F.regexp_replace(match, rf"^(?:{_TITLE})\.?\x20", "")
    gender = F.lit("any")
    for g in ("male", "female"):
        gender = F.when(match.rlike(rf"^(?:{'|'.join(_TITLES[g])})\.?\x20"), F.lit(g)).otherwise(gender)
    return (
        F.when(kind == "email", F.lower(match))
        .when(kind == "ip", match)
        .when(kind == "name", F.concat_ws("/", gender, bare))
        .otherwise(digits)
    )


def _stream(seed: Column) -> Column:
    """128 hex digits of a keyed hash."""
    return F.concat(F.sha2(seed, 256), F.sha2(F.concat(seed, F.lit("+")), 256))


def _like(text: Column, stream: Column) -> Column:
    """A text of the same shape: letters of the same script, digits for digits, the rest as it is."""
    drawn = lambda i: F.substring(stream, (i % 128) + 1, F.lit(1))

    def one(c: Column, i: Column) -> Column:
        out = F.when(c.rlike("[0-9]"), F.translate(drawn(i), "abcdef", "012345"))
        for script, letters in _LETTERS.items():
            out = out.when(c.rlike(script), F.translate(drawn(i), _HEX, letters))
        return out.when(c.rlike(r"\p{L}"), F.translate(drawn(i), _HEX, _LETTERS["[a-z]"])).otherwise(c)

    return F.array_join(F.transform(F.filter(F.split(text, ""), lambda c: c != ""), one), "")


def _pick(choices: tuple[str, ...], stream: Column, at: int) -> Column:
    number = F.conv(F.substring(stream, at, 4), 16, 10).cast("int")
    return F.element_at(F.array(*map(F.lit, choices)), number % len(choices) + 1)


def surrogate(kind: Column, value: Column, seed: Column) -> Column:
    """A replacement for an identity, drawn from a keyed seed: an identity of the same type."""
    s = _stream(seed)
    digits = F.concat(F.substring(value, 1, 1), F.substring(_like(value, s), F.lit(2), F.length(value)))
    octet = lambda at: (F.conv(F.substring(s, at, 4), 16, 10).cast("int") % 254 + 1).cast("string")
    local = F.substring_index(value, "@", 1)
    email = F.concat(_like(local, s), F.lit("@"), _like(F.lit("aaaaaaaa"), F.reverse(s)), F.lit(".example"))
    gender, bare = F.substring_index(value, "/", 1), F.substring_index(value, "/", -1)
    cyrillic = bare.rlike(r"\p{IsCyrillic}")
    given = F.lit(None).cast("string")
    for g, names in _GIVEN.items():
        of, script = g.partition(" ")[::2]
        fits = (gender == of) & (cyrillic if script else ~cyrillic)
        given = F.when(fits, _pick(names, s, 9)).otherwise(given)
    given = F.coalesce(given, _pick(_GIVEN["male Cyrillic"], s, 9))
    parts = lambda choices: F.concat(*(_pick(choices, s, at) for at in (13, 17, 21)))
    family = F.initcap(
        F.when(cyrillic, F.concat(parts(_SYLLABLES["Cyrillic"]), F.lit("в"))).otherwise(
            F.concat(parts(_SYLLABLES["Latin"]), F.lit("n"))
        )
    )
    name = F.concat(gender, F.lit("/"), F.when(F.instr(bare, " ") > 0, F.concat(given, F.lit(" "), family)).otherwise(family))
    return (
        F.when(kind == "email", email)
        .when(kind == "ip", F.concat_ws(".", octet(1), octet(5), octet(9), octet(13)))
        .when(kind == "name", name)
        .otherwise(digits)
    )


def longer(kind: Column, drawn: Column, seed: Column, more: int) -> Column:
    """What is drawn, with ``more`` syllables at the end of a surname, so that there are names for all."""
    if not more:
        return drawn
    s = F.reverse(_stream(seed))
    cyrillic = drawn.rlike(r"\p{IsCyrillic}")
    ends = (F.concat(*(_pick(_SYLLABLES[x], s, 1 + 4 * i) for i in range(more))) for x in ("Cyrillic", "Latin"))
    return F.when(kind == "name", F.concat(drawn, F.when(cyrillic, next(ends)).otherwise(next(ends)))).otherwise(drawn)


def render(kind: Column, match: Column, drawn: Column) -> Column:
    """The replacement in the form of a mention: its separators, its case, its title."""
    chars = F.filter(F.split(match, ""), lambda c: c != "")
    nth = lambda i: F.length(F.regexp_replace(F.substring(match, F.lit(1), i + 1), "[^0-9]", ""))
    laid = F.array_join(
        F.transform(chars, lambda c, i: F.when(c.rlike("[0-9]"), F.substring(drawn, nth(i), F.lit(1))).otherwise(c)), ""
    )
    upper = (F.upper(match) == match) & (F.lower(match) != match)
    title = F.regexp_extract(match, rf"^(?:{_TITLE})\.?\x20", 0)
    return (
        F.when(kind == "email", F.when(upper, F.upper(drawn)).otherwise(drawn))
        .when(kind == "ip", drawn)
        .when(kind == "name", F.concat(title, F.substring_index(drawn, "/", -1)))
        .otherwise(laid)
    )


def draw(entities: DataFrame, key: str) -> DataFrame:
    """``type, value, drawn`` for every distinct entity; drawn identities are distinct and are nobody's own.

    Of entities that draw the same one keeps it, and none keeps what is itself an entity of the corpus; the others
    draw again with the next round's seed, surnames with one more syllable a round: their space grows eightfold at
    least, so that rounds end however many names there are.
    """
    real = entities.select("type", F.col("value").alias("drawn"))
    taken, rest = None, entities
    for round_ in range(ROUNDS):
        seed = F.concat_ws("\u0001", F.lit(key), F.lit(str(round_)), "type", "value")
        drawn = longer(F.col("type"), surrogate(F.col("type"), F.col("value"), seed), seed, round_)
        tried = stored(rest.withColumn("drawn", drawn))
        firsts = tried.groupBy("type", "drawn").agg(F.min("value").alias("value"))
        firsts = firsts.join(real, ["type", "drawn"], "left_anti")
        if taken is not None:
            firsts = firsts.join(taken.select("type", "drawn"), ["type", "drawn"], "left_anti")
        won = stored(firsts.select("type", "value", "drawn"))
        taken = won if taken is None else taken.unionByName(won)
        rest = tried.drop("drawn").join(won, ["type", "value"], "left_anti")
        if not rest.limit(1).count():
            return taken
    raise ValueError(f"surrogates still collide after {ROUNDS} rounds: use longer ones")


def replace_personal_data(docs: DataFrame, key: str) -> DataFrame:
    """``doc_id, text, entities, n_<type>`` for every row, with every detected entity replaced in its whole text.

    ``entities`` lists ``(type, original, replacement)`` in order of place. One identity gets one replacement wherever
    it occurs, in the form of each mention; two identities never get the same one; no replacement is an identity that
    occurs. Depends on the key and the set of entities only. Null texts stay null, texts without entities are as they
    were. Repeated rows and equal texts get equal results. Empty input gives an empty result.
    """
    text = body()
    none = F.array().cast("array<string>")
    matches = F.when(text.rlike(HINT), F.regexp_extract_all(text, F.lit(PATTERN), F.lit(0))).otherwise(none)
    blob = F.sha2(text, 256)
    found = docs.select(blob.alias("blob"), matches.alias("matches")).where(F.size("matches") > 0)
    found = stored(found.groupBy("blob").agg(F.first("matches").alias("matches")))
    mentions = found.select("blob", F.posexplode("matches").alias("at", "match"))
    mentions = mentions.withColumn("type", type_of(F.col("match")))
    mentions = mentions.withColumn("value", identity(F.col("type"), F.col("match")))
    drawn = draw(stored(mentions.select("type", "value").distinct()), key)
    named = mentions.withColumn("entity", F.concat_ws("/", "type", "value"))
    drawn = drawn.select(F.concat_ws("/", "type", "value").alias("entity"), "drawn")
    replaced = spread_join(named, drawn, "entity", ["blob", "at"]).select(
        "blob",
        F.struct(
            "at", "type", F.col("match").alias("original"),
            render(F.col("type"), F.col("match"), F.col("drawn")).alias("replacement"),
        ).alias("x"),
    )
    lists = stored(replaced.groupBy("blob").agg(F.sort_array(F.collect_list("x")).alias("entities")))

    hinted = docs.select("doc_id", "text").withColumn("hinted", text.rlike(HINT) & text.rlike(PATTERN))
    kind = lists.schema["entities"].dataType.simpleString()
    plain = hinted.where("NOT hinted").select("doc_id", "text", F.array().cast(kind).alias("entities"))
    rows = hinted.where("hinted").select("doc_id", "text", blob.alias("blob"))
    rows = spread_join(rows, lists, "blob", ["doc_id"])
    gaps = F.split("text", PATTERN, -1)
    filled = F.transform(gaps, lambda g, i: F.concat(g, F.coalesce(F.get("entities", i)["replacement"], F.lit(""))))
    new = rows.select("doc_id", F.array_join(filled, "").alias("text"), "entities")

    def number(t: str) -> Column:
        return F.size(F.filter("entities", lambda x: x["type"] == t)).cast("long")

    pair = lambda x: F.struct(x["type"], x["original"], x["replacement"])
    return plain.unionByName(new).select(
        "doc_id",
        "text",
        F.transform("entities", lambda x: pair(x)).alias("entities"),
        *(number(t).alias(f"n_{t}") for t in TYPES),
    )
