"""Text analysis: lower-cased words by the Unicode word-break rules, and the catch-all search field.

A word is a run of letters, digits and connectors (``foo_bar``, ``x64``); a mark such as an apostrophe or a full stop
between two letters (``can't``, ``a.b``), or a comma or full stop between two digits (``1,000.5``), does not end it.
Ideographs and hiragana are a word each; runs of katakana, and of scripts that are written without spaces, are one.
"""

from __future__ import annotations

import re
import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

# The characters that do not break between two letters, and between two digits.
MID_LETTERS = ":\u00b7\u0387\u05f4\u2027\ufe13\ufe55\uff1a.\u2018\u2019\u2024\ufe52\uff07\uff0e'"
MID_NUMBERS = ",;\u037e\u0589\u060c\u060d\u066c\u07f8\u2044\ufe10\ufe14\ufe50\ufe54\uff0c\uff1b.\u2018\u2019\u2024\ufe52\uff07\uff0e'"

# Classes of characters, as expressions of Java and as kinds for ``query_terms``. What is most common is tested first.
_SPACELESS = r"\p{IsThai}\p{IsLao}\p{IsMyanmar}\p{IsKhmer}"
_LONG_VOWELS = "\u30fc\uff70"
_OTHERS = rf"\p{{IsHan}}\p{{IsHiragana}}\p{{IsKatakana}}{_LONG_VOWELS}{_SPACELESS}"
LETTER = rf"[a-z[\p{{L}}\p{{Nl}}&&[^{_OTHERS}]]]"
MARK = r"\p{M}\p{Cf}"
_RUN = rf"[a-z0-9_{LETTER}\p{{Nd}}\p{{Pc}}{MARK}]"
_KATAKANA = rf"[\p{{IsKatakana}}{_LONG_VOWELS}&&[\p{{L}}]]"
_SINGLE = r"[[\p{IsHan}\p{IsHiragana}]&&[\p{L}\p{Nl}]]"
_UNSPACED = rf"[[{_SPACELESS}]&&[\p{{L}}]]"
# A letter with its marks; expressions that look back need a bound.
_MARKED = rf"{LETTER}[{MARK}]{{0,16}}"
_JOINT = rf"(?:[{MID_LETTERS}](?={LETTER})(?<={_MARKED}[{MID_LETTERS}])|[{MID_NUMBERS}](?=\p{{Nd}})(?<=\p{{Nd}}[{MID_NUMBERS}]))"

# Possessive throughout: nothing is tried twice, and a word of any length is matched without recursion. Most of what
# begins no word is passed over by its first test.
TOKEN = (
    rf"(?![\x00-\x2F\x3A-\x40\x5B-\x5E\x60\x7B-\x7F])(?:\p{{Pc}}*+[0-9{LETTER}\p{{Nd}}]{_RUN}*+(?:{_JOINT}{_RUN}*+)*+"
    rf"|{_KATAKANA}[{_KATAKANA}{MARK}]*+|{_SINGLE}[{MARK}]*+|{_UNSPACED}[{_UNSPACED}{MARK}]*+)"
)

# The columns copied into the catch-all field.
CATCH_ALL_FIELDS = ["category", "level", "message", "threadName", "throwable", "hostname"]


def tokenize(c: Column | str) -> Column:
    """All words of the whole text, in order; none of a null text."""
    c = F.col(c) if isinstance(c, str) else c
    return F.regexp_extract_all(F.lower(c), F.lit(TOKEN), F.lit(0))


def _kind(character: str) -> str:
    """L letter, N digit, E connector, X mark, K katakana, C a word by itself, S written without spaces, or none."""
    category, name = unicodedata.category(character), unicodedata.name(character, "")
    if category in ("Nd", "Pc"):
        return "N" if category == "Nd" else "E"
    if category[0] == "M" or category == "Cf":
        return "X"
    if category[0] != "L" and category != "Nl":
        return ""
    if name.startswith(("KATAKANA", "HALFWIDTH KATAKANA")):
        return "K"
    if name.startswith(("CJK", "IDEOGRAPHIC", "HANGZHOU", "HIRAGANA")):
        return "C"
    return "S" if name.startswith(("THAI", "LAO", "MYANMAR", "KHMER")) else "L"


def query_terms(text: str) -> list[str]:
    """The words of a query string, cut the same way as ``tokenize`` cuts stored text."""
    text = text.lower()
    kinds = [*map(_kind, text), ""]
    terms, at = [], 0
    while at < len(text):
        begin, kind = at, kinds[at]
        at += 1
        if kind in ("K", "C", "S"):
            while kinds[at] == "X" or kinds[at] == kind != "C":
                at += 1
        elif kind and kind in "LNE":
            while kind == "E" and kinds[at] == "E":
                at += 1
            if kind == "E" and kinds[at] not in ("L", "N"):
                continue
            while kinds[at] and (kinds[at] in "LNEX" or _joins(text, kinds, at)):
                at += 1
            while _joins(text, kinds, at):
                at += 1
                while kinds[at] and kinds[at] in "LNEX":
                    at += 1
        else:
            continue
        terms.append(text[begin:at])
    return terms


def _joins(text: str, kinds: list[str], at: int) -> bool:
    if at + 1 >= len(text):
        return False
    letter = at - 1
    while letter > max(0, at - 17) and kinds[letter] == "X":
        letter -= 1
    return (text[at] in MID_LETTERS and kinds[letter] == kinds[at + 1] == "L") or (
        text[at] in MID_NUMBERS and kinds[at - 1] == kinds[at + 1] == "N"
    )


def as_word(term: str) -> str:
    """An expression for a word of ``query_terms`` where it stands as a whole word of a lower-cased text.

    The word itself comes first, so that its borders are tested only where it occurs.
    """
    word, first = re.escape(term), _kind(term[0])
    last = _kind(term.rstrip("".join(c for c in term if _kind(c) == "X"))[-1])
    if first in ("L", "N", "E"):
        before = [rf"[{LETTER}\p{{Nd}}\p{{Pc}}][{MARK}]{{0,16}}"]
        before += {"L": [f"{_MARKED}[{MID_LETTERS}]"], "N": [rf"\p{{Nd}}[{MID_NUMBERS}]"]}.get(first, [])
        after = [_RUN]
        after += [f"[{MID_LETTERS}]{LETTER}"] if last == "L" else []
        after += [rf"[{MID_NUMBERS}]\p{{Nd}}"] if _kind(term[-1]) == "N" else []
    elif first == "C":
        before, after = [], [f"[{MARK}]"]
    else:
        own = _KATAKANA if first == "K" else _UNSPACED
        before, after = [f"{own}[{MARK}]{{0,16}}"], [f"[{own}{MARK}]"]
    start = f"(?<!(?:{'|'.join(before)}){word})" if before else ""
    return f"{word}(?!{'|'.join(after)}){start}"


# What may stand between two words that are next to each other.
BETWEEN = rf"[^\p{{L}}\p{{Nl}}\p{{Nd}}]*"


# A word that nobody writes, between two fields: a phrase does not reach from one into the next.
FIELD_BREAK = "\ua7f7"


def catch_all_text(columns: list[str] | None = None) -> Column:
    """One searchable text per row; missing columns are skipped."""
    return F.concat_ws(f" {FIELD_BREAK} ", *[F.col(c) for c in (columns or CATCH_ALL_FIELDS)])
