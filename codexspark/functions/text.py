"""Charsets, entities and markup attributes."""

from __future__ import annotations

import html
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StringType

#: Named entities that metadata strings may use; their characters come from the standard library's table.
ENTITIES = (
    "amp lt gt quot apos nbsp iexcl cent pound curren yen brvbar sect uml copy ordf laquo not reg macr deg plusmn acute micro para middot "
    "cedil ordm raquo iquest ndash mdash"
).split()
CHARACTERS = {e: "'" if e == "apos" else html.entities.html5[f"{e};"] for e in ENTITIES}
#: Attribute values longer than this are not looked at.
LONGEST_VALUE = 150


@F.pandas_udf(StringType())
def decode_text(data: pd.Series, code: pd.Series) -> pd.Series:
    """Bytes to text under a document's encoding number. cp1252 stops at NUL; bytes without a character become U+FFFD."""

    def one(b, c):
        if b is None:
            return None
        b = bytes(b)
        return b.decode("utf-8", "replace") if c == 65001 else b.split(b"\0", 1)[0].decode("cp1252", "replace")

    return pd.Series([one(b, c) for b, c in zip(data, code)], dtype=object)


@F.pandas_udf(BinaryType())
def encode_text(text: pd.Series, code: pd.Series) -> pd.Series:
    return pd.Series([None if t is None else t.encode("utf-8" if c == 65001 else "cp1252", "replace") for t, c in zip(text, code)], dtype=object)


def named_entities(text: Column) -> Column:
    """Named entities decoded, the ampersand last so that nothing is decoded twice."""
    for name, character in sorted(CHARACTERS.items(), key=lambda x: x[0] == "amp"):
        text = F.replace(text, F.lit(f"&{name};"), F.lit(character))
    return text


@F.pandas_udf(StringType())
def numeric_entities(text: pd.Series) -> pd.Series:
    """&#8364; and &#x20ac; decoded; numbers without a character stay."""

    def one(m: re.Match) -> str:
        code = int(m[2], 16) if m[1] else int(m[2])
        return chr(code) if 0 < code <= 0x10FFFF and not 0xD800 <= code < 0xE000 else m[0]

    return text.map(lambda t: None if t is None else re.sub(r"&#(x?)((?<=x)[0-9A-Fa-f]{1,6}|(?<!x)[0-9]{1,7});", one, t))


def decode_entities(text: Column) -> Column:
    return named_entities(numeric_entities(text))


def encode_entities(text: Column) -> Column:
    """Text that decode_entities gives back as it was: no ampersand is left that could begin an entity of its own."""
    return F.replace(text, F.lit("&"), F.lit("&amp;"))


@F.pandas_udf(StringType())
def character(code: pd.Series) -> pd.Series:
    """The character of a code point; null where there is none."""
    return code.map(lambda c: chr(int(c)) if c == c and c is not None and 0 <= c <= 0x10FFFF and not 0xD800 <= c < 0xE000 else None)


def attribute_values(markup: Column, name: str) -> Column:
    """Values of a quoted attribute, in order."""
    return F.regexp_extract_all(markup, F.lit(f'(?<=[\\s"]){name}="([^"]{{0,{LONGEST_VALUE}}})"'), F.lit(1))


def without_attribute(markup: Column, name: str) -> Column:
    """Markup with an attribute taken out of its tags; white space before it stays."""
    return F.regexp_replace(markup, f'(<[^>]*?)\\b{name}="[^"]*"', "$1")


def positions(markup: Column, pattern: str) -> Column:
    """array<struct<at, value>> of a pattern's first group: 0-based character offsets of each match. Text between
    matches is measured, so nothing is looked for twice."""
    between = F.transform(F.split(markup, pattern, -1), lambda s: F.char_length(s))
    whole = F.regexp_extract_all(markup, F.lit(f"({pattern})"), F.lit(1))
    value = F.regexp_extract_all(markup, F.lit(f"({pattern})"), F.lit(2))
    lengths = F.transform(whole, lambda s: F.char_length(s))

    def at(v: Column, i: Column) -> Column:
        total = lambda xs, n: F.aggregate(F.slice(xs, 1, n), F.lit(0), lambda a, x: a + x)
        return F.struct((total(between, i + 1) + total(lengths, i)).cast("long").alias("at"), v.alias("value"))

    return F.transform(value, at)
