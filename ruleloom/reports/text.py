"""Escapes of report texts as columns, letter by letter only where a text has
something to escape.

What is printable follows the categories of letters, marks, numbers, punctuation
and symbols, and the space; letters that are newer than Java's Unicode are
escaped.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Escapes of quoted text, and of labels in DOT.
QUOTED = {'"': '\\"', "\\": "\\\\", "\a": "\\a", "\b": "\\b", "\f": "\\f", "\n": "\\n", "\r": "\\r", "\t": "\\t", "\v": "\\v"}
DOT = {"\\": "\\\\", '"': '\\"', "\n": "\\n", "\r": "\\r"}

PRINTABLE = r"[\p{L}\p{M}\p{N}\p{P}\p{S} ]"
ODD = r'["\\]|[^\p{L}\p{M}\p{N}\p{P}\p{S} ]'
CONTROL = r'["\\\p{Cc}]'


def by_letter(text: Column, odd: str, one: dict[str, str], other: str) -> Column:
    """``text`` with letters escaped: as ``one`` says, or as ``other`` tells
    by name where the letter is to be escaped at all."""

    def letter(c: Column) -> Column:
        out = F.when(F.lit(False), c)
        for raw, escaped in one.items():
            out = out.when(c == raw, F.lit(escaped))
        n = F.ascii(c)
        code = lambda width: F.lower(F.lpad(F.hex(n), width, "0"))
        if other == "go":
            plain, escaped = c.rlike(PRINTABLE), F.when(n < 128, F.concat(F.lit("\\x"), code(2))).when(n < 65536, F.concat(F.lit("\\u"), code(4))).otherwise(F.concat(F.lit("\\U"), code(8)))
        else:
            plain, escaped = ~c.rlike(r"\p{Cc}"), F.concat(F.lit("[U+"), F.lpad(F.hex(n), 4, "0"), F.lit("]"))
        return out.when(plain, c).otherwise(escaped)

    letters = F.regexp_extract_all(text, F.lit("(?s)."), F.lit(0))
    return F.when(text.rlike(odd), F.array_join(F.transform(letters, letter), "")).otherwise(text)


def one_line(text: Column) -> Column:
    return by_letter(text, ODD, QUOTED, "go")


def quoted(text: Column) -> Column:
    """``text`` in double quotes."""
    return F.concat(F.lit('"'), one_line(text), F.lit('"'))


def dot_label(text: Column) -> Column:
    return by_letter(text, CONTROL, DOT, "dot")


def fields(text: Column) -> Column:
    """``text`` with its white space as single spaces, none at the ends."""
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))
