"""Text expressions: all built-in, evaluated in the JVM."""

from __future__ import annotations

import re
import sys

from pyspark.sql import Column
from pyspark.sql import functions as F

# Every character that counts as white space when a text is stripped.
WHITE = "".join(chr(i) for i in range(sys.maxunicode + 1) if chr(i).isspace())

# Only a line feed ends a line for "." in the rules; without the flag a carriage return would, too.
LINE_FEED_ONLY = "(?d)"


def regex(pattern: str) -> Column:
    return F.lit(LINE_FEED_ONLY + pattern)


def found(text: Column, pattern: str) -> Column:
    return F.rlike(text, regex(pattern))


def extract(text: Column, pattern: str, group: int = 0) -> Column:
    """First match or, unlike ``regexp_extract``, null when there is none."""
    return F.when(found(text, pattern), F.regexp_extract(text, LINE_FEED_ONLY + pattern, group))


def extract_all(text: Column, pattern: str, group: int = 0) -> Column:
    return F.regexp_extract_all(text, regex(pattern), F.lit(group))


def strip(text: Column) -> Column:
    return F.trim(text, F.lit(WHITE))


def one_line(text: Column) -> Column:
    """Line feeds to blanks, then stripped."""
    return strip(F.translate(text, "\n", " "))


def left(text: Column, n: int) -> Column:
    return F.substring(text, 1, n)


def right(text: Column, n: int) -> Column:
    """Last n characters, the whole text when it is shorter."""
    return F.when(F.length(text) > n, F.substring(text, -n, n)).otherwise(text)


def contains_any(text: Column, words: list[str]) -> Column:
    """Does a short text hold any of the words?"""
    return F.rlike(text, F.lit("|".join(re.escape(w) for w in words)))


def around(text: Column, start: Column, length: Column, radius: int) -> Column:
    """The characters from ``radius`` before a match to ``radius`` behind it; start counts from 0."""
    begin = F.greatest(start - F.lit(radius), F.lit(0))
    return F.substr(text, begin + 1, start + length + F.lit(radius) - begin)


def bind(value: Column, body) -> Column:
    """Evaluate ``value`` once and hand it to ``body``; a plain reference would be copied into every use."""
    return F.transform(F.array(value), body)[0]


def mask(value: Column, longer_than: int, head: int, tail: int, short_head: int) -> Column:
    return F.when(
        F.length(value) > longer_than,
        F.concat(left(value, head), F.lit("..."), right(value, tail)),
    ).otherwise(F.concat(left(value, short_head), F.lit("****")))


def quoted(text: str) -> str:
    """A string literal in SQL text."""
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def literals(texts) -> Column:
    """A fixed list as an array."""
    return F.expr(f"array({', '.join(map(quoted, texts))})")


def lookup(key: Column, table: dict, default: str | None = None) -> Column:
    """A small fixed table as an expression; no join."""
    pairs = ", ".join(f"{quoted(k)}, {quoted(v)}" for k, v in table.items())
    value = F.try_element_at(F.expr(f"map({pairs})"), key)
    return value if default is None else F.coalesce(value, F.lit(default))
