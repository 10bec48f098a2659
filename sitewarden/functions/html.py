"""Elements and attributes from page text, in document order.

One tokenizer pattern runs from left to right, so tags inside comments or scripts are not taken for
elements. Quoted attribute values may hold ``>``. The loops are possessive: no backtracking and no deep
recursion on hostile pages.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from sitewarden.functions.text import bind

OPEN_REST = r"(?:[^>\"']++|\"[^\"]*+\"|'[^']*+'|[\"'])*+>"
COMMENT = r"<!--.*?(?:-->|\z)"
SCRIPT = r"<script(?=[\s/>])" + OPEN_REST + r".*?(?:</script[^>]*>|\z)"
STYLE = r"<style(?=[\s/>])" + OPEN_REST + r".*?(?:</style[^>]*>|\z)"
FLAGS = "(?is)"

ATTRIBUTE = r"[^\s\"'<>/=]+(?:\s*=\s*(?:\"[^\"]*+\"|'[^']*+'|[^\s\"'>]+))?"


def one_of(patterns: list[str]) -> str:
    """Any of some patterns that begin with ``<``; the other characters of a text are passed over by one test each."""
    return "(?=<)(?:" + "|".join(patterns) + ")"


def elements(html: Column, *names: str) -> Column:
    """Tokens of script, style and the named void elements; comments are consumed and left out."""
    plain = [rf"<{n}(?=[\s/>])" + OPEN_REST for n in names if n not in ("script", "style")]
    pattern = FLAGS + one_of([COMMENT, SCRIPT, STYLE, *plain])
    wanted = FLAGS + r"^<(?:" + "|".join(names) + r")(?=[\s/>])"
    return F.filter(
        F.regexp_extract_all(html, F.lit(pattern), F.lit(0)),
        lambda t: F.rlike(t, F.lit(wanted)),
    )


def without_code(html: Column) -> Column:
    """Page text without comments, scripts and styles."""
    return F.regexp_replace(html, FLAGS + one_of([COMMENT, SCRIPT, STYLE]), " ")


def blocks(html: Column, name: str) -> Column:
    """``<name ...> ... </name>`` of a non-nesting element; an unclosed one runs to the end."""
    pattern = FLAGS + rf"<{name}(?=[\s/>])" + OPEN_REST + rf".*?(?:</{name}\s*>|\z)"
    return F.regexp_extract_all(html, F.lit(pattern), F.lit(0))


def tags(html: Column, name: str) -> Column:
    return F.regexp_extract_all(html, F.lit(FLAGS + rf"<{name}(?=[\s/>])" + OPEN_REST), F.lit(0))


def open_tag(element: Column) -> Column:
    return F.regexp_extract(element, FLAGS + r"^<[a-z0-9]+" + OPEN_REST, 0)


def body(element: Column) -> Column:
    """Raw text between the open tag and the end tag."""
    inner = F.regexp_replace(element, FLAGS + r"^<[a-z0-9]+" + OPEN_REST, "")
    return F.regexp_replace(inner, FLAGS + r"</[a-z]+[^>]*>\z", "")


def unescape(value: Column) -> Column:
    """The five predefined character references."""
    for reference, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        value = F.replace(value, F.lit(reference), F.lit(char))
    return value


def _raw_value(listed: Column, name: str) -> Column:
    """Value of an attribute with its quotes; the last of several equal names counts."""
    named = F.filter(listed, lambda a: F.rlike(a, F.lit(rf"(?is)^{name}(?:\s*=|\z)")))
    return F.regexp_replace(F.try_element_at(named, F.lit(-1)), r"(?is)^[^=]*=?\s*", "")


def attributes(element: Column, *names: str) -> Column:
    """Struct of attributes of the open tag: null when absent, empty when without a value."""
    inside = F.regexp_replace(open_tag(element), FLAGS + r"^<[a-z0-9]+", "")
    listed = F.regexp_extract_all(inside, F.lit(ATTRIBUTE), F.lit(0))
    values = bind(
        listed,
        lambda a: F.transform(
            F.array(*[_raw_value(a, n) for n in names]), lambda v: unescape(F.regexp_replace(v, r"(?s)^([\"'])(.*)\1$", "$2"))
        ),
    )
    return bind(values, lambda v: F.struct(*[v[i].alias(n) for i, n in enumerate(names)]))
