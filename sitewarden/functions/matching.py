"""Rule tables compiled to expressions.

Rules are literals in the plan, not rows of a joined table: a literal pattern is compiled once per task
and the text is never copied per rule. The words found beforehand decide which patterns have to run. The
wide expressions are written as SQL text, which is parsed in one step.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from sitewarden.functions.text import LINE_FEED_ONLY, around, bind, left, one_line, quoted, right
from sitewarden.functions.words import WordIndex
from sitewarden.rules import builders, javascript, leaks, secrets, tech

RULES = list(secrets.PATTERNS)
REQUIRED = {**tech.REQUIRED, **builders.REQUIRED}

_LITERAL = re.compile(r"(?:[A-Za-z0-9 _/@\-\"=<>:]|\\[.()\[\]$\"])+")
_LINE_SPAN = re.compile(r"(?P<head>.+?)\.\*\??(?P<tail>.+)")


def literal(pattern: str) -> str | None:
    """The text a pattern stands for, in lower case, when it has no operators."""
    return re.sub(r"\\(.)", r"\1", pattern).lower() if _LITERAL.fullmatch(pattern) else None


def _span(pattern: str) -> tuple[str, str, str] | None:
    """Head, its text and tail of a pattern "a.*b"."""
    span = _LINE_SPAN.fullmatch(pattern)
    text = literal(span["head"]) if span else None
    return (span["head"], text, span["tail"]) if text is not None else None


def required_word(pattern: str) -> str | None:
    """A word without which a fingerprint cannot occur."""
    span = _span(pattern)
    return literal(pattern) or (span[1] if span else REQUIRED.get(pattern))


def _all_words() -> set[str]:
    signatures = [*tech.SIGNATURES.values(), *builders.SIGNATURES.values()]
    words = {required_word(p) for patterns in signatures for p in patterns} - {None}
    words |= {a.lower() for anchors in secrets.ANCHORS.values() for a in anchors}
    words |= {sink.lower() for sink in javascript.SINKS} | {word for _, _, word in leaks.CONFIG_BLOBS}
    return words | set(leaks.ERROR_WORDS) | set(PAGE_WORDS)


# Words that gate the page structure.
PAGE_WORDS = ["<script", "<style", "<link", "<form", "<meta", "<!--", "github.com/", "sourcemappingurl=", "/static/",
              "__next_data__", "fetch", ".open"]
WORDS = WordIndex(_all_words())


def regex(pattern: str) -> str:
    return quoted(LINE_FEED_ONLY + pattern)


def credential_matches(text: str, gated: bool = True) -> Column:
    """``array<array<string>>``: all matches of each credential rule, in rule order (null: none).

    Needs the word marks unless ``gated`` is off. Case-sensitive words are looked up once more as they are.
    """
    arrays = []
    for rule, pattern in secrets.PATTERNS.items():
        matches = f"regexp_extract_all({text}, {regex(secrets.searched(rule))}, 0)"
        gates = []
        if gated and rule in secrets.ANCHORS:
            anchors = secrets.ANCHORS[rule]
            gates.append(WORDS.present(anchors))
            if not pattern.startswith("(?i)") and any(a != a.lower() for a in anchors):
                gates.append("(" + " OR ".join(f"contains({text}, {quoted(a)})" for a in anchors) + ")")
        if gated and rule in secrets.NECESSARY:
            gates.append(f"rlike({text}, {regex(secrets.NECESSARY[rule])})")
        if gates:
            matches = f"CASE WHEN {' AND '.join(gates)} THEN {matches} END"
        arrays.append(matches)
    return F.expr(f"array({', '.join(arrays)})")


def credential_hits(text: Column, matches: Column, keep: int | None = None) -> Column:
    """``array<struct<ord, pos, value, context>>`` for the matches of one text.

    ``keep`` limits the matches of a rule per text, which is enough for a scan with a cap. The surroundings of a match are put
    together from the gaps and matches next to it, as many as can lie within the radius; the work grows
    with the text, not with its square.
    """
    radius, near = secrets.CONTEXT_RADIUS, secrets.CONTEXT_RADIUS // secrets.SHORTEST_MATCH + 1
    patterns = F.expr(f"array({', '.join(regex(secrets.searched(rule)) for rule in RULES)})")

    def ends(parts: Column, cut) -> Column:
        return F.transform(parts, lambda p: cut(p, radius))

    def before(p: Column, i: Column) -> Column:
        pieces = F.transform(
            F.sequence(F.greatest(i - near, F.lit(0)), i),
            lambda j: F.concat(p["gap_ends"][j], F.when(j < i, p["match_ends"][j]).otherwise("")),
        )
        return right(F.array_join(pieces, ""), radius)

    def after(p: Column, i: Column) -> Column:
        pieces = F.transform(
            F.sequence(i + 1, F.least(i + near, F.size(p["gap_starts"]) - 1)),
            lambda j: F.concat(p["gap_starts"][j], F.coalesce(F.get(p["match_starts"], j), F.lit(""))),
        )
        return left(F.array_join(pieces, ""), radius)

    def located(rule: Column) -> Column:
        values, order = rule["m"], rule["o"]
        gaps = F.split(text, F.element_at(patterns, order), -1 if keep is None else keep + 1)
        parts = bind(
            gaps,
            lambda g: F.struct(
                ends(g, right).alias("gap_ends"), ends(g, left).alias("gap_starts"),
                ends(values, right).alias("match_ends"), ends(values, left).alias("match_starts"),
            ),
        )
        return bind(
            parts,
            lambda p: F.transform(
                values,
                lambda value, i: F.struct(
                    order.cast("bigint").alias("ord"),
                    i.cast("bigint").alias("pos"),
                    value.alias("value"),
                    one_line(F.concat(before(p, i), value, after(p, i))).alias("context"),
                ),
            ),
        )

    def kept(m: Column) -> Column:
        return m if keep is None else F.slice(m, 1, keep)

    numbered = F.transform(matches, lambda m, i: F.struct((i + 1).alias("o"), kept(m).alias("m")))
    some = F.filter(numbered, lambda r: F.size(r["m"]) > 0)
    return F.flatten(F.transform(some, located))


def signature_test(text: str, pattern: str) -> str:
    """Does a case-insensitive fingerprint occur? For plain texts the mark is the answer; "a.*b" runs once
    per line from the first "a" instead of once per "a"."""
    if literal(pattern) is not None:
        return WORDS.present([literal(pattern)])
    word, span = required_word(pattern), _span(pattern)
    if span is not None:
        tail = span[2].replace(".*?", r"[^\n]*?")
        test = f"rlike({text}, {regex(rf'(?im)^(?>[^\n]*?{span[0]})[^\n]*?{tail}')})"
    else:
        test = f"rlike({text}, {regex('(?i)' + pattern)})"
    return f"({WORDS.present([word])} AND {test})" if word else test


def technologies(text: str) -> Column:
    """``array<string>``: technologies with at least one fingerprint in a marked text."""
    tests = []
    for name, patterns in tech.SIGNATURES.items():
        plain = [literal(p) for p in patterns if literal(p) is not None]
        marks = [WORDS.present(plain)] if plain else []
        rest = [signature_test(text, p) for p in patterns if literal(p) is None]
        tests.append(f"CASE WHEN {' OR '.join(marks + rest)} THEN {quoted(name)} END")
    return F.expr(f"filter(array({', '.join(tests)}), x -> x IS NOT NULL)")


def builder_patterns(text: str) -> Column:
    """``array<struct<tool, n, pattern>>``: first fingerprint in list order of each builder that has one."""
    tests = []
    for tool, patterns in builders.SIGNATURES.items():
        cases = " ".join(
            f"WHEN {signature_test(text, p)} THEN "
            f"named_struct('tool', {quoted(tool)}, 'n', {n}L, 'pattern', {quoted(p)})"
            for n, p in enumerate(patterns, 1)
        )
        tests.append(f"CASE {cases} END")
    return F.expr(f"filter(array({', '.join(tests)}), x -> x IS NOT NULL)")


def evidence(text: Column, pattern: Column) -> Column:
    """First match of a case-insensitive pattern with its surroundings, on one line."""
    matcher = F.concat(F.lit(LINE_FEED_ONLY + "(?i)"), pattern)
    value = F.regexp_substr(text, matcher)
    return bind(
        F.split(text, matcher, 2),
        lambda p: one_line(around(text, F.length(p[0]), F.length(value), builders.EVIDENCE_RADIUS)),
    )
