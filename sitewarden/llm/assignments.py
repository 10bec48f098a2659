"""Secrets in source, configuration and prose.

Three base kinds are found by pattern. Beyond them, texts are lexed as assignments (`name = literal`, `name: literal`,
`"name": "literal"`, `name => literal`, sums of literals and names); a name that is assigned to another name passes its
literals on, and every literal is scored by the most sensitive name it reaches. Literals of high score become spans of
kind `literal` unless a base span holds them.

Null text counts as empty. Each row is scanned on its own and in whole; a text without finds gives an empty list. Other
columns are passed on, one named like the output is replaced. One pass, no shuffle.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")  # a run of 32 or more is found at its start, so this is the whole run
KINDS = ("assign", "access", "hex", "literal")
NEEDED = ("passw", "secret", "token", "apikey", "api_key")

#: Weight of each word of a target name; together 1 - the product of (1 - weight).
SENSITIVE = {
    "password": 0.95, "passwd": 0.95, "passphrase": 0.95, "passcode": 0.9, "pwd": 0.9, "pass": 0.7, "secret": 0.95,
    "token": 0.9, "apikey": 0.95, "key": 0.5, "api": 0.4, "private": 0.6, "access": 0.4, "auth": 0.6, "bearer": 0.8,
    "credential": 0.9, "credentials": 0.9, "creds": 0.9, "signing": 0.5, "encryption": 0.5, "client": 0.1, "dsn": 0.6,
}
LEAST_SCORE, LEAST_LENGTH = 0.5, 8

_TERM = r""""(?:[^"\\\n]|\\.)*"|'(?:[^'\\\n]|\\.)*'|[A-Za-z0-9_$][^\s"'`,;(){}\[\]<>+]*"""
LEXER = re.compile(rf"""(?<![\w.$"'-])["']?([A-Za-z_$][\w.$-]*)["']?\]?[ \t]*(?::=|=>|=|:)[ \t]*((?:{_TERM})(?:[ \t]*\+[ \t]*(?:{_TERM}))*)""", re.A)
TERM = re.compile(_TERM, re.A)
NAME = re.compile(r"[A-Za-z_$][\w.$-]*\Z", re.A)
WORDS = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+", re.A)
PLACEHOLDER = re.compile(r"(?i)change_?me|example|placeholder|your[-_]|xxxx|\*\*\*|\.\.\.|^(?:none|null|true|false|undefined)$")


def name_score(name: str) -> float:
    words = [w.lower() for w in WORDS.findall(name)]
    pairs = [a + b for a, b in zip(words, words[1:], strict=False)]
    return 1 - math.prod(1 - SENSITIVE.get(w, 0) for w in [*words, *pairs])


def literal_score(value: str) -> float:
    """How much a literal looks like a secret: long, without blanks, of many different characters."""
    if len(value) < LEAST_LENGTH or any(c.isspace() for c in value) or PLACEHOLDER.search(value):
        return 0.0
    n = len(value)
    bits = -sum(k / n * math.log2(k / n) for k in Counter(value).values())
    kinds = sum(any(f(c) for c in value) for f in (str.islower, str.isupper, str.isdigit, lambda c: not c.isalnum()))
    return min(1.0, bits / 3) * (0.6 if kinds == 1 else 1.0)


def literals(text: str) -> Iterator[tuple[int, int, str, float]]:
    """(start, end, name, score) of every literal under the most sensitive name it reaches."""
    reached: dict[tuple[int, int], tuple[float, str]] = {}
    held: dict[str, set[tuple[int, int]]] = {}
    for m in LEXER.finditer(text):
        name, score, spans = m[1], name_score(m[1]), set()
        for term in TERM.finditer(text, m.start(2), m.end(2)):
            value = term[0]
            if value[0] in "\"'":
                spans.add((term.start() + 1, term.end() - 1))
            elif value in held:
                spans |= held[value]
            elif not NAME.match(value) or re.search(r"\d", value):
                spans.add(term.span())
        held[name] = spans
        for span in spans:
            reached[span] = max(reached.get(span, (0.0, "")), (score, name))
    for (start, end), (score, name) in sorted(reached.items()):
        if score:
            yield start, end, name, score * literal_score(text[start:end])


def spans_of(text: str) -> list[tuple[int, int, int, str | None, float]]:
    """(start, kind number, end, name, score), in order."""
    low = text.lower()
    found = []
    if any(k in low for k in NEEDED):
        found += [(m.start(), 0, m.end(), m[1], 1.0) for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end(), None, 1.0) for m in ACCESS.finditer(text) if len(m[0]) >= 16]
    found += [(m.start(), 2, m.end(), None, 1.0) for m in HEX.finditer(text)]
    if "=" in text or ":" in text:
        base = sorted(found)
        for start, end, name, score in literals(text):
            if score >= LEAST_SCORE and not any(a <= start and end <= b for a, _, b, _, _ in base):
                found.append((start, 3, end, name, score))
    return sorted(found, key=lambda f: f[:3])


def find_secrets(docs: DataFrame, text: str = "text", out: str = "secrets") -> DataFrame:
    """`docs` with an array of (kind, start, end, name, score); offsets are code points, the end exclusive."""
    kept = [c for c in docs.columns if c != out]
    docs = docs.select(*[F.col(f"`{c}`") for c in kept])
    at = kept.index(text)
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("name", pa.string()), ("score", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [
                [{"kind": KINDS[k], "start": a, "end": b, "name": n, "score": s} for a, k, b, n, s in spans_of(t or "")]
                for t in batch.column(at).to_pylist()
            ]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(made, kind)], [*batch.schema.names, out])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    return docs.mapInArrow(run, f"{schema}, `{out}` array<struct<kind: string, start: bigint, end: bigint, name: string, score: double>>")
