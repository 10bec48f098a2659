"""Digest columns from arrays of (kind, start, end) spans."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def count_of(spans: str, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s.kind == kind)).cast("bigint")


def joined(spans: str, kinds: tuple[str, ...] | None = None) -> Column:
    """kind:start:end of the spans in their order, joined by commas."""
    chosen = F.filter(spans, lambda s: s.kind.isin(*kinds)) if kinds else F.col(spans)
    return F.array_join(F.transform(chosen, lambda s: F.concat_ws(":", s.kind, s.start.cast("string"), s.end.cast("string"))), ",")
