"""Digest columns that the queries derive from spans."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F


def as_text(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["first"], s["last"])), ",")


def of_kinds(spans: Column, kinds: Iterable[str]) -> Column:
    return F.filter(spans, lambda s: s["kind"].isin(*kinds))


def count_of(spans: Column, kind: str) -> Column:
    return F.size(of_kinds(spans, [kind])).cast("long")


def digest(spans: Column) -> Column:
    return F.sha2(as_text(spans), 256)
