"""Aggregate building blocks."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def rows() -> Column:
    return F.count(F.lit(1))


def percent(part: Column, whole: Column, digits: int = 1) -> Column:
    """Share in percent as a rounded double; NULL when the whole is zero."""
    return F.round(F.lit(100.0) * part / F.nullif(whole, F.lit(0)), digits)


def ratio(part: Column, whole: Column, digits: int = 1) -> Column:
    return F.round(part.cast("double") / F.nullif(whole, F.lit(0)), digits)


def megabytes(size: Column) -> Column:
    return F.round(size / F.lit(1024.0) / F.lit(1024.0), 1)


def seconds(millis: Column) -> Column:
    return F.round(millis / F.lit(1000.0), 1)
