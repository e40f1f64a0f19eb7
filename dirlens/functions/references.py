"""Parsers for references between documents."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed pattern: optional base URL, type name, id, optional version suffix.
STRICT_REFERENCE = r"^(?:[a-z]+://[^#?]+/)?[A-Z][A-Za-z]+/([A-Za-z0-9\-.]{1,64})(?:/_history/[^/]+)?$"


def last_segment(reference: Column) -> Column:
    """The part after the last slash: reads relative and absolute references alike."""
    return F.substring_index(reference, "/", -1)


def second_segment(reference: Column) -> Column:
    """The part after the first slash: right for ``Type/id``, empty for an absolute URL."""
    return F.split_part(reference, F.lit("/"), F.lit(2))


def strict_id(reference: Column) -> Column:
    """The id of a well-formed reference, version suffix dropped; NULL for anything else."""
    return F.nullif(F.regexp_extract(reference, STRICT_REFERENCE, 1), F.lit(""))


PARSERS: dict[str, Callable[[Column], Column]] = {
    "last": last_segment,
    "segment2": second_segment,
    "strict": strict_id,
}


def reference_id(reference: Column, parse: str = "last") -> Column:
    return PARSERS[parse](reference)


def reference_format(reference: Column) -> Column:
    return (
        F.when(reference.isNull(), F.lit("none"))
        .when(reference.rlike(r"^[a-z]+://"), F.lit("absolute"))
        .when(reference.rlike(r"^[A-Z][A-Za-z]+/[^/]+"), F.lit("relative"))
        .otherwise(F.lit("other"))
    )


def reference_host(reference: Column) -> Column:
    return F.nullif(F.regexp_extract(reference, r"^[a-z]+://([^/]+)/", 1), F.lit(""))
