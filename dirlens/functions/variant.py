"""Column builders that read members of a VARIANT document.

Two kinds of presence are kept apart. ``node`` is true for any member that is there,
an explicit JSON ``null`` included. ``text`` is the member as a string, and NULL for JSON
``null``. Arrays are read with a typed cast: a missing member, JSON ``null`` and a value that
is not an array all give NULL, an element of the wrong shape gives a NULL element.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

CODING = "struct<system:string,code:string,display:string>"


def node(doc: Column | str, path: str) -> Column:
    """True when the member exists."""
    return F.try_variant_get(doc, path, "variant").isNotNull()


def text(doc: Column | str, path: str) -> Column:
    """The member as text; objects and arrays come as their JSON text."""
    return F.try_variant_get(doc, path, "string")


def array(doc: Column | str, path: str, element: str = "variant") -> Column:
    return F.try_variant_get(doc, path, f"array<{element}>")


def flat(nested: Column) -> Column:
    """One array out of an array of arrays, skipping NULL inner arrays."""
    return F.flatten(F.array_compact(nested))


def codings(doc: Column | str, path: str) -> Column:
    """All codings of an array of concepts."""
    return flat(array(doc, path, f"struct<coding:array<{CODING}>>").getField("coding"))


def malformed(doc: Column | str, path: str) -> Column:
    """True when a member that must be an array holds another kind of value."""
    member = F.try_variant_get(doc, path, "variant")
    return member.isNotNull() & ~F.is_variant_null(member) & array(doc, path).isNull()


def has_value(values: Column, value: str) -> Column:
    """Whether an array of strings holds ``value``; a missing array counts as no."""
    return F.coalesce(F.array_contains(values, F.lit(value)), F.lit(False))


def has_any(values: Column, wanted: list[str] | tuple[str, ...]) -> Column:
    return F.coalesce(F.arrays_overlap(values, F.array(*[F.lit(w) for w in wanted])), F.lit(False))


def has_substring(values: Column, part: str) -> Column:
    """Whether some string of the array contains ``part``, case-sensitively."""
    return F.coalesce(F.exists(values, lambda v: F.contains(v, F.lit(part))), F.lit(False))
