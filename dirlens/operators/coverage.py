"""One-scan coverage reports: how many rows, and which share of them, satisfy a flag.

All of them are a single grouped aggregate. Map-side partial aggregation leaves one row per
task and group, so the exchange stays tiny whatever the size of a group. Conditions are part of
the aggregates and not filters in front of them: a filter on a document member would be pushed
down and the member would be extracted twice.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dirlens.functions.measures import percent, rows
from dirlens.functions.variant import has_any, has_substring, has_value

DATASET = "source_dataset"


def _column(flag: Column | str) -> Column:
    return F.col(flag) if isinstance(flag, str) else flag


def flag_report(
    df: DataFrame,
    counts: Mapping[str, Column | str] | None = None,
    shares: Mapping[str, Column | str] | None = None,
    total: str | None = "total",
    denominator: Column | str | None = None,
    by: str = DATASET,
) -> DataFrame:
    """Counts and percentages of flags per group.

    ``denominator`` is the flag of the rows a percentage refers to; all rows by default. A
    group without any such row keeps its line with a NULL percentage.
    """
    whole = rows() if denominator is None else F.count_if(_column(denominator))
    measures = [] if total is None else [rows().alias(total)]
    measures += [F.count_if(_column(flag)).alias(name) for name, flag in (counts or {}).items()]
    measures += [
        percent(F.count_if(_column(flag)), whole).alias(name) for name, flag in (shares or {}).items()
    ]
    return df.groupBy(by).agg(*measures).orderBy(by)


def _among(df: DataFrame, present: str, total: str, flag: Column, has: str, share: str) -> DataFrame:
    """Count and percentage of a flag among the rows with ``present``; groups without any are left out."""
    among, both = F.count_if(present), F.count_if(F.col(present) & flag)
    return (
        df.groupBy(DATASET)
        .agg(among.alias(total), both.alias(has), percent(both, among).alias(share))
        .filter(F.col(total) > 0)
        .orderBy(DATASET)
    )


def field_completeness(df: DataFrame, fields: Mapping[str, Column | str], total: str = "total") -> DataFrame:
    """Percentage of rows in which each field is present, any number of fields in one scan."""
    return flag_report(df, shares=fields, total=total)


def identifier_coverage(df: DataFrame, systems: Sequence[str], has: str, share: str) -> DataFrame:
    """Rows with any identifier, and rows with an identifier of one of ``systems``."""
    wanted = has_any(F.col("identifiers").getField("system"), list(systems))
    return flag_report(
        df, counts={"has_any_identifier": "has_identifier", has: wanted}, shares={share: wanted}
    )


def extension_coverage(
    df: DataFrame,
    pattern: str,
    has: str,
    share: str,
    total: str | None = None,
    denominator: str = "with_extension",
) -> DataFrame:
    """Rows with an extension whose URL contains ``pattern``.

    ``denominator='only_rows_with_extension'`` drops rows without extensions beforehand, so a
    group with none disappears; ``'with_extension'`` keeps the group with a NULL percentage;
    ``'rows'`` refers to all rows.
    """
    matches = has_substring(F.col("extension_urls"), pattern)
    if denominator == "only_rows_with_extension":
        return _among(df, "has_extension", total or "total", matches, has, share)
    if denominator not in ("with_extension", "rows"):
        raise ValueError(f"unknown denominator {denominator!r}")
    base = "has_extension" if denominator == "with_extension" else None
    return flag_report(df, {has: matches}, {share: matches}, total, base)


def extension_census(df: DataFrame, patterns: Mapping[str, str]) -> DataFrame:
    """Rows with any extension and rows per URL pattern."""
    urls = F.col("extension_urls")
    counts = {name: has_substring(urls, pattern) for name, pattern in patterns.items()}
    return flag_report(df, counts={"has_any_extension": "has_extension"} | counts)


def nested_presence(
    df: DataFrame, members: Mapping[str, Column | str], extension_urls: str, pattern: str, has_extension: str
) -> DataFrame:
    """Rows in which some element of an array has a member, or an extension like ``pattern``."""
    nested = has_substring(F.col(extension_urls), pattern)
    return flag_report(df, counts=dict(members) | {has_extension: nested})


def coding_coverage(
    df: DataFrame,
    codings: str,
    system: str,
    has: str,
    share: str,
    present: str,
    total: str = "total",
    denominator: str = "rows",
    has_present: str | None = None,
    share_present: str | None = None,
) -> DataFrame:
    """Rows with a coding of ``system``, out of all rows or of the rows that have the field."""
    coded = has_value(F.col(codings).getField("system"), system)
    if denominator == "present":
        return _among(df, present, total, coded, has, share)
    if denominator != "rows":
        raise ValueError(f"unknown denominator {denominator!r}")
    counts: dict[str, Column | str] = {has_present: present} if has_present else {}
    shares: dict[str, Column | str] = {share_present: present} if share_present else {}
    return flag_report(df, counts | {has: coded}, shares | {share: coded}, total)


def either_invariant(df: DataFrame, first: str, second: str, names: Mapping[str, str]) -> DataFrame:
    """How many rows have the first field, the second, either, or neither."""
    either = F.col(first) | F.col(second)
    return flag_report(
        df,
        counts={
            names["first"]: first,
            names["second"]: second,
            names["either"]: either,
            names["neither"]: ~either,
        },
        shares={names["share_neither"]: ~either},
    )


def array_length_stats(df: DataFrame, size: str, present: str, names: Sequence[str]) -> DataFrame:
    """Average, longest and shortest array among the rows that have it."""
    average, longest, shortest = names
    return (
        df.groupBy(DATASET)
        .agg(
            F.count_if(present).alias("with_array"),
            F.round(F.avg(size), 2).alias(average),
            F.max(size).cast("long").alias(longest),
            F.min(size).cast("long").alias(shortest),
        )
        .filter("with_array > 0")
        .drop("with_array")
        .orderBy(DATASET)
    )
