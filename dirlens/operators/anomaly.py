"""Records that look wrong."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dirlens.functions.variant import has_value, malformed
from dirlens.operators.coverage import flag_report
from dirlens.schema import OVERSIZE_THRESHOLD

# Fixed pattern of a UUID.
UUID = r"^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$"


def oversized_arrays(
    df: DataFrame, sizes: Mapping[str, str], keep: Sequence[str], threshold: int = OVERSIZE_THRESHOLD
) -> DataFrame:
    """Records with any array longer than ``threshold``, largest document first."""
    large = reduce(Column.__or__, [F.col(c) > threshold for c in sizes.values()])
    return (
        df.filter(large)
        .select(
            *keep,
            *[F.col(c).cast("long").alias(name) for name, c in sizes.items()],
            F.col("json_bytes").alias("json_size_bytes"),
        )
        .orderBy(F.desc("json_size_bytes"), *keep)
    )


def shell_records(df: DataFrame, attributes: Sequence[str]) -> DataFrame:
    """Records that have none of the directory attributes."""
    anything = reduce(Column.__or__, [F.col(a) for a in attributes])
    return flag_report(
        df,
        counts={"shell": ~anything, "shell_with_name": ~anything & F.col("has_name")},
        shares={"pct_shell": ~anything},
    )


def identifier_quality(df: DataFrame, wrong_system: str) -> DataFrame:
    """Records with UUID-shaped values, a system that does not fit, or a repeated identifier."""
    uuid = F.coalesce(F.exists("identifiers", lambda e: e["value"].rlike(UUID)), F.lit(False))
    wrong = has_value(F.col("identifiers").getField("system"), wrong_system)
    elements = F.col("identifier_elements")
    repeated = F.coalesce(F.size(elements) > F.size(F.array_distinct(elements)), F.lit(False))
    return flag_report(
        df,
        counts={
            "has_uuid_value": uuid,
            "has_wrong_system": wrong,
            "has_duplicate_identifier": repeated,
        },
        shares={"pct_duplicate_identifier": repeated},
    )


def malformed_arrays(documents: DataFrame, paths: Mapping[str, str]) -> DataFrame:
    """Documents in which a member that must be an array is something else, per member.

    Reads the documents themselves, since a feature table no longer shows the difference.
    """
    return flag_report(documents, counts={n: malformed("doc", p) for n, p in paths.items()})
