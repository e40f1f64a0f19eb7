"""Array elements as rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def explode_elements(df: DataFrame, keep: list[str], elements: Column | str, alias: str) -> DataFrame:
    """One row per array element with the columns ``keep``; rows without elements vanish.

    The outer form is used and its filler rows are dropped by position. The plain form makes the
    optimizer test the array for emptiness first, which computes the array twice.
    """
    return (
        df.select(*keep, F.posexplode_outer(elements).alias("element_position", alias))
        .filter("element_position is not null")
        .drop("element_position")
    )
