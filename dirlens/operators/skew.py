"""An existence test whose cost does not depend on how uneven the keys are."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dirlens.sources.partitions import tasks

HOT_KEYS = 256
SALTS = 64
# Share of the rows that is looked at to find frequent keys.
LOOK = 0.01
# Narrow rows that one task sorts and joins.
ROWS = 200_000


def exists_flag(
    left: DataFrame,
    right: DataFrame,
    on: list[str],
    spread_by: str,
    flag: str,
    hot_keys: int = HOT_KEYS,
    salts: int = SALTS,
    look: float = LOOK,
) -> DataFrame:
    """All rows of ``left`` with a flag: does the key occur in ``right``?

    The ``hot_keys`` most frequent keys are picked from a share of the rows (a pre-aggregated
    count and a top-k, so at most that many rows exist and broadcasting them is safe). Their rows
    are spread over ``salts`` sub-keys by ``spread_by`` and the matching rows of ``right`` are
    copied to each sub-key; all other keys join as they are. The pick is made once, when this is called,
    so that both sides see the same keys. Which keys are picked decides where
    rows travel and never what comes out: every row of ``left`` takes part in the join. Rows with
    a NULL key never match and do not travel to a common partition either. The number of partitions follows the
    number of rows, so that tasks keep their size as the tables grow.
    """
    complete = " and ".join(f"{k} is not null" for k in on)
    hot = (
        left.sample(look, seed=1)
        .filter(complete)
        .groupBy(*on)
        .count()
        .orderBy(F.desc("count"), *on)
        .limit(hot_keys)
        .select(*on, F.lit(True).alias("is_hot"))
    )
    hot = left.sparkSession.createDataFrame(hot.collect(), hot.schema)
    spread = F.pmod(F.xxhash64(spread_by), F.lit(salts)).cast("int")
    of_right = tasks(right, ROWS)
    n = max(tasks(left, ROWS), of_right)
    salted_left = (
        left.join(F.broadcast(hot), on, "left")
        .withColumn("salt", F.when(F.expr(f"is_hot or not ({complete})"), spread).otherwise(0))
        .drop("is_hot")
        .repartition(n, *on, "salt")
    )
    salted_right = (
        right.select(*on)
        .repartition(of_right, *on)
        .distinct()
        .join(F.broadcast(hot), on, "left")
        .withColumn(
            "salt",
            F.explode(F.when(F.col("is_hot"), F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0)))),
        )
        .select(*on, "salt", F.lit(True).alias(flag))
        .repartition(n, *on, "salt")
    )
    return (
        salted_left.join(salted_right, [*on, "salt"], "left")
        .withColumn(flag, F.coalesce(flag, F.lit(False)))
        .drop("salt")
    )
