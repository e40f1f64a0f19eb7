"""What the operators share: reading tables, writing intermediate ones, deterministic document rows."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dirlens.session import work_folder


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Removes a query's shuffle files when it has ended; without it they stay until the driver collects garbage.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def setting(spark: SparkSession, key: str, value: str) -> Iterator[None]:
    """A session setting for as long as the block runs."""
    before = spark.conf.get(key, None)
    spark.conf.set(key, value)
    try:
        yield
    finally:
        spark.conf.set(key, before) if before is not None else spark.conf.unset(key)


def written(df: DataFrame, purpose: str, codec: str = "snappy", options: dict[str, str] | None = None) -> DataFrame:
    """The rows as a table in the shared working folder: no lineage is left, a lost executor costs nothing. ``options``: more of the writer's."""
    spark = df.sparkSession
    path = f"{work_folder(spark, purpose)}/table"
    with setting(spark, _CLEANUP, "true"):
        df.write.options(**options or {}).parquet(path, compression=codec)
    return spark.read.schema(df.schema).parquet(path)


def discard(*tables: DataFrame) -> None:
    """Deletes tables of ``written`` that no later step reads, so that a long job holds few of them at a time."""
    for df in tables:
        folder = df.inputFiles()[:1]
        if folder and "/dirlens" in folder[0]:
            jvm, session = df.sparkSession._jvm, df.sparkSession._jsparkSession
            path = jvm.org.apache.hadoop.fs.Path(folder[0]).getParent()
            path.getFileSystem(session.sessionState().newHadoopConf()).delete(path, True)


def texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Id and text only, under fixed names, so that columns of the input can't clash; a null text is empty."""
    return docs.select(
        F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text")
    )


def fresh(df: DataFrame, name: str) -> str:
    """A column name like ``name`` that the DataFrame doesn't have."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name
