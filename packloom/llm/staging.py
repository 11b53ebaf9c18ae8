"""Tables written between steps of one operator.

Lineage is cut by writing Parquet into the folder that ``spark.checkpoint.dir``
names, which driver and executors share; a lost executor then costs a re-read,
not a recomputation.  Tables that a result still reads stay until the folder is
cleaned.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame

from ..operators.ordering import shared_dir, spread

__all__ = ["Steps", "drop_staged", "shared_dir", "spread", "stage"]


def stage(df: DataFrame, tag: str, codec: str = "snappy") -> DataFrame:
    """Write ``df`` and return a DataFrame that reads the written table."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"
    df.write.option("compression", codec).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.staged_at = path
    return out


def drop_staged(df: DataFrame) -> None:
    """Delete the table behind a DataFrame returned by :func:`stage`, once nothing reads it."""
    spark = df.sparkSession
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(df.staged_at)
    path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


class Steps:
    """Staged tables of one operator that are deleted once its results no longer read them."""

    def __init__(self) -> None:
        self.made: list[DataFrame] = []

    def stage(self, df: DataFrame, tag: str, codec: str = "snappy") -> DataFrame:
        self.made.append(stage(df, tag, codec))
        return self.made[-1]

    def drop(self, df: DataFrame) -> None:
        """Delete one table before the others, once no later step reads it."""
        self.made = [x for x in self.made if x is not df]
        drop_staged(df)

    def clear(self) -> None:
        for df in self.made:
            drop_staged(df)
        self.made = []
