"""Global positions and running sums without a single-task window.

Rows are range-partitioned and sorted; a position is the row's place in its
partition plus the sizes of the partitions before it.  Only one row a partition
is broadcast.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

_SHIFT = 33  # monotonically_increasing_id: partition above, row below


_LOCAL: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``, or a set checkpoint folder.

    Only a local session, as in tests, may do without: it gets a temporary folder.
    """
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if path:
        return path.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _LOCAL:
        _LOCAL[app] = "file://" + tempfile.mkdtemp(prefix="packloom-")
    return _LOCAL[app]


def scratch(spark: SparkSession) -> str:
    """A fresh path in the folder that executors share."""
    return f"{shared_dir(spark)}/packloom-{uuid.uuid4().hex}"


def spread(df: DataFrame) -> DataFrame:
    """Rows dealt to all cores where the source has fewer splits than there are cores, as a small table in one file has."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def fixed(df: DataFrame) -> DataFrame:
    """``df`` written to the checkpoint folder, so that a lost executor cannot change an assigned order."""
    spark = df.sparkSession
    if spark.conf.get("spark.checkpoint.dir", None) is None and spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(shared_dir(spark))
    return df.checkpoint()


def with_positions(df: DataFrame, order: list[Column], size: str | None = None, *, position: str = "position", offset: str = "offset") -> DataFrame:
    """Adds ``position`` (from 0, in ``order``) and, for a column ``size``, ``offset``: its sum over all rows before.

    ``order`` has to be a total order for the result to be determined; nulls in
    ``size`` count as 0.
    """
    spark = df.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    keys = [f"k{i}" for i in range(len(order))]
    amount = F.coalesce(F.col(size), F.lit(0)).cast("long") if size else F.lit(0).cast("long")
    keyed = df.select(F.struct(*(F.col(f"`{c}`") for c in df.columns)).alias("value"), amount.alias("amount"), *(c.alias(k) for c, k in zip(order, keys, strict=True)))
    placed = fixed(keyed.repartitionByRange(parts, *keys).sortWithinPartitions(*keys).select("value", "amount", F.monotonically_increasing_id().alias("row")))
    placed = placed.select("value", "amount", F.shiftright("row", _SHIFT).alias("part"), F.col("row").bitwiseAND(F.lit((1 << _SHIFT) - 1)).alias("at"))
    totals = placed.groupBy("part").agg(F.count("*").alias("n"), F.sum("amount").alias("s"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row a partition
    starts = totals.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("n0"), F.coalesce(F.sum("s").over(before), F.lit(0)).alias("s0"))
    out = placed.join(F.broadcast(starts), "part")
    made = {position: F.col("n0") + F.col("at")}
    if size:
        inside = Window.partitionBy("part").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
        made[offset] = F.col("s0") + F.coalesce(F.sum("amount").over(inside), F.lit(0))
    return out.select(*(F.col("value")[c].alias(c) for c in df.columns if c not in made), *(c.alias(n) for n, c in made.items()))
