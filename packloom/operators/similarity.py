"""Similar files by shared blocks."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .windows import tumbling_blocks, window_hash


def signatures(assets: DataFrame, width: int) -> DataFrame:
    """Distinct block hashes of each file: ``relative_path, signature``."""
    return tumbling_blocks(assets, width).select("relative_path", window_hash(F.col("window")).alias("signature")).distinct()


def shared_counts(signed: DataFrame) -> DataFrame:
    """``path_a, path_b, shared`` of all pairs of files with a common block.

    A block of k files makes k (k - 1) / 2 rows: that is the result asked for.
    Blocks of one file, the bulk, leave before the join; the join's skewed keys
    are split at run time.
    """
    common = signed.groupBy("signature").agg(F.count("*").alias("n")).where("n > 1").select("signature")
    held = signed.join(common, "signature")
    a = held.select("signature", F.col("relative_path").alias("path_a"))
    b = held.select("signature", F.col("relative_path").alias("path_b"))
    return a.join(b, "signature").where("path_a < path_b").groupBy("path_a", "path_b").agg(F.count("*").alias("shared"))


def similar_pairs(assets: DataFrame, width: int = 4_096, least: int = 3) -> DataFrame:
    return shared_counts(signatures(assets, width)).where(F.col("shared") >= least)
