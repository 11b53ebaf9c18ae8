"""Exact duplicates by size and hash."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions.classify import TYPES
from ..functions.paths import component_order


def clusters(assets: DataFrame, hash_col: str = "hash_hex") -> DataFrame:
    """Sizes and hashes that occur more than once: ``size, hash, n_paths, original``.

    ``original`` is the first path, component by component.  Members are rows of
    :func:`duplicate_map`, not an array, so a cluster of any size is fine.
    """
    first = F.array_join(F.min(component_order(F.col("relative_path"))), "/")
    return assets.groupBy("size", hash_col).agg(F.count("*").alias("n_paths"), first.alias("original")).where("n_paths > 1")


def waste(found: DataFrame) -> DataFrame:
    """Clusters, files beyond each first, and their bytes."""
    extra = F.col("n_paths") - 1
    return found.agg(F.count("*").alias("clusters"), F.coalesce(F.sum(extra), F.lit(0)).alias("duplicate_files"), F.coalesce(F.sum(F.col("size") * extra), F.lit(0)).alias("wasted_bytes"))


def duplicate_map(assets: DataFrame, hash_col: str = "hash_hex") -> DataFrame:
    """``relative_path, duplicate_of`` of every member but the first."""
    found = clusters(assets, hash_col).select("size", hash_col, F.col("original").alias("duplicate_of"))
    return assets.join(found, ["size", hash_col]).where("relative_path <> duplicate_of").select("relative_path", "duplicate_of")


def originals(assets: DataFrame, hash_col: str = "hash_hex") -> DataFrame:
    """Assets that are stored: all but duplicates."""
    return assets.join(duplicate_map(assets, hash_col), "relative_path", "left_anti")


def resolve(index: DataFrame, columns: list[str]) -> DataFrame:
    """``columns`` of each entry's original, one hop along ``duplicate_of``."""
    source = index.select(F.col("relative_path").alias("duplicate_of"), *(F.col(c).alias(f"__{c}") for c in columns))
    joined = index.join(source, "duplicate_of", "left")
    other = [c for c in index.columns if c not in columns]
    return joined.select(*other, *(F.coalesce(f"__{c}", c).alias(c) for c in columns))


def type_breakdown(assets: DataFrame) -> DataFrame:
    """Files and bytes of each of the four types, zeros included."""
    spark = assets.sparkSession
    types = spark.createDataFrame([(t,) for t in TYPES], "asset_type string")
    sums = assets.groupBy("asset_type").agg(F.count("*").alias("files"), F.sum("size").alias("bytes"))
    return types.join(sums, "asset_type", "left").select("asset_type", F.coalesce("files", F.lit(0)).alias("files"), F.coalesce("bytes", F.lit(0)).alias("bytes"))


def totals(assets: DataFrame) -> DataFrame:
    return assets.agg(F.count("*").alias("files"), F.coalesce(F.sum("size"), F.lit(0)).alias("bytes"))
