"""Views of a package index."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions.numbers import megabytes, percent, ratio
from ..functions.paths import component_order, ellipsis, matches_search
from .ordering import with_positions


def entries(index: DataFrame) -> DataFrame:
    """Bytes, ratio and flags per entry: duplicates hold no bytes, chunked files the sum of their chunks."""
    held = F.aggregate("chunks", F.lit(0).cast("long"), lambda s, c: s + c["body_length"])
    compressed = F.when(F.col("duplicate_of").isNotNull(), 0).when(F.size("chunks") > 0, held).otherwise(F.col("compressed_length")).cast("long")
    out = index.withColumn("compressed_bytes", compressed)
    return out.select(F.col("relative_path").alias("path"), "asset_type", F.col("uncompressed_length").alias("uncompressed_bytes"), "compressed_bytes", ratio(F.col("uncompressed_length"), F.col("compressed_bytes")).alias("ratio"), F.col("duplicate_of").isNotNull().alias("is_duplicate"), "is_stored_raw", "duplicate_of")


def totals(listed: DataFrame) -> DataFrame:
    """Sums over the list; duplicates count with their full size and no bytes."""
    sums = listed.agg(F.count("*").alias("files"), F.coalesce(F.sum("uncompressed_bytes"), F.lit(0)).alias("uncompressed_bytes"), F.coalesce(F.sum("compressed_bytes"), F.lit(0)).alias("compressed_bytes"))
    return sums.withColumn("ratio", ratio(F.col("uncompressed_bytes"), F.col("compressed_bytes")))


def by_size(listed: DataFrame) -> DataFrame:
    return listed.orderBy(F.desc("uncompressed_bytes"), component_order(F.col("path")))


def by_path(listed: DataFrame) -> DataFrame:
    return listed.orderBy(component_order(F.col("path")))


def search(listed: DataFrame, query: str) -> DataFrame:
    return listed.where(matches_search(F.col("path"), query))


def shown(listed: DataFrame, total_bytes: int) -> DataFrame:
    """The list as a report shows it."""
    return listed.select(ellipsis(F.col("path")).alias("path"), megabytes(F.col("uncompressed_bytes")).alias("size"), percent(F.col("uncompressed_bytes"), F.lit(total_bytes)).alias("share"))


def find(index: DataFrame, path: str) -> DataFrame:
    return index.where(F.col("relative_path") == path)


def entry_at(index: DataFrame, ordinal: int) -> DataFrame:
    """The entry at a place in path order; no row out of range."""
    return with_positions(index, [component_order(F.col("relative_path"))]).where(F.col("position") == ordinal).drop("position")
