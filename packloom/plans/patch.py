"""Patches between two versions of a folder: changed entries, chunks the old version lacks, and where the others lie."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.hashing import xxh3_64
from ..operators import codec, versions
from ..operators.windows import content_chunks
from ..sources.config import CDC_AVG, CDC_MAX, CDC_MIN, PATCH_LEVEL
from .package import published

TABLES = ["entries", "refs", "chunks"]
VERSION = 1


def _chunks(assets: DataFrame, cdc: tuple[int, int, int]) -> DataFrame:
    return content_chunks(assets, ["relative_path"], *cdc).withColumn("chunk_hash", xxh3_64("window"))


def build_patch(old: DataFrame, new: DataFrame, cdc: tuple[int, int, int] = (CDC_MIN, CDC_AVG, CDC_MAX)) -> dict[str, DataFrame]:
    """``entries``, ``refs`` and ``chunks`` (each new chunk once, compressed)."""
    changed = versions.changes(old, new)
    hashes = new.select("relative_path", F.col("hash_hex").alias("new_hash"))
    before, after = _chunks(old, cdc), _chunks(new, cdc)
    fresh = versions.new_chunks(before, after.join(changed.select("relative_path"), "relative_path", "left_semi"))
    packed = fresh.select("chunk_hash", "length", codec.compress("window", F.lit(PATCH_LEVEL), F.lit(""), {}).alias("data"))
    return {"entries": changed.join(hashes, "relative_path", "left"), "refs": versions.patch_references(before, after, changed), "chunks": packed}


def apply_patch(old: DataFrame, patch: dict[str, DataFrame], cdc: tuple[int, int, int] = (CDC_MIN, CDC_AVG, CDC_MAX)) -> DataFrame:
    """The new version: ``relative_path, content, ok``; unchanged files pass through, ``ok`` is the hash check."""
    before = _chunks(old, cdc).select(F.col("relative_path").alias("source_path"), F.col("ordinal").alias("source_ordinal"), F.col("window").alias("old_window"))
    carried = patch["chunks"].select("chunk_hash", codec.decompress("data", F.lit(""), {}).alias("new_window"))
    refs = patch["refs"].join(before, ["source_path", "source_ordinal"], "left").join(carried, "chunk_hash", "left")
    piece = F.struct("ordinal", F.hex(F.coalesce("old_window", "new_window")).alias("piece"))
    whole = refs.groupBy("relative_path").agg(F.array_sort(F.collect_list(piece)).alias("p"))
    entries = patch["entries"].where(F.col("kind") != "Removed").join(whole, "relative_path", "left")
    built = entries.select("relative_path", F.unhex(F.coalesce(F.array_join(F.col("p.piece"), ""), F.lit(""))).alias("content"), "new_hash")
    built = built.select("relative_path", "content", (F.md5("content") == F.col("new_hash")).alias("ok"))
    same = old.join(patch["entries"].select("relative_path"), "relative_path", "left_anti").select("relative_path", "content", F.lit(True).alias("ok"))
    return same.unionByName(built)


def write_patch(spark: SparkSession, patch: dict[str, DataFrame], path: str, cdc: tuple[int, int, int] = (CDC_MIN, CDC_AVG, CDC_MAX)) -> None:
    """Write a patch as a folder that appears whole or not at all; its head names the version and how chunks were cut."""
    with published(spark, path) as temp:
        for name in TABLES:
            patch[name].write.parquet(f"{temp}/{name}")
        head = spark.createDataFrame([(VERSION, *cdc)], "version int, cdc_min int, cdc_avg int, cdc_max int")
        head.coalesce(1).write.parquet(f"{temp}/head")


def open_patch(spark: SparkSession, path: str) -> tuple[dict[str, DataFrame], tuple[int, int, int]]:
    """The tables of a patch and its chunk sizes; a missing table or a newer version is an error."""
    head = spark.read.parquet(f"{path}/head").first()
    if head is None or head["version"] > VERSION:
        raise ValueError(f"not a patch of version {VERSION} or before: {path}")
    return {name: spark.read.parquet(f"{path}/{name}") for name in TABLES}, (head["cdc_min"], head["cdc_avg"], head["cdc_max"])
