"""Differences between versions of a file tree, patches and incremental builds."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .chunks import distinct_hashes


def diff(old: DataFrame, new: DataFrame, hash_col: str = "hash_hex") -> DataFrame:
    """``relative_path, kind, old_size, new_size``; kind is Added, Modified, Removed or Unchanged."""
    o = old.select("relative_path", F.col("size").alias("old_size"), F.col(hash_col).alias("old_hash"))
    n = new.select("relative_path", F.col("size").alias("new_size"), F.col(hash_col).alias("new_hash"))
    both = o.join(n, "relative_path", "full_outer")
    kind = F.when(F.col("old_hash").isNull(), "Added").when(F.col("new_hash").isNull(), "Removed").when(F.col("old_hash") == F.col("new_hash"), "Unchanged").otherwise("Modified")
    return both.select("relative_path", kind.alias("kind"), "old_size", "new_size")


def changes(old: DataFrame, new: DataFrame) -> DataFrame:
    """Entries of a patch: added and modified files, then removed ones."""
    found = diff(old, new)
    return found.where(F.col("kind").isin("Added", "Modified")).unionByName(found.where(F.col("kind") == "Removed"))


def removed(old: DataFrame, new: DataFrame) -> DataFrame:
    return old.select("relative_path").join(new.select("relative_path"), "relative_path", "left_anti")


def new_chunks(old_chunks: DataFrame, new_chunks_: DataFrame) -> DataFrame:
    """Distinct chunks of the new version that no file of the old one has."""
    fresh = new_chunks_.join(distinct_hashes(old_chunks), "chunk_hash", "left_anti")
    return fresh.groupBy("chunk_hash").agg(F.first("length").alias("length"), F.first("window").alias("window"))


def patch_references(old_chunks: DataFrame, new_chunks_: DataFrame, changed: DataFrame) -> DataFrame:
    """References of added and modified files: where each chunk comes from.

    ``source_path`` and ``source_ordinal`` name a place in the old version that
    holds the chunk, null for chunks that the patch itself carries.  The same
    path is preferred; chunks that moved between files are found too.
    """
    files = changed.where(F.col("kind").isin("Added", "Modified")).select("relative_path")
    refs = new_chunks_.join(files, "relative_path", "left_semi").select("relative_path", "ordinal", "chunk_hash", "length")
    near = old_chunks.groupBy("relative_path", "chunk_hash").agg(F.min("ordinal").alias("near_ordinal"))
    far = old_chunks.groupBy("chunk_hash").agg(F.min(F.struct("relative_path", "ordinal")).alias("far"))
    joined = refs.join(near, ["relative_path", "chunk_hash"], "left").join(far, "chunk_hash", "left")
    same = F.col("near_ordinal").isNotNull()
    return joined.select("relative_path", "ordinal", "chunk_hash", "length", F.when(same, F.col("relative_path")).otherwise(F.col("far.relative_path")).alias("source_path"), F.when(same, F.col("near_ordinal")).otherwise(F.col("far.ordinal")).alias("source_ordinal"))


def common_hashes(a: DataFrame, b: DataFrame) -> DataFrame:
    return distinct_hashes(a).intersect(distinct_hashes(b))


def all_hashes(a: DataFrame, b: DataFrame) -> DataFrame:
    return distinct_hashes(a.select("chunk_hash").union(b.select("chunk_hash")))


def incremental_plan(assets: DataFrame, previous: DataFrame, hash_col: str = "hash_hex") -> DataFrame:
    """``relative_path, size, action``: reuse where size and hash are those of the previous build."""
    before = previous.select("relative_path", F.col("size").alias("__size"), F.col(hash_col).alias("__hash"))
    same = (F.col("size") == F.col("__size")) & (F.col(hash_col) == F.col("__hash"))
    return assets.join(before, "relative_path", "left").select("relative_path", "size", F.when(same, "reuse").otherwise("recompress").alias("action"))


def incremental_stats(plan: DataFrame, previous: DataFrame) -> DataFrame:
    """total, reused, recompressed, and two counts of deleted entries.

    ``deleted`` counts paths that are gone; ``deleted_by_difference`` is old
    entries less new ones, at least 0, which hides files that came and went together.
    """
    gone = previous.select("relative_path").join(plan.select("relative_path"), "relative_path", "left_anti").agg(F.count("*").alias("deleted"))
    olds = previous.agg(F.count("*").alias("olds"))
    sums = plan.agg(F.count("*").alias("total"), F.count_if(F.col("action") == "reuse").alias("reused"), F.count_if(F.col("action") == "recompress").alias("recompressed"))
    joined = sums.crossJoin(F.broadcast(gone)).crossJoin(F.broadcast(olds))  # one row each
    return joined.select("total", "reused", "recompressed", "deleted", F.greatest(F.col("olds") - F.col("total"), F.lit(0)).alias("deleted_by_difference"))


def reuse_rows(old_rows: DataFrame, plan: DataFrame) -> DataFrame:
    """Rows of the previous build that are copied as they are."""
    return old_rows.join(plan.where(F.col("action") == "reuse").select("relative_path"), "relative_path", "left_semi")


def manifest_rows(assets: DataFrame, index: DataFrame, version: int) -> DataFrame:
    """What a build remembers of each file: ``relative_path, version, mtime_nanos, file_size, content_hash, index_entry``.

    The time is 0 where the source has none.
    """
    mtime = F.col("mtime_nanos") if "mtime_nanos" in assets.columns else F.lit(0)
    files = assets.select("relative_path", F.lit(version).alias("version"), F.coalesce(mtime, F.lit(0)).cast("long").alias("mtime_nanos"), F.col("size").alias("file_size"), F.col("hash_hex").alias("content_hash"))
    entries = index.select("relative_path", F.struct(*index.columns).alias("index_entry"))
    return files.join(entries, "relative_path", "left")


def manifest_insert(rows: DataFrame, newer: DataFrame) -> DataFrame:
    """``rows`` with those of ``newer`` added or in the place of rows of the same path."""
    return rows.join(newer.select("relative_path"), "relative_path", "left_anti").unionByName(newer)
