"""Chunk store: each distinct chunk once, files as ordered references."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from ..functions.paths import component_order
from .ordering import with_positions
from .windows import tumbling_blocks, window_hash


def fixed_chunks(assets: DataFrame, width: int) -> DataFrame:
    """Blocks of fixed size: ``relative_path, ordinal, chunk_hash, length, window``."""
    return tumbling_blocks(assets, width).select("relative_path", "ordinal", window_hash(F.col("window")).alias("chunk_hash"), F.octet_length("window").cast("long").alias("length"), "window")


def distinct_hashes(chunks: DataFrame) -> DataFrame:
    return chunks.select("chunk_hash").distinct()


def first_occurrences(chunks: DataFrame) -> DataFrame:
    """Per hash the first reference in path and chunk order, and how many there are."""
    place = F.struct(component_order(F.col("relative_path")).alias("p"), F.col("ordinal").alias("o"))
    firsts = chunks.groupBy("chunk_hash").agg(F.min(place).alias("at"), F.count("*").alias("refs"), F.first("length").alias("length"))
    return firsts.select("chunk_hash", F.array_join("at.p", "/").alias("relative_path"), F.col("at.o").alias("ordinal"), "refs", "length")


def references(chunks: DataFrame) -> DataFrame:
    """Every reference, ``stored`` where the chunk is kept, a hit on the pool elsewhere."""
    firsts = first_occurrences(chunks).select("chunk_hash", F.col("relative_path").alias("owner"), F.col("ordinal").alias("owner_ordinal"))
    joined = chunks.join(firsts, "chunk_hash")
    return joined.withColumn("stored", (F.col("relative_path") == F.col("owner")) & (F.col("ordinal") == F.col("owner_ordinal")))


def body_offsets(stored: DataFrame) -> DataFrame:
    """Stored chunks with their place in the body: a running sum of lengths before each."""
    order = [component_order(F.col("relative_path")), F.col("ordinal")]
    return with_positions(stored, order, "length", position="body_ordinal", offset="body_offset")


def manifest(chunks: DataFrame) -> DataFrame:
    """Assets, bytes, distinct chunks, repeated references and bytes these save."""
    per_hash = chunks.groupBy("chunk_hash").agg(F.count("*").alias("refs"), F.first("length").alias("length"))
    sums = per_hash.agg(F.count("*").alias("unique_chunk_count"), F.coalesce(F.sum(F.col("refs") - 1), F.lit(0)).alias("dedup_hits"), F.coalesce(F.sum((F.col("refs") - 1) * F.col("length")), F.lit(0)).alias("dedup_bytes_saved"), F.coalesce(F.sum("length"), F.lit(0)).alias("stored_bytes"))
    files = chunks.agg(F.countDistinct("relative_path").alias("asset_count"), F.coalesce(F.sum("length"), F.lit(0)).alias("total_uncompressed_bytes"))
    return files.crossJoin(F.broadcast(sums))  # one row each


def reassemble(refs: DataFrame, store: DataFrame, key: str = "relative_path") -> DataFrame:
    """Contents in hexadecimal from ordered references and stored chunks: ``key, size, content_hex``; a missing chunk gives null."""
    joined = refs.select(key, "ordinal", "chunk_hash").join(store.select("chunk_hash", F.hex("window").alias("piece"), F.octet_length("window").cast("long").alias("n")), "chunk_hash", "left")
    whole = joined.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("ordinal", F.coalesce("piece", F.lit("")).alias("piece")))).alias("p"), F.count_if(F.col("piece").isNull()).alias("missing"), F.sum("n").alias("size"))
    return whole.select(key, "size", F.when(F.col("missing") == 0, F.array_join(F.col("p.piece"), "")).alias("content_hex"))


def bomb_guard(refs: DataFrame, limit: int, key: str = "relative_path") -> DataFrame:
    """Files whose chunks would grow beyond ``limit`` bytes, with the first ordinal at which they do."""
    running = refs.withColumn("running", F.sum("length").over(Window.partitionBy(key).orderBy("ordinal")))
    return running.where(F.col("running") > limit).groupBy(key).agg(F.min("ordinal").alias("ordinal"))
