"""The report over a folder: totals, types, duplicates, similar files."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions.numbers import percent
from ..operators import duplicates, similarity


def analyze(assets: DataFrame) -> DataFrame:
    """One row a type with its share, and the totals and duplicates of the whole beside it."""
    types = duplicates.type_breakdown(assets)
    whole = types.agg(F.sum("files").alias("total_files"), F.sum("bytes").alias("total_bytes"))
    waste = duplicates.waste(duplicates.clusters(assets))
    joined = types.crossJoin(F.broadcast(whole)).crossJoin(F.broadcast(waste))  # four rows by one by one
    return joined.withColumn("percent", percent(F.col("bytes"), F.col("total_bytes")))


def report(assets: DataFrame, width: int = 4_096, least: int = 3) -> dict[str, DataFrame]:
    """The parts of the report as tables; ``to_json`` turns rows into text."""
    found = duplicates.clusters(assets)
    return {"types": duplicates.type_breakdown(assets), "totals": duplicates.totals(assets), "duplicates": found, "waste": duplicates.waste(found), "similar": similarity.similar_pairs(assets, width, least)}


def findings(assets: DataFrame, width: int = 4_096, least: int = 3) -> DataFrame:
    """``kind, path, other, amount``: a row a copy with its original and size, a row a similar pair with its common blocks."""
    copies = duplicates.duplicate_map(assets).join(assets.select("relative_path", "size"), "relative_path")
    pairs = similarity.similar_pairs(assets, width, least)
    return copies.select(F.lit("duplicate").alias("kind"), F.col("relative_path").alias("path"), F.col("duplicate_of").alias("other"), F.col("size").alias("amount")).unionByName(pairs.select(F.lit("similar").alias("kind"), F.col("path_a").alias("path"), F.col("path_b").alias("other"), F.col("shared").alias("amount")))


def as_json(df: DataFrame) -> DataFrame:
    return df.select(F.to_json(F.struct(*df.columns)).alias("json"))
