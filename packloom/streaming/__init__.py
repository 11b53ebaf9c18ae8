"""An extension: the duplicate filter over a stream of assets."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery


def new_contents(assets: DataFrame, time_col: str = "arrived", delay: str = "1 hour") -> DataFrame:
    """First arrivals of each size and hash; state older than ``delay`` is given up."""
    return assets.withWatermark(time_col, delay).dropDuplicatesWithinWatermark(["size", "hash_hex"])


def store_stream(assets: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append first arrivals to a table, exactly once."""
    return new_contents(assets).writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
