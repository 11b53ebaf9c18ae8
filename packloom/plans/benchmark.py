"""Codecs and whole packages side by side."""

from __future__ import annotations

import time

from pyspark.sql import DataFrame, functions as F

from ..operators import codec, ordering
from ..sources.config import CDC_AVG, CDC_MAX, CDC_MIN, Settings
from . import package

#: Packages without a type's own settings, and with them.
PACKAGES = {"package-baseline": Settings(texture_level=3, audio_level=3, mesh_delta=False), "package-optimised": Settings()}


def packages(assets: DataFrame, cdc: tuple[int, int, int] = (CDC_MIN, CDC_AVG, CDC_MAX)) -> DataFrame:
    """``codec, input_bytes, compressed_bytes, compress_ms, decompress_ms, ratio`` of a package built and verified with each settings.

    Bytes are those of the package's files; times are wall-clock, unlike the codecs' sums over tasks.
    """
    spark, rows = assets.sparkSession, []
    size = assets.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    for name, settings in PACKAGES.items():
        path = ordering.scratch(spark)
        try:
            times = [time.perf_counter()]
            package.build(assets, path, settings, cdc)
            times.append(time.perf_counter())
            bad = package.verify(package.open_package(spark, path)).where("not ok").count()
            times.append(time.perf_counter())
            if bad:
                raise ValueError(f"{bad} entries of {name} do not verify")
            stored = package.folder_bytes(spark, path)
        finally:
            package.delete(spark, path)
        rows.append((name, size, stored, *(round((b - a) * 1_000) for a, b in zip(times, times[1:], strict=False)), size / stored if stored else 0.0))
    return spark.createDataFrame(rows, "codec string, input_bytes long, compressed_bytes long, compress_ms long, decompress_ms long, ratio double")


def run(assets: DataFrame, levels: tuple[int, ...] = (3, 9, 19), cdc: tuple[int, int, int] = (CDC_MIN, CDC_AVG, CDC_MAX)) -> DataFrame:
    """A row a codec and a row a package."""
    return codec.benchmark(assets, levels).unionByName(packages(assets, cdc))
