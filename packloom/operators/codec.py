"""zstd over chunks, with dictionaries by class, in Arrow batches."""

from __future__ import annotations

import time
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.functions import arrow_udf
from pyspark.sql.types import BinaryType

from ..functions.classify import dict_class, stored_raw
from ..functions.delta import encode_buffer
from ..functions.paths import component_order
from ..sources.config import DICT_BYTES, DICT_MAX_SAMPLES, DICT_MIN_SAMPLES, DICT_SAMPLE_BYTES, LARGE_FILE


def dict_samples(assets: DataFrame) -> DataFrame:
    """The first files of each dictionary class in path order, their first bytes: ``dict_class, rank, sample``.

    A class with fewer than the least number of samples has none.
    """
    able = assets.where((F.col("size") < LARGE_FILE) & ~stored_raw(F.col("asset_type"), F.col("relative_path"))).select(dict_class(F.col("asset_type")).alias("dict_class"), "relative_path", F.substring("content", 1, DICT_SAMPLE_BYTES).alias("sample"))
    ranked = able.withColumn("rank", F.row_number().over(Window.partitionBy("dict_class").orderBy(component_order(F.col("relative_path"))))).where(F.col("rank") <= DICT_MAX_SAMPLES)
    enough = ranked.groupBy("dict_class").agg(F.count("*").alias("n")).where(F.col("n") >= DICT_MIN_SAMPLES).select("dict_class")
    return ranked.join(F.broadcast(enough), "dict_class", "left_semi")  # three classes


def train_dicts(samples: DataFrame) -> dict[str, bytes]:
    """One dictionary a class from at most 100 samples of 8 KiB each; a class that cannot be trained has none."""
    found: dict[str, list[bytes]] = {}
    for row in samples.orderBy("dict_class", "rank").select("dict_class", "sample").collect():
        found.setdefault(row["dict_class"], []).append(bytes(row["sample"]))
    out = {}
    for name, parts in found.items():
        try:
            out[name] = zstandard.train_dictionary(DICT_BYTES, parts).as_bytes()
        except zstandard.ZstdError:
            continue
    return out


def compress(data: str | Column, level: str | Column, dict_name: str | Column, dicts: dict[str, bytes]) -> Column:
    @arrow_udf(BinaryType())
    def run(data: pa.Array, level: pa.Array, name: pa.Array) -> pa.Array:
        made: dict[tuple[int, str], zstandard.ZstdCompressor] = {}
        out = []
        for x, k, n in zip(data.to_pylist(), level.to_pylist(), name.to_pylist(), strict=True):
            if x is None:
                out.append(None)
                continue
            if (k, n) not in made:
                made[k, n] = zstandard.ZstdCompressor(level=k, dict_data=zstandard.ZstdCompressionDict(dicts[n]) if n in dicts else None)
            out.append(made[k, n].compress(x))
        return pa.array(out, pa.binary())

    return run(data, level, dict_name)


def decompress(data: str | Column, dict_name: str | Column, dicts: dict[str, bytes], most: str | Column | None = None) -> Column:
    """The bytes, or null where a frame is damaged, its dictionary is missing, or it says to hold more than ``most`` bytes."""

    @arrow_udf(BinaryType())
    def run(data: pa.Array, name: pa.Array, most: pa.Array) -> pa.Array:
        made: dict[str, zstandard.ZstdDecompressor] = {}
        out = []
        for x, n, limit in zip(data.to_pylist(), name.to_pylist(), most.to_pylist(), strict=True):
            if n not in made:
                made[n] = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(dicts[n]) if n in dicts else None)
            try:
                large = x is not None and limit is not None and zstandard.frame_content_size(x) > limit
                out.append(None if x is None or large else made[n].decompress(x))
            except zstandard.ZstdError:
                out.append(None)
        return pa.array(out, pa.binary())

    return run(data, dict_name, F.lit(None).cast("long") if most is None else most)


def benchmark(assets: DataFrame, levels: tuple[int, ...] = (3, 9, 19)) -> DataFrame:
    """``codec, input_bytes, compressed_bytes, compress_ms, decompress_ms, ratio`` for each level and for delta-coded meshes.

    Times are sums over tasks.
    """
    codecs = [(f"zstd-{k}", k, False) for k in levels] + [("zstd-3-mesh-delta", 3, True)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, kinds = [x or b"" for x in batch.column("content").to_pylist()], batch.column("asset_type").to_pylist()
            rows = []
            for name, level, delta in codecs:
                c, d = zstandard.ZstdCompressor(level=level), zstandard.ZstdDecompressor()
                t0 = time.perf_counter()
                packed = [c.compress(encode_buffer(x) if delta and k == "Mesh" else x) for x, k in zip(data, kinds, strict=True)]
                t1 = time.perf_counter()
                for x in packed:
                    d.decompress(x)
                t2 = time.perf_counter()
                rows.append((name, sum(map(len, data)), sum(map(len, packed)), (t1 - t0) * 1000, (t2 - t1) * 1000))
            kinds_ = (pa.string(), pa.int64(), pa.int64(), pa.float64(), pa.float64())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds_, strict=True)], ["codec", "input_bytes", "compressed_bytes", "c_ms", "d_ms"])

    parts = assets.select("asset_type", "content").mapInArrow(run, "codec string, input_bytes long, compressed_bytes long, c_ms double, d_ms double")
    sums = parts.groupBy("codec").agg(F.sum("input_bytes").alias("input_bytes"), F.sum("compressed_bytes").alias("compressed_bytes"), F.round(F.sum("c_ms")).cast("long").alias("compress_ms"), F.round(F.sum("d_ms")).cast("long").alias("decompress_ms"))
    return sums.withColumn("ratio", F.when(F.col("compressed_bytes") == 0, 0.0).otherwise(F.col("input_bytes") / F.col("compressed_bytes")))
