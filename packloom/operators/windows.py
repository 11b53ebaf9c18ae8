"""Byte windows of files: strided, tumbling, content-defined."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

#: Bytes of contents whose chunks are put out at once; a larger file is put out alone.
PART_BYTES = 4 << 20


def window_hash(window: Column) -> Column:
    """MD5 over the window in hexadecimal, which SQL engines without byte strings can repeat."""
    return F.md5(F.hex(window))


def strided_windows(df: DataFrame, width: int, stride: int, scan: int | None = None, content: str = "content") -> DataFrame:
    """Full windows only: adds ``start`` and ``window``; shorter files give no row."""
    size = F.octet_length(content)
    if scan is not None:
        size = F.least(size, F.lit(scan))
    starts = F.when(size >= width, F.sequence(F.lit(0), size - width, F.lit(stride)))
    return df.withColumn("start", F.explode(starts)).withColumn("window", F.substring(F.col(content), F.col("start") + 1, F.lit(width)))


def tumbling_blocks(df: DataFrame, width: int, content: str = "content") -> DataFrame:
    """Consecutive blocks with a shorter last one: adds ``ordinal``, ``start`` and ``window``."""
    size = F.octet_length(content)
    count = F.ceil(size / width).cast("int")
    ordinals = F.when(size > 0, F.sequence(F.lit(0), count - 1))
    return df.withColumn("ordinal", F.explode(ordinals)).withColumn("start", F.col("ordinal") * width).withColumn("window", F.substring(F.col(content), F.col("start") + 1, F.lit(width)))


@lru_cache(4)
def gear_table(seed: int = 0x9E3779B97F4A7C15) -> np.ndarray:
    """256 words of 64 bits from a counter-based generator."""
    x = (np.arange(1, 257, dtype=np.uint64) * np.uint64(seed)).copy()
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    return x ^ (x >> np.uint64(31))


def cut_points(data: bytes, least: int, average: int, most: int) -> list[int]:
    """Ends of content-defined chunks by a gear hash with normalised chunking.

    The hash of a position covers the 64 bytes before it, so all hashes are
    computed at once and cuts depend on content alone.
    """
    n = len(data)
    if n <= least:
        return [n] if n else []
    gear = gear_table()[np.frombuffer(data, np.uint8)]
    h, step = gear.copy(), 1
    while step < 64:  # doubling: sum of gear[i - k] << k over 64 bytes
        h[step:] += h[:-step] << np.uint64(step)
        step *= 2
    bits = max(1, average.bit_length() - 1)
    top = lambda k: np.uint64(((1 << k) - 1) << (64 - k))
    hard, easy = np.flatnonzero((h & top(bits + 1)) == 0), np.flatnonzero((h & top(bits - 1)) == 0)
    cuts, at = [], 0
    while at < n:
        if n - at <= least:
            cuts.append(n)
            break
        middle, limit = at + average, min(at + most, n)
        end = limit
        k = np.searchsorted(hard, at + least)
        if k < len(hard) and hard[k] < min(middle, limit):
            end = int(hard[k]) + 1
        else:
            k = np.searchsorted(easy, min(middle, limit))
            if k < len(easy) and easy[k] < limit:
                end = int(easy[k]) + 1
        cuts.append(end)
        at = end
    return cuts


def content_chunks(df: DataFrame, key: list[str], least: int, average: int, most: int, content: str = "content") -> DataFrame:
    """Rows ``key.., ordinal, start, length, window`` of content-defined chunks; empty files give none."""
    kinds = {f.name: f.dataType.simpleString() for f in df.schema}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(batch: pa.RecordBatch, rows: list[tuple[int, int, int, bytes]]) -> pa.RecordBatch:
            of, ordinals, starts, windows = zip(*rows, strict=True)
            of = pa.array(of, pa.int64())
            return pa.RecordBatch.from_arrays([*(batch.column(k).take(of) for k in range(len(key))), pa.array(ordinals, pa.int32()), pa.array(starts, pa.int64()), pa.array(map(len, windows), pa.int64()), pa.array(windows, pa.binary())], [*key, "ordinal", "start", "length", "window"])

        for batch in batches:
            rows, held = [], 0
            for i in range(batch.num_rows):
                data = batch.column(len(key))[i].as_py() or b""
                if rows and held + len(data) > PART_BYTES:
                    yield out(batch, rows)
                    rows, held = [], 0
                cuts = cut_points(data, least, average, most)
                rows += [(i, k, a, data[a:b]) for k, (a, b) in enumerate(zip([0, *cuts[:-1]], cuts))]  # an empty file has no cuts
                held += len(data)
            if rows:
                yield out(batch, rows)

    return df.select(*key, content).mapInArrow(run, ", ".join(f"`{k}` {kinds[k]}" for k in key) + ", ordinal int, start long, length long, window binary")
