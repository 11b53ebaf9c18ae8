"""Delta coding of 32-bit words and of vertex buffers.

Vertices and differences stay in the JVM; running sums of words and whole byte
strings go through numpy in Arrow batches.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, functions as F
from pyspark.sql.functions import arrow_udf
from pyspark.sql.types import ArrayType, BinaryType, LongType

WORD = 4294967296
SCALE = 1024


def encode_words(words: Column) -> Column:
    """Differences modulo 2^32 of an array of unsigned words held as longs."""
    return F.transform(words, lambda x, i: F.pmod(x - F.coalesce(F.get(words, i - 1), F.lit(0)), F.lit(WORD)))


@arrow_udf(ArrayType(LongType()))
def decode_words(deltas: pa.Array) -> pa.Array:
    """Running sums modulo 2^32, in time linear in the words; null from a null on."""
    sizes = np.array([0 if x is None else x for x in pc.list_value_length(deltas).to_pylist()], np.int64)
    flat = deltas.flatten()
    begins = np.cumsum(sizes) - sizes
    run = lambda x: (np.concatenate((np.zeros(1, x.dtype), np.cumsum(x, dtype=x.dtype))))
    sums, holes = run(flat.fill_null(0).to_numpy(zero_copy_only=False).astype(np.uint64)), run(np.asarray(flat.is_null()).astype(np.int64))
    out = (sums[1:] - np.repeat(sums[begins], sizes)) & np.uint64(WORD - 1)
    gone = holes[1:] > np.repeat(holes[begins], sizes)
    return pa.ListArray.from_arrays(pa.array(np.append(begins, len(flat)).astype(np.int32)), pa.array(out.astype(np.int64), mask=gone), mask=deltas.is_null())


def quantise(vertices: Column) -> Column:
    """Vertices times 1024 in single precision, cut toward zero; lossy."""
    return F.transform(vertices, lambda v: (v.cast("float") * F.lit(float(SCALE)).cast("float")).cast("int").cast("bigint"))


def encode_vertices(vertices: Column) -> Column:
    whole = quantise(vertices)
    return F.transform(whole, lambda x, i: x - F.coalesce(F.get(whole, i - 1), F.lit(0)))


def decode_vertices(deltas: Column) -> Column:
    start = F.struct(F.lit(0).cast("bigint").alias("acc"), F.array().cast("array<float>").alias("out"))

    def step(s: Column, x: Column) -> Column:
        acc = s["acc"] + x
        return F.struct(acc.alias("acc"), F.concat(s["out"], F.array((acc / F.lit(float(SCALE))).cast("float"))).alias("out"))

    return F.aggregate(deltas, start, step, lambda s: s["out"])


def encode_buffer(data: bytes) -> bytes:
    """Little-endian words as differences; up to three trailing bytes as they are."""
    whole = len(data) & ~3
    words = np.frombuffer(data, "<u4", whole // 4)
    return np.diff(words, prepend=np.uint32(0)).astype("<u4").tobytes() + data[whole:]


def decode_buffer(data: bytes) -> bytes:
    whole = len(data) & ~3
    return np.cumsum(np.frombuffer(data, "<u4", whole // 4), dtype=np.uint32).astype("<u4").tobytes() + data[whole:]


class BufferDecoder:
    """``decode_buffer`` of a buffer that comes in parts."""

    def __init__(self) -> None:
        self.rest, self.last = b"", np.uint32(0)

    def part(self, data: bytes) -> bytes:
        data = self.rest + data
        whole = len(data) & ~3
        words = np.cumsum(np.frombuffer(data, "<u4", whole // 4), dtype=np.uint32) + self.last
        self.rest, self.last = data[whole:], words[-1] if len(words) else self.last
        return words.astype("<u4").tobytes()

    def end(self) -> bytes:
        return self.rest


@arrow_udf(BinaryType())
def encode_bytes(data: pa.Array) -> pa.Array:
    return pa.array([None if x is None else encode_buffer(x) for x in data.to_pylist()], pa.binary())


@arrow_udf(BinaryType())
def decode_bytes(data: pa.Array) -> pa.Array:
    return pa.array([None if x is None else decode_buffer(x) for x in data.to_pylist()], pa.binary())
