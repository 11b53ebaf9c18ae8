"""64-bit content hashes: XXH3 held as a signed long, shown unsigned."""

from __future__ import annotations

from decimal import Decimal

import pyarrow as pa
import xxhash
from pyspark.sql import Column, functions as F
from pyspark.sql.functions import arrow_udf
from pyspark.sql.types import LongType


def signed(value: int) -> int:
    return value - (1 << 64) if value >> 63 else value


@arrow_udf(LongType())
def xxh3_64(data: pa.Array) -> pa.Array:
    """XXH3-64, which the built-in ``xxhash64`` is not."""
    return pa.array([None if x is None else signed(xxhash.xxh3_64_intdigest(x)) for x in data.to_pylist()], pa.int64())


def unsigned(value: Column) -> Column:
    """A 64-bit hash in decimal digits as an unsigned number."""
    return F.when(value < 0, (value.cast("decimal(20,0)") + F.lit(Decimal(1 << 64))).cast("decimal(20,0)")).otherwise(value.cast("decimal(20,0)"))
