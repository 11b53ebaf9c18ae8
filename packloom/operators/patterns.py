"""Repeated byte patterns and their use."""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..sources.config import PATTERN_SCAN_BYTES, PATTERNS_KEPT
from .ordering import with_positions
from .windows import strided_windows, window_hash


def stratified_sample(df: DataFrame, order: list[Column], most: int) -> DataFrame:
    """Every n-th row in order, ``most`` at the most: a sampling operator."""
    placed = with_positions(df, order)
    step = max(1, df.count() // most)
    return placed.where((F.col("position") % step == 0) & (F.col("position") < step * most)).drop("position")


def mine(assets: DataFrame, width: int = 64, least: int = 2, scan: int = PATTERN_SCAN_BYTES) -> DataFrame:
    """Windows worth a dictionary entry: ``hash_hex, pattern, frequency, benefit``.

    A pattern has to occur ``least`` times within one file; its frequency counts
    all files.  The benefit is what references would save, 8 bytes and one copy less.
    """
    width, least = max(width, 32), max(least, 2)
    windows = strided_windows(assets, width, max(1, width // 4), scan).select("relative_path", window_hash(F.col("window")).alias("pattern_hash"), "window")
    per_file = windows.groupBy("relative_path", "pattern_hash").agg(F.count("*").alias("n"), F.first("window").alias("window"))
    merged = per_file.groupBy("pattern_hash").agg(F.sum("n").alias("frequency"), F.max("n").alias("densest"), F.first("window").alias("pattern"))
    size = F.octet_length("pattern")
    benefit = F.greatest(F.col("frequency") * size - (size + 8), F.lit(0))
    return merged.where(F.col("densest") >= least).withColumn("benefit", benefit).where("benefit > 0").select("pattern_hash", "pattern", "frequency", "benefit")


def top(mined: DataFrame, kept: int = PATTERNS_KEPT) -> DataFrame:
    """The ``kept`` most useful patterns, numbered; equal benefits by hash."""
    best = mined.orderBy(F.desc("benefit"), "pattern_hash").limit(kept)
    return best.withColumn("id", (F.row_number().over(Window.orderBy(F.desc("benefit"), "pattern_hash")) - 1).cast("int"))


def segments(data: bytes, automaton: ahocorasick.Automaton) -> list[tuple[bytes | None, int | None]]:
    """Leftmost-longest matches as references, what lies between as literals."""
    best: dict[int, tuple[int, int]] = {}
    for end, (number, size) in automaton.iter(data.decode("latin-1")):
        start = end - size + 1
        if start not in best or best[start][0] < size:
            best[start] = (size, number)
    out, at = [], 0
    for start in sorted(best):
        if start < at:
            continue
        size, number = best[start]
        if start > at:
            out.append((data[at:start], None))
        out.append((None, number))
        at = start + size
    if at < len(data):
        out.append((data[at:], None))
    return out


def apply_patterns(df: DataFrame, patterns: DataFrame, key: str = "relative_path", content: str = "content") -> DataFrame:
    """``key, ordinal, literal, ref``: contents cut into literals and pattern references.

    ``patterns`` is at most ``PATTERNS_KEPT`` rows, which every task receives.
    """
    table = [(r["id"], bytes(r["pattern"])) for r in patterns.select("id", "pattern").limit(PATTERNS_KEPT).collect()]
    kind = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = ahocorasick.Automaton()
        for number, pattern in table:
            automaton.add_word(pattern.decode("latin-1"), (number, len(pattern)))
        if table:
            automaton.make_automaton()
        for batch in batches:
            for i in range(batch.num_rows):
                data = batch.column(1)[i].as_py() or b""
                parts = segments(data, automaton) if table else [(data, None)] * bool(data)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array([i] * len(parts), pa.int64())), pa.array(range(len(parts)), pa.int32()), pa.array([x for x, _ in parts], pa.binary()), pa.array([y for _, y in parts], pa.int32())], [key, "ordinal", "literal", "ref"])

    return df.select(key, content).mapInArrow(run, f"`{key}` {kind}, ordinal int, literal binary, ref int")


def resolve_segments(parts: DataFrame, patterns: DataFrame, key: str = "relative_path") -> DataFrame:
    """Literals and patterns put together again, as ``key, content_hex``; an unknown reference gives null."""
    known = F.broadcast(patterns.select(F.col("id").alias("ref"), "pattern").limit(PATTERNS_KEPT))
    filled = parts.join(known, "ref", "left").withColumn("piece", F.hex(F.coalesce("literal", "pattern")))
    whole = filled.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("ordinal", "piece"))).alias("p"), F.count_if(F.col("piece").isNull()).alias("bad"))
    return whole.select(key, F.when(F.col("bad") == 0, F.array_join(F.col("p.piece"), "")).alias("content_hex"))
