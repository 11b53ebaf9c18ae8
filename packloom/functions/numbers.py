"""Ratios, percentages and sizes as shown in reports."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def ratio(total: Column, part: Column) -> Column:
    """total / part, 0 where part is 0."""
    return F.when(part == 0, F.lit(0.0)).otherwise(total.cast("double") / part)


def percent(part: Column, total: Column) -> Column:
    return F.when(total == 0, F.lit(0.0)).otherwise(part.cast("double") / total * 100)


def megabytes(size: Column) -> Column:
    """``---`` for 0, else MiB with one digit."""
    return F.when(size == 0, "---").otherwise(F.format_string("%.1f MB", size / 1048576.0))


def fraction_done(done: Column, total: Column) -> Column:
    return F.when(total == 0, F.lit(0.0)).otherwise(F.least(done.cast("double") / total, F.lit(1.0)))


def hex_lower(data: Column) -> Column:
    return F.lower(F.hex(data))
