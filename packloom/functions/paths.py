"""Asset paths: extension, order, safety, display."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def basename(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def extension(path: Column) -> Column:
    """Lower-case text behind the last dot of the file name; '' if only a leading dot or none."""
    return F.lower(F.regexp_extract(basename(path), r"^.+\.([^.]*)$", 1))


def component_order(path: Column) -> Column:
    """Sort key under which ``a/b`` comes before ``a-b``: paths compare component by component."""
    return F.split(path, "/")


def relative_to(path: Column, root: str) -> Column:
    """The path below ``root``, or the whole path where it lies elsewhere."""
    prefix = root.rstrip("/") + "/"
    return F.when(F.startswith(path, F.lit(prefix)), F.substring(path, len(prefix) + 1, 1 << 30)).otherwise(path)


def is_safe_relative(path: Column) -> Column:
    """Only ordinary components: not absolute, no drive, no ``.`` or ``..``; empty is unsafe."""
    parts = F.split(path, r"[/\\]")
    return F.coalesce((path != "") & ~F.rlike(path, F.lit(r"^([/\\]|[A-Za-z]:)")) & ~F.array_contains(parts, "..") & ~F.array_contains(parts, "."), F.lit(False))


def ellipsis(path: Column, limit: int = 54) -> Column:
    """Paths longer than ``limit`` as an ellipsis and their last ``limit - 1`` characters."""
    return F.when(F.char_length(path) > limit, F.concat(F.lit("…"), F.right(path, F.lit(limit - 1)))).otherwise(path)


def sidecar(path: Column, suffix: str) -> Column:
    """The file name with its extension replaced by ``suffix``, or with it added if there was none."""
    return F.concat(F.regexp_replace(path, r"(?<=[^/])\.[^./]*$", ""), F.lit("." + suffix))


def matches_search(path: Column, query: str) -> Column:
    """Case-insensitive substring; an empty query matches all."""
    return F.contains(F.lower(path), F.lit(query.lower()))
