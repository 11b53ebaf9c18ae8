"""Repeated passages by overlapping three-line windows.

A line ends with a line break or a sentence, whichever comes first, so a passage
is found wherever it stands in a paragraph.  Every three consecutive lines make
a window; a text of fewer lines is one window.  A window's first occurrence, by
id and position, stays; lines covered by any later occurrence go, overlapping
windows merging into longer passages.

A passage in running text may hold few whole lines or none.  For these, words
are cut by content as well (the least hash of every ``SPAN`` words begins a
piece), and pieces of ``LEAST_WORDS`` to ``LEAST_WORDS + SPAN - 1`` words in a
row are windows of their own.  Cuts depend on at most ``SPAN - 1`` words to
either side, so every passage of ``LEAST_WORDS + 4 * SPAN - 3`` (49) words holds
such a window wherever it stands.

Windows are shuffled as (64-bit hash, id, position), summed by hash before the
shuffle; only texts that lose something meet the positions to remove, by id.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from .batches import by_parts, parts
from .shingles import WordHasher, _finish
from .staging import Steps, stage

WINDOW = 3
#: Words among which one begins a piece, and the least words of a window of pieces.
SPAN, LEAST_WORDS = 8, 20
#: Texts and bytes of them that are cut at once.
PART_ROWS, PART_BYTES = 1_000, 4 << 20
#: A table of at most so many ids is broadcast; it is counted first.
BROADCAST_IDS = 1_000_000
_LINE_END = re.compile(r"[.!?][ \t]+|\n")
_SPACE = " \t\n\r"
_WORD = re.compile(r"\S+")
_BASE = 0x9E3779B97F4A7C15
_BACK = pow(_BASE, -1, 1 << 64)


def lines(text: str) -> list[str]:
    """Lines with their separators; joined they are the text."""
    out, at = [], 0
    for m in _LINE_END.finditer(text):
        out.append(text[at : m.end()])
        at = m.end()
    if at < len(text):
        out.append(text[at:])
    return out


def _line_windows(part: pa.RecordBatch) -> pa.RecordBatch:
    """Hash, key, and twice the first line, one more if the text held it before, of every window of whole lines."""
    mix = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9))
    hashed = xxhash.xxh3_64_intdigest
    blank = hashed(b"")
    each, sizes = [], []
    for x in part.column(1):
        found = [hashed(line.strip(_SPACE).encode()) for line in lines(x.as_py())]
        found += [blank] * (WINDOW - len(found))
        sizes.append(len(found))
        each += found
    h, sizes = np.array(each, np.uint64), np.array(sizes, np.int64)
    row = np.repeat(np.arange(len(sizes)), sizes)
    at = np.arange(len(h)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    whole = np.flatnonzero(at <= sizes[row] - WINDOW)
    key = np.zeros(len(whole), np.uint64)
    empty = np.ones(len(whole), bool)
    for k in range(WINDOW):
        key = (key ^ (key >> np.uint64(29))) * mix[1] + (h[whole + k] ^ (h[whole + k] >> np.uint64(32))) * mix[k]
        empty &= h[whole + k] == blank
    whole, key = whole[~empty], key[~empty]
    order = np.lexsort((whole, key, row[whole]))
    same = np.zeros(len(whole), bool)
    a, b = order[1:], order[:-1]
    same[a] = (key[a] == key[b]) & (row[whole[a]] == row[whole[b]])
    return pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), part.column(0).take(pa.array(row[whole])), pa.array(2 * at[whole] + same)], ["h", "key", "at"])


def pieces(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First words of the windows of pieces, ascending, and the words after their last; ``h`` hashes a text's words."""
    if len(h) < SPAN:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    n = len(h) - SPAN + 1
    best, least = np.zeros(n, np.int64), h[:n].copy()
    for k in range(1, SPAN):
        here = h[k : k + n] <= least
        best[here], least[here] = k, h[k : k + n][here]
    begins = best + np.arange(n)
    begins = begins[np.concatenate(([True], begins[1:] != begins[:-1]))]
    at = np.searchsorted(begins, begins + LEAST_WORDS)
    whole = at < len(begins)
    return begins[whole], begins[at[whole]]


def _word_hashes(words: list[str], hasher: WordHasher) -> np.ndarray:
    return np.fromiter(map(hasher.__getitem__, words), np.uint64, len(words))


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.cumprod(out, dtype=np.uint64)


def _piece_windows(batch: pa.RecordBatch, hasher: WordHasher) -> Iterator[pa.RecordBatch]:
    """As :func:`_line_windows`, with -1 less the first word in place of the first line."""
    for row, x in enumerate(batch.column(1)):
        h = _finish(_word_hashes(x.as_py().split(), hasher))
        first, after = pieces(h)
        if not len(first):
            continue
        sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(h * _powers(_BASE, len(h)), dtype=np.uint64)))
        key = _finish((sums[after] - sums[first]) * _powers(_BACK, len(h))[first] + (after - first).astype(np.uint64))
        _, earliest = np.unique(key, return_index=True)
        again = np.ones(len(key), bool)
        again[earliest] = False
        yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), batch.column(0).take(pa.array([row] * len(key), pa.int64())), pa.array(2 * (-1 - first) + again)], ["h", "key", "at"])


def _windows(within_lines: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = WordHasher()
        for batch in batches:
            for part in parts(batch, 1, PART_ROWS, PART_BYTES):
                yield _line_windows(part)
                if within_lines and (made := list(_piece_windows(part, hasher))):
                    yield from pa.Table.from_batches(made).combine_chunks().to_batches()
        pa.default_memory_pool().release_unused()

    return run


def _without(text: str, gone: list[int], hasher: WordHasher) -> tuple[str, int]:
    """What is left of a text, and how many lines lost something."""
    ends = np.cumsum([0, *map(len, lines(text))])
    last = len(ends) - 1
    spans = [(ends[at], ends[min(at + WINDOW, last)]) for at in gone if at >= 0]
    if any(at < 0 for at in gone):
        words = [m.start() for m in _WORD.finditer(text)]
        first, after = pieces(_finish(_word_hashes(text.split(), hasher)))
        until = dict(zip(first.tolist(), after.tolist(), strict=True))
        spans += [(words[-1 - at], words[until[-1 - at]]) for at in gone if at < 0]
    kept, at, touched = [], 0, set()
    for begin, end in sorted(spans):
        kept.append(text[at:begin] if begin > at else "")
        if end > at:
            touched.update(range(int(np.searchsorted(ends, max(begin, at), "right")) - 1, int(np.searchsorted(ends, end))))
            at = end
    return "".join(kept) + text[at:], len(touched)


def _rewrite(names: list[str], text_col: str, counts: tuple[str, str]):
    """Columns ``text, row, gone`` to the columns of ``row`` and what is left of the text in its place, and the two counts."""

    def make():
        hasher = WordHasher()

        def one(part: pa.RecordBatch) -> pa.RecordBatch:
            texts, held, removed = [], [], []
            for x, gone in zip(part.column("text"), part.column("gone"), strict=True):
                text, n = x.as_py(), 0
                held.append(len(lines(text)) if text else 0)
                if gone.is_valid:
                    text, n = _without(text, gone.as_py(), hasher)
                texts.append(text)
                removed.append(n)
            others = iter(part.column("row").flatten()[1:])
            columns = [pa.array(texts, pa.string()) if n == text_col else next(others) for n in names]
            return pa.RecordBatch.from_arrays([*columns, pa.array(held, pa.int64()), pa.array(removed, pa.int64())], [*names, *counts])

        return one

    return by_parts(make, "text", PART_ROWS, PART_BYTES)


def remove_repeats(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, within_lines: bool = False, counts: tuple[str, str] = ("n_lines", "n_removed")) -> DataFrame:
    """``df`` with repeated passages removed from ``text_col``, and ``counts``: how many lines a text has and loses.

    Null and empty texts have no window and stay as they are; blank lines count
    as lines, but windows of blank lines only are no passage.  A text may be of
    any length, and may lose all its lines and become empty.  Of the occurrences
    of a window, the one of the smallest id stays, and in it the first.  Rows of
    one id and one text are one document and lose the same; rows of one id and
    different texts are documents of their own, in the order of a hash of the
    text.  Rows of a null id stay as they are.  An empty table gives no rows.
    Columns named in ``counts`` are replaced if present; other columns stay,
    whatever their names.  Windows are compared by 64-bit hash.

    ``within_lines`` also removes later copies of passages of 49 words or more
    that hold fewer than three whole lines, but for some words at their ends;
    lines that lose only words count as removed.
    """
    fields = [StructField(f.name, StringType() if f.name == text_col else f.dataType) for f in df.schema if f.name not in counts]
    names = [f.name for f in fields]
    base = df.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"), F.struct(F.lit(0).alias("_"), *(F.col(f"`{n}`") for n in names if n != text_col)).alias("row"))
    unique = base.where("id is not null").groupBy("id").count().where("count > 1").isEmpty()
    base = base.withColumn("key", F.col("id") if unique else F.when(F.col("id").isNotNull(), F.struct("id", F.xxhash64("text").alias("text")))).drop("id")
    kind = base.schema["key"].dataType
    steps = Steps()
    cut = StructType([StructField("h", LongType()), StructField("key", kind)])
    texts = base.where(F.col("key").isNotNull() & (F.col("text") != "")).select("key", "text")
    windows = steps.stage(texts.mapInArrow(_windows(within_lines), cut.add("at", LongType())), "line-windows", "zstd")
    seen = windows.groupBy("h").agg(F.min("key").alias("first"), F.count("*").alias("times"))
    repeated = steps.stage(seen.where("times > 1").select("h", "first"), "line-repeated")
    later = windows.join(repeated, "h").where("key <> first or at % 2 <> 0")
    gone = stage(later.groupBy("key").agg(F.collect_set(F.shiftright("at", 1)).alias("gone")), "line-gone")
    steps.clear()
    columns = ["text", "row", "gone"]
    if gone.count() <= BROADCAST_IDS:  # other texts are not shuffled
        ids = F.broadcast(gone.select("key"))
        whole = base.join(ids, "key", "left_anti").withColumn("gone", F.lit(None).cast("array<long>"))
        joined = whole.select(columns).union(base.join(ids, "key", "left_semi").join(gone, "key").select(columns))
    else:
        joined = base.join(gone, "key", "left").select(columns)
    out = StructType([*fields, *(StructField(c, LongType()) for c in counts)])
    return joined.mapInArrow(_rewrite(names, text_col, counts), out)


#: DuckDB counterpart over ``documents``, for ids that are unique, of windows of whole lines.
SQL = """
WITH cut AS (
  SELECT doc_id, CASE WHEN coalesce(text, '') = '' THEN [] ELSE string_split(rtrim(regexp_replace(text, '([.!?][ \\t]+|\\n)', '\\1' || chr(30), 'g'), chr(30)), chr(30)) END AS parts, text
  FROM documents),
padded AS (
  SELECT doc_id, list_transform(parts, lambda x: regexp_replace(x, '^[ \\t\\n\\r]+|[ \\t\\n\\r]+$', '', 'g')) || list_transform(generate_series(1, greatest(0, 3 - len(parts))), lambda x: '') AS l
  FROM cut WHERE len(parts) > 0),
places AS (
  SELECT doc_id, l, unnest(generate_series(1, len(l) - 2)) AS pos FROM padded),
windows AS (
  SELECT doc_id, pos, l[pos] || chr(31) || l[pos + 1] || chr(31) || l[pos + 2] AS body FROM places
  WHERE l[pos] || l[pos + 1] || l[pos + 2] <> ''),
ranked AS (
  SELECT doc_id, pos, row_number() OVER (PARTITION BY body ORDER BY doc_id, pos) AS k FROM windows),
gone AS (
  SELECT doc_id, list_distinct(flatten(list([pos, pos + 1, pos + 2]))) AS dropped FROM ranked WHERE k > 1 GROUP BY doc_id),
kept AS (
  SELECT c.doc_id, c.text, c.parts, g.dropped, list_filter(c.parts, lambda x, i: NOT list_contains(g.dropped, i)) AS rest
  FROM cut c LEFT JOIN gone g USING (doc_id))
SELECT doc_id, CASE WHEN dropped IS NULL THEN text ELSE coalesce(list_aggregate(rest, 'string_agg', ''), '') END AS text,
       CAST(len(parts) AS BIGINT) AS n_lines,
       CAST(CASE WHEN dropped IS NULL THEN 0 ELSE len(parts) - len(rest) END AS BIGINT) AS n_removed
FROM kept
"""
