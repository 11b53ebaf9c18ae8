"""Language by rank-order profiles of character n-grams.

A profile lists a language's most frequent n-grams in order.  A document's own
list is compared with each profile by the out-of-place distance: the sum of
rank differences, with the greatest one for n-grams the profile lacks.
Profiles are counted over all training rows: each task sums its own counts, and
only sums per (language, n-gram) are shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from .batches import by_parts

#: N-grams of 1 to this many characters; a space stands for any run of non-letters.
LONGEST = 4
#: N-grams of a profile, and of a document that are compared.
PROFILE = 300
UNKNOWN = "und"
#: Languages that a model holds at most; more are an error, since their profiles would not fit one task.
MOST_LANGUAGES = 500
#: Distinct (language, n-gram) pairs that a task holds before it passes their sums on.
HELD = 2_000_000
#: Tasks that rank the n-grams of one language before one of them joins the results.
BUCKETS = 64


def held_out(id_col: str) -> Column:
    """Rows that no model learns from: crc32 of the id as text, mod 3, is 1; null ids too."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 3 == 1, F.lit(True))


@lru_cache(1)
def _letters() -> np.ndarray:
    return np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)


def ngrams(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct n-grams of a whole text as 32-bit hashes, ascending, and their counts."""
    cp = np.frombuffer((text or "").lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    cp = np.where(_letters()[cp], cp, np.uint32(32))
    cp = np.concatenate((np.array([32], np.uint32), cp, np.array([32], np.uint32)))
    space = cp == 32
    keep = np.ones(len(cp), bool)
    keep[1:] = ~(space[1:] & space[:-1])
    cp, space = cp[keep], space[keep]
    if len(cp) < 3:
        return np.empty(0, np.uint32), np.empty(0, np.int64)
    parts, h, inner = [], cp * np.uint32(0x9E3779B1), None
    parts.append(h[~space])
    for n in range(2, LONGEST + 1):
        if len(cp) < n:
            break
        h = (h[:-1] ^ (h[:-1] >> np.uint32(15))) * np.uint32(0x85EBCA6B) + cp[n - 1 :] * np.uint32(0xC2B2AE35) + np.uint32(n)
        if n > 2:  # no space inside, so none crosses words
            here = space[n - 2 : n - 2 + len(h)]
            inner = here if inner is None else inner[:-1] | here
            parts.append(h[~inner])
        else:
            parts.append(h)
    keys = np.concatenate(parts)
    keys.sort()
    cut = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
    return keys[cut], np.diff(np.append(cut, len(keys)))


def most_frequent(keys: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The ``PROFILE`` most frequent, in order; equal counts by key."""
    order = np.sort(((np.int64(1 << 31) - 1 - np.minimum(counts, (1 << 31) - 1)) << 32) | keys.astype(np.int64))[:PROFILE]
    return (order & 0xFFFFFFFF).astype(np.uint32)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: dict[str, tuple[np.ndarray, np.ndarray]] = {}
    recent: dict[str, list] = {}
    waiting = 0  # n-grams in ``recent``

    def merge() -> None:
        for lang, found in recent.items():
            keys, counts = (np.concatenate(x) for x in zip(*found, *([held[lang]] if lang in held else []), strict=True))
            keys, back = np.unique(keys, return_inverse=True)
            held[lang] = keys, np.bincount(back, counts).astype(np.int64)
        recent.clear()

    def sums() -> Iterator[pa.RecordBatch]:
        for lang, (keys, counts) in held.items():
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(keys), pa.string()), pa.array(keys.astype(np.int64)), pa.array(counts)], ["lang", "gram", "n"])
        held.clear()

    for batch in batches:
        for text, lang in zip(batch.column(0), batch.column(1), strict=True):
            found = ngrams(text.as_py())
            recent.setdefault(lang.as_py(), []).append(found)
            waiting += len(found[0])
            if waiting >= HELD // 4:
                merge()
                waiting = 0
                if sum(len(k) for k, _ in held.values()) >= HELD:
                    yield from sums()
    merge()
    yield from sums()
    pa.default_memory_pool().release_unused()


def learn_profiles(labelled: DataFrame, text_col: str = "text", lang_col: str = "lang") -> dict[str, np.ndarray]:
    """Profiles of every language named in ``labelled``, from all its rows; null languages are ignored.

    Ties: n-grams of equal count are ranked by their hash.  What reaches the
    driver is ``PROFILE`` numbers for each of at most ``MOST_LANGUAGES``.
    """
    rows = labelled.select(F.col(text_col).cast("string"), F.col(lang_col).cast("string").alias("lang")).where("lang is not null")
    sums = rows.mapInArrow(_count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    best = sums.withColumn("bucket", F.pmod("gram", F.lit(BUCKETS)))
    for group in (["lang", "bucket"], ["lang"]):  # a common language's n-grams are ranked in many tasks first
        best = best.withColumn("rank", F.row_number().over(Window.partitionBy(*group).orderBy(F.desc("n"), "gram"))).where(F.col("rank") <= PROFILE)
    out: dict[str, np.ndarray] = {}
    found = best.select("lang", "rank", "gram").limit(MOST_LANGUAGES * PROFILE + 1).toPandas()
    if len(found) > MOST_LANGUAGES * PROFILE or found["lang"].nunique() > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages")
    for lang, part in found.sort_values(["lang", "rank"]).groupby("lang"):
        out[lang] = part["gram"].to_numpy().astype(np.uint32)
    return out


class Classifier:
    def __init__(self, profiles: dict[str, np.ndarray]):
        self.names = sorted(profiles)
        self.grams = np.unique(np.concatenate([profiles[n] for n in self.names])) if profiles else np.empty(0, np.uint32)
        self.ranks = np.full((len(self.grams) + 1, len(self.names)), -1, np.int16)
        for k, n in enumerate(self.names):
            self.ranks[np.searchsorted(self.grams, profiles[n]), k] = np.arange(len(profiles[n]))

    def distances(self, text: str | None) -> np.ndarray | None:
        """Mean out-of-place distance to each profile, 0 to 1; None without letters or profiles."""
        keys, counts = ngrams(text)
        if not len(keys) or not self.names:
            return None
        mine = most_frequent(keys, counts)
        at = np.searchsorted(self.grams, mine)
        known = at < len(self.grams)
        known[known] = self.grams[at[known]] == mine[known]
        ranks = self.ranks[np.where(known, at, len(self.grams))].astype(np.int64)
        apart = np.where(ranks < 0, PROFILE, np.abs(ranks - np.arange(len(mine))[:, None]))
        return apart.mean(0) / PROFILE

    def predict(self, text: str | None) -> tuple[str, float, float]:
        """Language, score, distance.  The score is how much nearer the best profile is than the next."""
        d = self.distances(text)
        if d is None:
            return UNKNOWN, 0.0, 1.0
        best = int(d.argmin())
        rest = np.delete(d, best)
        score = 1 - d[best] / rest.min() if len(rest) and rest.min() > 0 else 1 - d[best]
        return self.names[best], float(score), float(d[best])


def identify(df: DataFrame, profiles: dict[str, np.ndarray], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, ``held_out``, ``lang_pred``, ``score``, ``distance``.

    A null or empty text, one without letters, and any text if nothing was
    learned, is ``und`` with score 0 and distance 1.  Texts may be of any length.
    Ties: equal distances go to the first name.  Null and repeated ids are kept,
    each row by its own text; an empty table gives no rows; other columns are
    ignored.
    """

    def make():
        model = Classifier(profiles)

        def one(part: pa.RecordBatch) -> pa.RecordBatch:
            found = [model.predict(x.as_py()) for x in part.column("text")]
            columns = [pa.array([f[k] for f in found], kind) for k, kind in enumerate((pa.string(), pa.float64(), pa.float64()))]
            return pa.RecordBatch.from_arrays([part.column(0), part.column(1), *columns], [id_col, "held_out", "lang_pred", "score", "distance"])

        return one

    source = df.select(F.col(id_col), held_out(id_col).alias("held_out"), F.col(text_col).cast("string").alias("text"))
    return source.mapInArrow(by_parts(make, "text"), f"`{id_col}` {source.dtypes[0][1]}, held_out boolean, lang_pred string, score double, distance double")


def learn_and_identify(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """:func:`identify` with profiles learned from the rows of ``df`` that are not held out."""
    return identify(df, learn_profiles(df.where(~held_out(id_col)), text_col, lang_col), id_col, text_col)
