"""Near-duplicate documents by min-max hashing.

Each permutation of the shingle hashes gives two signature values, the smallest
and the largest image, so a signature of 240 values costs 120 hash evaluations.
Bands of six values make bucket keys; at a Jaccard similarity of 0.8 a pair
misses all 40 buckets with probability 5e-6.

Nothing emits all pairs of a bucket:

1. Equal shingle sets collapse to their smallest id.
2. Every set is compared with one leader, the most popular member of its
   buckets.  This joins the bulk of a group in one comparison per member.
3. Only buckets that still hold several components are looked at again, and
   there only sets outside the bucket's leading component.  Each set has parity
   bits, one flip for each shingle; where two sets' bits differ, so do the sets.
   A link allows (x + y) * 20 / 180 differing shingles for sizes x and y, so
   more differing bits than that rule a pair out, exactly and within the join.
4. Buckets that would still need more than ``HEAVY_PAIRS`` comparisons, such as
   texts of one template that resemble each other a little less than a link
   asks, are joined on rare shingles instead: two linked sets of size n share one
   of the n - ceil(0.8 n) + 1 rarest shingles of either, whatever the order of
   equal counts.  This is exact, too.
5. All remaining pairs are compared on full sets.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window, functions as F

from .batches import by_parts, parts
from .components import connected_components
from .staging import Steps, stage
from .shingles import WordHasher, band_keys, linked, min_max, parity_bits, permutations, shingle_set

PERMUTATIONS = 120
BAND_ROWS = 6
#: Parity bits of a set that are compared before full sets are; the comparison of more would be too long a method for the JIT compiler.
BITS = 1_024
#: Comparisons of a bucket above which its members meet by rare shingles instead.
HEAVY_PAIRS = 1 << 20
#: Texts and bytes of them whose features are held at once, and pairs of sets.
PART_ROWS, PART_BYTES, PART_PAIRS = 500, 4 << 20, 4 << 20
#: A table of at most so many ids is broadcast; it is counted first.
BROADCAST_IDS = 1_000_000


def _within(df: DataFrame, ids: DataFrame) -> DataFrame:
    """Rows of ``df`` whose ``id`` is in the staged table ``ids``."""
    if ids.count() <= BROADCAST_IDS:
        ids = F.broadcast(ids)
    return df.join(ids, "id", "left_semi")


def _features(words: int, count: int, rows: int):
    def make() -> Callable[[pa.RecordBatch], pa.RecordBatch]:
        hasher = WordHasher()
        a, b = permutations(count)
        bands = 2 * count // rows

        def one(part: pa.RecordBatch) -> pa.RecordBatch:
            sizes, digests, keys = [], [], []
            for text in part.column(1):
                h = shingle_set(text.as_py(), words, hasher)
                sizes.append(len(h))
                digests.append(xxhash.xxh3_128_digest(h))
                if len(h):
                    keys.append(band_keys(min_max(h, a, b), rows))
            sizes = np.array(sizes, np.int64)
            digest = np.frombuffer(b"".join(digests), np.int64).reshape(-1, 2)
            flat = np.concatenate(keys) if keys else np.empty(0, np.int64)
            offsets = np.concatenate(([0], np.cumsum((sizes > 0) * bands))).astype(np.int32)
            return pa.RecordBatch.from_arrays([part.column(0), pa.array(sizes), pa.array(digest[:, 0]), pa.array(digest[:, 1]), pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))], ["id", "n", "d1", "d2", "keys"])

        return one

    return by_parts(make, 1, PART_ROWS, PART_BYTES)


def _sets(words: int):
    def make() -> Callable[[pa.RecordBatch], pa.RecordBatch]:
        hasher = WordHasher()

        def one(part: pa.RecordBatch) -> pa.RecordBatch:
            found = [shingle_set(x.as_py(), words, hasher) for x in part.column(1)]
            digest = np.frombuffer(b"".join(xxhash.xxh3_128_digest(h) for h in found), np.int64).reshape(-1, 2)[:, 0]
            columns = [part.column(0), pa.array(digest), pa.array([len(h) for h in found], pa.int64()), pa.array([h.tobytes() for h in found], pa.binary()), pa.array([parity_bits(h, BITS).tolist() for h in found], pa.list_(pa.int64()))]
            return pa.RecordBatch.from_arrays(columns, ["id", "d1", "n", "words", "bits"])

        return one

    return by_parts(make, 1, PART_ROWS, PART_BYTES)


def _compare(percent: int):
    def make() -> Callable[[pa.RecordBatch], pa.RecordBatch]:
        def one(part: pa.RecordBatch) -> pa.RecordBatch:
            x, y = part.column("x"), part.column("y")
            keep = [linked(np.frombuffer(p.as_buffer(), np.uint64), np.frombuffer(q.as_buffer(), np.uint64), percent) for p, q in zip(x, y, strict=True)]
            return part.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

        return one

    return by_parts(make, "x", PART_PAIRS)


def _each_shingle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per shingle of a set."""
    for batch in batches:
        for part in parts(batch, "words", PART_ROWS, PART_BYTES):
            found = [np.frombuffer(x.as_buffer(), np.int64) for x in part.column("words")]
            row = pa.array(np.repeat(np.arange(len(found)), [len(h) for h in found]))
            yield pa.RecordBatch.from_arrays([*(part.column(c).take(row) for c in ("id", "d1", "n")), pa.array(np.concatenate(found))], ["id", "d1", "n", "shingle"])


def _verified(pairs: DataFrame, sets: DataFrame, percent: int, steps: Steps) -> DataFrame:
    """Those of ``pairs`` of texts whose full sets link, as ``(a, b)``; each pair carries its two sets once, sets of no pair are not shuffled."""
    ids = steps.stage(pairs.select(F.col("a").alias("id")).union(pairs.select("b")).distinct(), "mh-compared")
    if ids.count() <= BROADCAST_IDS:
        sets = sets.join(F.broadcast(ids), "id", "left_semi")
    x = sets.select(F.col("id").alias("a"), F.col("d1").alias("da"), F.col("words").alias("x"))
    y = sets.select(F.col("id").alias("b"), F.col("d1").alias("db"), F.col("words").alias("y"))
    return pairs.select("a", "da", "b", "db").join(x, ["a", "da"]).join(y, ["b", "db"]).select("a", "b", "x", "y").mapInArrow(_compare(percent), "a long, b long")


def _ordered(pairs: DataFrame) -> DataFrame:
    """Pairs of texts once each, the larger id first."""
    a, b = F.struct(F.col("a").alias("id"), F.col("da").alias("d1")), F.struct(F.col("b").alias("id"), F.col("db").alias("d1"))
    return pairs.select(F.greatest(a, b).alias("p"), F.least(a, b).alias("q")).select(F.col("p.id").alias("a"), F.col("p.d1").alias("da"), F.col("q.id").alias("b"), F.col("q.d1").alias("db")).distinct()


def _least_difference(x: str, y: str) -> Column:
    """A lower bound of |A ^ B|: positions at which the parity bits of the two sets differ."""
    return reduce(Column.__add__, [F.bit_count(F.get(x, F.lit(i)).bitwiseXOR(F.get(y, F.lit(i)))) for i in range(BITS // 64)])


def _fits(n: str, m: str, percent: int) -> Column:
    """Sizes n, m allow a similarity of percent."""
    return F.least(n, m) * 100 >= F.greatest(n, m) * percent


def _rare_pairs(members: DataFrame, sets: DataFrame, percent: int, steps: Steps) -> DataFrame:
    """Pairs of texts of ``members(id, d1, part, outside)`` that share a rare shingle; the first is outside its buckets' leading component."""
    ids = steps.stage(members.select("id", "d1"), "mh-heavy-ids")
    some = F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids
    shingles = steps.stage(sets.join(some, ["id", "d1"], "left_semi").select("id", "d1", "n", "words").mapInArrow(_each_shingle, "id long, d1 long, n long, shingle long"), "mh-shingles")
    times = steps.stage(shingles.groupBy("shingle").agg(F.count("*").alias("times")), "mh-times")
    place = F.row_number().over(Window.partitionBy("id", "d1").orderBy("times", "shingle"))
    rare = shingles.join(times.withColumnRenamed("shingle", "s"), F.col("shingle") == F.col("s")).withColumn("place", place).where(F.col("place") <= F.col("n") - F.ceil(F.col("n") * percent / 100) + 1)
    rare = steps.stage(rare.where("times > 1").select("id", "d1", "n", "shingle").join(members, ["id", "d1"]), "mh-rare")
    x = rare.where("outside").select("shingle", F.col("id").alias("a"), F.col("d1").alias("da"), F.col("n").alias("an"), F.col("part").alias("ap"))
    y = rare.select(F.col("shingle").alias("s"), F.col("id").alias("b"), F.col("d1").alias("db"), F.col("n").alias("bn"), F.col("part").alias("bp"))
    return _ordered(x.join(y, x.shingle == y.s).where((F.col("ap") != F.col("bp")) & _fits("an", "bn", percent)))


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, words: int = 5, percent: int = 80, permutations: int = PERMUTATIONS, band_rows: int = BAND_ROWS) -> DataFrame:
    """One row per document: id, ``n_shingles``, ``component_id``, ``kept``.

    Documents link where 100 * |A & B| >= percent * |A | B| on their sets of
    distinct ``words``-word shingles.  ``component_id`` is the smallest id
    reachable over links.  Null and word-less texts have an empty set and link
    with nothing; a shorter text is one shingle; texts may be of any length.
    Rows of a null id are returned unlinked and kept.  Rows of one id are one
    document, of several texts if these differ: it links where any of them does,
    and each row shows the document's component.  Ties: of equal sets, the
    smallest id stands for all.  An empty table gives no rows.  Other columns
    are ignored, whatever their names.
    """
    docs = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    steps = Steps()
    features = stage(docs.mapInArrow(_features(words, permutations, band_rows), "id long, n long, d1 long, d2 long, keys array<long>"), "mh-features")
    solid = features.where("n > 0 and id is not null")

    classes = steps.stage(solid.groupBy("d1", "d2").agg(F.min("id").alias("rep"), F.max("id").alias("top")), "mh-classes")
    twins = classes.where("rep <> top").select("d1", "d2", "rep")
    again = steps.stage(solid.groupBy("id", "d1").count().where("count > 1").select("id").distinct(), "mh-again")
    repeats = not again.isEmpty()  # rows of one id and set
    members = solid.select("id", "d1", "d2")
    members = (members.distinct() if repeats else members).join(F.broadcast(twins) if twins.count() <= BROADCAST_IDS else twins, ["d1", "d2"]).where("id <> rep")
    members = steps.stage(members, "mh-copies")
    copies = members.select(F.col("id").alias("a"), F.col("rep").alias("b"))

    # Buckets of representatives only.
    alone = solid.join(members.select("id", "d1", "d2"), ["id", "d1", "d2"], "left_anti")
    rows = alone.select("id", "d1", "n", F.explode("keys").alias("key"))
    full = rows.groupBy("key").agg(F.count("*").alias("size")).where("size > 1")
    full = steps.stage(full, "mh-full")
    members = steps.stage(rows.join(full, "key"), "mh-members")
    steps.drop(full)
    ids = steps.stage(members.select("id").distinct(), "mh-ids")
    made = lambda ids: _within(docs, ids).mapInArrow(_sets(words), "id long, d1 long, n long, words binary, bits array<long>")
    if repeats:  # only sets of such ids are shuffled
        once, twice = (steps.stage(ids.join(again, "id", how), "mh-ids") for how in ("left_anti", "left_semi"))
        sets = made(once).union(made(twice).dropDuplicates(["id", "d1"]))
    else:
        sets = made(ids)
    sets = steps.stage(sets, "mh-sets")

    # One comparison per member, with the most popular leader of its buckets.
    popular = steps.stage(members.groupBy("id", "d1").agg(F.sum("size").alias("fame")), "mh-fame")
    known = steps.stage(members.select("key", "id", "d1").join(popular, ["id", "d1"]), "mh-known")
    steps.drop(popular)
    top = F.max(F.struct("fame", (-F.col("id")).alias("neg"), "d1")).alias("top")
    leaders = steps.stage(known.groupBy("key").agg(top).select("key", F.col("top.fame").alias("fame"), (-F.col("top.neg")).alias("leader"), F.col("top.d1").alias("dl")), "mh-leaders")
    led = known.select("key", "id", "d1").join(leaders, "key").where("id <> leader")
    best = led.groupBy("id", "d1").agg(F.max(F.struct("fame", (-F.col("leader")).alias("neg"), "dl")).alias("top")).select(F.col("id").alias("a"), F.col("d1").alias("da"), (-F.col("top.neg")).alias("b"), F.col("top.dl").alias("db"))
    best = steps.stage(best, "mh-best")
    steps.drop(known)
    first = steps.stage(_verified(best, sets, percent, steps), "mh-first")
    joined = connected_components(first)

    # Buckets that still hold several components.
    part = F.coalesce("component_id", "id")
    placed = steps.stage(members.join(joined, "id", "left").select("key", "id", "d1", "n", part.alias("part")), "mh-placed")
    steps.drop(members)
    mixed = placed.groupBy("key").agg(F.min("part").alias("low"), F.max("part").alias("high")).where("low <> high").select("key")
    mixed = steps.stage(mixed.join(leaders.select("key", "leader"), "key").join(joined.withColumnRenamed("id", "leader"), "leader", "left").select("key", F.coalesce("component_id", "leader").alias("main")), "mh-mixed")
    open_ = steps.stage(placed.join(mixed, "key"), "mh-open")
    steps.drop(placed)
    outside = F.col("part") != F.col("main")
    heavy = open_.groupBy("key").agg(F.sum(outside.cast("long")).alias("outside"), F.count("*").alias("all")).where(F.col("outside") * F.col("all") > HEAVY_PAIRS)
    heavy = steps.stage(heavy.select(F.col("key").alias("heavy")), "mh-heavy")
    by_shingle = None
    if not heavy.isEmpty():
        crowd = open_.join(heavy, F.col("key") == F.col("heavy")).groupBy("id", "d1").agg(F.max(outside).alias("outside"), F.max("part").alias("part"))
        by_shingle = _rare_pairs(steps.stage(crowd, "mh-crowd"), sets, percent, steps)
        open_ = open_.join(heavy, F.col("key") == F.col("heavy"), "left_anti")
    open_ = steps.stage(open_.join(sets.select("id", "d1", "bits"), ["id", "d1"]), "mh-bits")
    side = lambda x: [F.col(c).alias(n) for c, n in (("id", x), ("d1", f"d{x}"), ("n", f"{x}n"), ("part", f"{x}p"), ("bits", f"{x}bits"))]
    x = open_.where(outside).select("key", *side("a"))
    y = open_.select("key", *side("b"), "main")
    new = (F.col("ap") != F.col("bp")) & ((F.col("bp") == F.col("main")) | (F.col("a") > F.col("b")))
    rest = _ordered(x.join(y, "key").where(new & _fits("an", "bn", percent) & (_least_difference("abits", "bbits") * (100 + percent) <= (F.col("an") + F.col("bn")) * (100 - percent))))
    if by_shingle is not None:
        rest = rest.union(by_shingle).distinct()
    second = steps.stage(_verified(steps.stage(rest, "mh-rest"), sets, percent, steps), "mh-second")

    labels = connected_components(copies.union(first).union(second))
    steps.clear()
    out = features.select("id", "n").join(labels, "id", "left").select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.coalesce("component_id", "id").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col(id_col) == F.col("component_id"), F.lit(True)))


#: DuckDB counterpart over ``documents`` for four words and 80 percent: all pairs with a common shingle, and all paths.
SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS l
  FROM documents),
s AS (
  SELECT doc_id, unnest(list_distinct(CASE WHEN len(l) >= 4 THEN list_transform(generate_series(1, len(l) - 3), lambda i: array_to_string(l[i:i + 3], ' '))
                                           WHEN len(l) > 0 THEN [array_to_string(l, ' ')] ELSE [] END)) AS g
  FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
p AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS k FROM s x JOIN s y ON x.g = y.g AND x.doc_id < y.doc_id GROUP BY 1, 2),
e AS (SELECT a, b FROM p JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * k >= 80 * (na.n + nb.n - k)),
both_ways AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
reach AS (SELECT a, b FROM both_ways UNION SELECT r.a, t.b FROM reach r JOIN both_ways t ON r.b = t.a),
low AS (SELECT a AS doc_id, min(b) AS b FROM reach GROUP BY 1)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, least(d.doc_id, coalesce(low.b, d.doc_id)) AS component_id,
       d.doc_id = least(d.doc_id, coalesce(low.b, d.doc_id)) AS kept
FROM documents d LEFT JOIN n USING (doc_id) LEFT JOIN low USING (doc_id)
"""
