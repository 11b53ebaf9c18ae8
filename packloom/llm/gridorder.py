"""Similarity join of embeddings in epsilon grid order.

Unit vectors with a cosine of at least c lie within eps = sqrt(2 - 2c) of each
other.  They are rotated to principal axes (a rotation changes no distance), laid
on a grid of cells of side eps over the leading axes, sorted by cell, and cut
into intervals.  Two intervals are joined only if the boxes and balls of some of
their blocks, over all axes, come within eps; inside a task the join halves both intervals again and
again, skips blocks that are provably too far apart, and multiplies matrices in
double precision at the bottom.  A task takes one interval and several partners,
so an interval is sent once for a row of tiles, as the bytes that came in.  It
returns sums and one edge per linked vector, never pairs.

Where the vectors spread evenly over many more axes than a grid of any size can
tell apart, no block is provably far and all pairs of intervals remain: the
work is then quadratic, and the bytes sent are the data times the number of
intervals.  ``tile_counts`` reports how many pairs of intervals were kept.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from .components import connected_components
from .staging import Steps, stage

#: Leading axes of the grid.
GRID_AXES = 8
#: Bytes of an interval's vectors at most, and vectors of one at least, unless there are fewer.
INTERVAL_BYTES = 4 << 20
LEAST_VECTORS = 1_024
#: Blocks of an interval whose bounds decide which intervals meet, and cuts between them where the order leaps, at most.
BLOCKS = 8
LEAPS = 63
#: Partners of an interval in one task at most.
ROW = 8
#: Vectors that the axes are fitted on at most; they change the speed only.
AXES_SAMPLE = 4_096
#: Rows of a block whose similarities are computed at once.
LEAF = 256
#: A table of at most so many classes of equal vectors is broadcast; it is counted first.
BROADCAST_CLASSES = 1_000_000
SLACK = 1e-9

_KEY = ("id", "d1", "d2")  # of a class of equal vectors: its smallest id and its digest


def _units(dim: int, kind: str):
    """Digest and bytes of each usable vector, filled up with zeros to ``dim`` components."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin in range(0, batch.num_rows, 2_000):
                part = batch.slice(begin, 2_000)
                sizes = pc.fill_null(pc.list_value_length(part.column(1)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
                m = np.zeros((len(sizes), dim), kind)
                flat = part.column(1).flatten()
                place = np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
                m[np.repeat(np.arange(len(sizes)), sizes), place] = flat.to_numpy(zero_copy_only=False)  # nulls become NaN
                m += 0  # no negative zeros
                usable = np.isfinite(m).all(1) & m.any(1)
                rows = [x.tobytes() if ok else None for x, ok in zip(m, usable, strict=True)]
                digests = [(None, None) if x is None else np.frombuffer(xxhash.xxh3_128_digest(x), np.int64).tolist() for x in rows]
                yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array([d[k] for d in digests], pa.int64()) for k in (0, 1)), pa.array(rows, pa.binary())], ["id", "d1", "d2", "u"])

    return run


def _unit_matrix(data: bytes, dim: int, kind: str) -> np.ndarray:
    m = np.frombuffer(data, kind).reshape(-1, dim).astype(float)
    m /= np.abs(m).max(1, keepdims=True)  # keeps squares in range
    m /= np.sqrt((m * m).sum(1, keepdims=True))
    return m


def _on_grid(axes: np.ndarray, eps: float, kind: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            p = _unit_matrix(b"".join(batch.column("u").to_pylist()), len(axes), kind) @ axes[:, :GRID_AXES]
            cells = np.floor(p / eps).astype(np.int32)
            yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(cells[:, k]) for k in range(cells.shape[1])), pa.array(p[:, 0])], [*batch.schema.names, *(f"c{k}" for k in range(cells.shape[1])), "p"])

    return run


def _bound(p: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    """Box, middle and radius."""
    middle = p.mean(0)
    return p.min(0), p.max(0), middle, math.sqrt(((p - middle) ** 2).sum(1).max())


def _blocks(p: np.ndarray, eps: float) -> list[np.ndarray]:
    """Blocks of an interval: equal parts, cut again where neighbours are further apart than ``eps``."""
    leap = np.sqrt(((p[1:] - p[:-1]) ** 2).sum(1))
    cuts = np.flatnonzero(leap > eps) + 1
    if len(cuts) > LEAPS:
        cuts = np.argsort(-leap, kind="stable")[:LEAPS] + 1
    even = np.arange(1, BLOCKS) * len(p) // BLOCKS
    return [x for x in np.split(p, np.unique(np.concatenate((cuts, even)))) if len(x)]


def _intervals(axes: np.ndarray, size: int, kind: str, eps: float):
    """One row per interval: number, the classes and their vectors, bounds of its blocks.  The last may be half as long again."""
    kinds = (pa.int64(), pa.binary(), pa.binary(), pa.list_(pa.struct([*((c, pa.list_(pa.float64())) for c in ("low", "high", "middle")), ("radius", pa.float64())])))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, made, held, count = TaskContext.get().partitionId(), 0, [], 0

        def row(table: pa.Table) -> pa.RecordBatch:
            raw = b"".join(table.column("u").to_pylist())
            p = _unit_matrix(raw, len(axes), kind) @ axes
            longs = [table.column(c).to_numpy().astype("<i8").tobytes() for c in (*_KEY, "w")]
            values = [(part << 24) + made, b"".join(longs), raw, [dict(zip(("low", "high", "middle", "radius"), _bound(x), strict=True)) for x in _blocks(p, eps)]]
            return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(values, kinds, strict=True)], ["i", "classes", "m", "blocks"])

        for batch in batches:
            held.append(batch.select([*_KEY, "w", "u"]))
            count += batch.num_rows
            while 2 * count >= 3 * size + 2:
                table = pa.Table.from_batches(held)
                yield row(table.slice(0, size))
                made += 1
                held, count = table.slice(size).to_batches(), count - size
        if count:
            yield row(pa.Table.from_batches(held))

    return run


class Interval:
    """Vectors of one interval, with the bounds of any of its blocks."""

    def __init__(self, classes: bytes, matrix: bytes, axes: np.ndarray, kind: str):
        self.keys = np.frombuffer(classes, "<i8").reshape(4, -1)  # smallest id, both halves of the digest, number of rows
        self.weights = self.keys[3]
        self.u = _unit_matrix(matrix, len(axes), kind)
        self.p = self.u @ axes
        self.links = np.zeros(len(self.u), np.int64)
        self.rank = np.arange(len(self.u))
        self.bounds: dict[tuple[int, int], tuple] = {}

    def bound(self, begin: int, end: int) -> tuple:
        """Bound of the vectors begin..end-1."""
        found = self.bounds.get((begin, end))
        if found is None:
            found = self.bounds[begin, end] = _bound(self.p[begin:end])
        return found


def _far(x: tuple, y: tuple, eps: float) -> bool:
    gap = np.maximum(0, np.maximum(x[0] - y[1], y[0] - x[1]))
    if float(gap @ gap) > eps * eps + SLACK:
        return True
    apart = x[2] - y[2]
    return math.sqrt(float(apart @ apart)) > x[3] + y[3] + eps + SLACK


def _components(mask: np.ndarray, x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Smallest rank that each linked row and column of a block reaches within it."""
    none = np.iinfo(np.int64).max
    while True:
        x2 = np.minimum(x, np.where(mask, y, none).min(1))
        y2 = np.minimum(y, np.where(mask, x2[:, None], none).min(0))
        if np.array_equal(x, x2) and np.array_equal(y, y2):
            return x, y
        x, y = x2, y2


def join_intervals(a: Interval, b: Interval, cosine: float, eps: float, seen: list[int] | None = None) -> list[tuple[int, int]]:
    """Adds to both ``links`` the weight of each vector's partners; edges between ranks that connect what is linked.

    ``seen`` receives the number of vector pairs of every block that was not skipped.
    """
    same, edges = a is b, []

    def walk(i0: int, i1: int, j0: int, j1: int) -> None:
        if same and j1 <= i0 or _far(a.bound(i0, i1), b.bound(j0, j1), eps):
            return
        if max(i1 - i0, j1 - j0) > LEAF:
            if i1 - i0 >= j1 - j0:
                mid = (i0 + i1) // 2
                walk(i0, mid, j0, j1)
                walk(mid, i1, j0, j1)
            else:
                mid = (j0 + j1) // 2
                walk(i0, i1, j0, mid)
                walk(i0, i1, mid, j1)
            return
        if seen is not None:
            seen.append((i1 - i0) * (j1 - j0))
        mask = a.u[i0:i1] @ b.u[j0:j1].T >= cosine
        if same:
            mask &= np.arange(j0, j1) > np.arange(i0, i1)[:, None]
        if not mask.any():
            return
        a.links[i0:i1] += mask @ b.weights[j0:j1]
        b.links[j0:j1] += mask.T @ a.weights[i0:i1]
        x, y = a.rank[i0:i1], b.rank[j0:j1]
        for ranks, roots in zip((x, y), _components(mask, x, y), strict=True):
            moved = roots < ranks
            edges.extend(zip(ranks[moved].tolist(), roots[moved].tolist(), strict=True))

    walk(0, len(a.u), 0, len(b.u))
    return edges


def _join_row(axes: np.ndarray, cosine: float, eps: float, kind: str):
    """One interval (side 0) with itself, if its row says so, and with its partners (side 1)."""

    def run(row: pa.Table) -> pa.Table:
        sides, diagonal = row.column("side").to_pylist(), any(x for x in row.column("diagonal").to_pylist())
        classes, matrices = row.column("classes"), row.column("m")
        keys = [np.frombuffer(x.as_buffer(), "<i8").reshape(4, -1)[:3] for x in classes]
        table = np.concatenate(keys, 1)
        order = np.lexsort(table[::-1])
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        begins = np.cumsum([0, *(k.shape[1] for k in keys)])
        links, root = np.zeros(len(order), np.int64), np.arange(len(order))

        def load(k: int) -> Interval:
            out = Interval(classes[k].as_py(), matrices[k].as_py(), axes, kind)
            out.rank = rank[begins[k] : begins[k + 1]]
            return out

        def find(x: int) -> int:
            while root[x] != x:
                root[x] = root[root[x]]
                x = int(root[x])
            return x

        def connect(edges: list[tuple[int, int]]) -> None:
            for x, y in edges:
                x, y = find(x), find(y)
                if x != y:
                    root[max(x, y)] = min(x, y)

        home = sides.index(0)
        mine = load(home)
        if diagonal:
            connect(join_intervals(mine, mine, cosine, eps))
        for k in range(len(sides)):
            if k != home:
                other = load(k)
                connect(join_intervals(mine, other, cosine, eps))
                links[begins[k] : begins[k + 1]] += other.links
        links[begins[home] : begins[home + 1]] += mine.links
        found = np.flatnonzero(links)
        top = order[[find(int(r)) for r in rank[found]]] if len(found) else found
        columns = [*table[:, found], links[found], *table[:, top]]
        return pa.table([pa.array(c, pa.int64()) for c in columns], ["id", "d1", "d2", "links", "root", "r1", "r2"])

    return run


def _shared(df: DataFrame, classes: DataFrame, count: int, how: str) -> DataFrame:
    return df.join(F.broadcast(classes) if count <= BROADCAST_CLASSES else classes, ["d1", "d2"], how)


def near_duplicate_vectors(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", *, cosine: float = 0.9, tile_counts: list[tuple[int, int]] | None = None) -> DataFrame:
    """One row per vector: id, ``n_links``, ``component_id``, ``kept``.

    Vectors link at a cosine of at least ``cosine`` in double precision.  Null,
    empty and zero vectors and those with null or non-finite components link
    with nothing; a shorter vector counts as filled up with zeros.  Each row of
    a repeated id is a vector of its own, known by the smallest id of the rows
    that hold the same vector; rows of a null id link with nothing and are kept.
    Ties cannot arise: components are named by their smallest id.  An empty
    table gives no rows; other columns are ignored.  ``tile_counts`` receives
    the pairs of intervals that were joined, and all pairs.
    """
    kind = "<f4" if dict(df.dtypes)[vector_col] == "array<float>" else "<f8"
    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<float>" if kind == "<f4" else "array<double>").alias("v"))
    dim = max(rows.agg(F.max(F.size("v"))).first()[0] or 0, 1)
    eps = math.sqrt(max(0.0, 2 - 2 * cosine)) + SLACK
    steps = Steps()
    units = stage(rows.mapInArrow(_units(dim, kind), "id long, d1 long, d2 long, u binary"), "ego-units")
    solid = units.where("u is not null and id is not null")
    many = steps.stage(solid.groupBy("d1", "d2").agg(F.min("id").alias("rep"), F.count("*").alias("w")).where("w > 1"), "ego-many")
    n_many = many.count()
    lone = _shared(solid, many.select("d1", "d2"), n_many, "left_anti").select(*_KEY, F.lit(1).cast("long").alias("w"), "u")
    first = _shared(solid, many, n_many, "inner").where("id = rep").select(*_KEY, "w", "u").dropDuplicates(["d1", "d2"])
    single = steps.stage(lone.union(first), "ego-single")

    sample = [r["u"] for r in single.orderBy("d1", "d2").select("u").limit(AXES_SAMPLE).collect()]
    m = _unit_matrix(b"".join(sample), dim, kind) if sample else np.zeros((1, dim))
    axes = np.ascontiguousarray(np.linalg.eigh(np.cov(m.T).reshape(dim, dim) if len(m) > 1 else np.eye(dim))[1][:, ::-1])

    # Intervals that tasks can hold, and enough of them that tiles outnumber cores.
    total, cores = single.count(), df.sparkSession.sparkContext.defaultParallelism
    wanted = max(1, math.ceil(total * dim * int(kind[-1]) / INTERVAL_BYTES), min(math.ceil(math.sqrt(2 * cores)), total // LEAST_VECTORS))
    size = max(1, math.ceil(total / wanted))
    grid = [f"c{k}" for k in range(min(GRID_AXES, dim))]
    gridded = single.mapInArrow(_on_grid(axes, eps, kind), "id long, d1 long, d2 long, w long, u binary, " + ", ".join(f"{c} int" for c in grid) + ", p double")
    order = [*grid, "p", *_KEY]
    ordered = gridded.repartitionByRange(wanted, *order).coalesce(wanted).sortWithinPartitions(*order)
    intervals = steps.stage(ordered.mapInArrow(_intervals(axes, size, kind, eps), "i long, classes binary, m binary, blocks array<struct<low:array<double>,high:array<double>,middle:array<double>,radius:double>>"), "ego-intervals")

    # Pairs of intervals that come within eps, by neighbouring cells of the first axis.
    boxes = steps.stage(intervals.select("i", F.explode("blocks").alias("b")).select("i", "b.*"), "ego-blocks")
    cell = lambda c: F.floor(F.col(c)[0] / eps)
    left = boxes.withColumn("cell", F.explode(F.sequence(cell("low") - 1, cell("high") + 1)))
    right = boxes.select(F.col("i").alias("j"), F.col("low").alias("low2"), F.col("high").alias("high2"), F.col("middle").alias("middle2"), F.col("radius").alias("radius2"), F.explode(F.sequence(cell("low"), cell("high"))).alias("cell2"))
    minus = lambda x, y: F.zip_with(x, y, lambda p, q: p - q)
    squares = lambda a: F.aggregate(a, F.lit(0.0), lambda s, x: s + x * x)
    gap = squares(F.zip_with(minus("low", "high2"), minus("low2", "high"), lambda x, y: F.greatest(x, y, F.lit(0.0))))
    near = (gap <= eps * eps + SLACK) & (F.sqrt(squares(minus("middle", "middle2"))) <= F.col("radius") + F.col("radius2") + eps + SLACK)
    tiles = steps.stage(left.join(right, (F.col("cell") == F.col("cell2")) & (F.col("i") <= F.col("j"))).where(near).select("i", "j").distinct(), "ego-tiles")
    kept, n = tiles.count(), intervals.count()
    if tile_counts is not None:
        tile_counts.append((kept, n * (n + 1) // 2))
    row = max(1, min(ROW, kept // (4 * cores)))
    rows_of = steps.stage(tiles.withColumn("g", F.floor((F.row_number().over(Window.partitionBy("i").orderBy("j")) - 1) / row)), "ego-rows")
    body = intervals.select(F.col("i").alias("k"), "classes", "m")
    homes = rows_of.groupBy("i", "g").agg(F.max(F.col("i") == F.col("j")).alias("diagonal"))
    here = homes.join(body, homes.i == body.k).select("i", "g", F.lit(0).alias("side"), "diagonal", "classes", "m")
    there = rows_of.where("i < j").join(body, F.col("j") == body.k).select("i", "g", F.lit(1).alias("side"), F.lit(False).alias("diagonal"), "classes", "m")
    found = steps.stage(here.union(there).groupBy("i", "g").applyInArrow(_join_row(axes, cosine, eps, kind), "id long, d1 long, d2 long, links long, root long, r1 long, r2 long"), "ego-found")

    node = lambda *c: F.struct(*(F.col(x).alias(n) for x, n in zip(c, _KEY, strict=True)))
    labels = connected_components(found.select(node(*_KEY).alias("a"), node("root", "r1", "r2").alias("b")))
    labels = labels.select("id.d1", "id.d2", F.col("component_id.id").alias("root"))
    sums = found.groupBy(*_KEY).agg(F.sum("links").alias("links")).join(labels, ["d1", "d2"], "left")
    per_class = many.join(sums, ["d1", "d2"], "full").select("d1", "d2", (F.coalesce("links", F.lit(0)) + F.coalesce("w", F.lit(1)) - 1).alias("n_links"), F.coalesce("root", "id", "rep").alias("component_id"))
    per_class = stage(per_class, "ego-classes")
    steps.clear()
    out = units.select("id", "d1", "d2").join(per_class, ["d1", "d2"], "left")
    linked = F.col("id").isNotNull()
    out = out.select(F.col("id").alias(id_col), F.when(linked, F.coalesce("n_links", F.lit(0))).otherwise(0).cast("long").alias("n_links"), F.when(linked, F.coalesce("component_id", "id")).alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col(id_col) == F.col("component_id"), F.lit(True)))


#: DuckDB counterpart over ``embeddings`` for a cosine of ``{cosine}``: every pair, and all paths.
SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, CAST(embedding AS DOUBLE[]) AS x FROM embeddings
  WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0 AND len(list_filter(embedding, lambda c: c <> 0)) > 0),
u AS (SELECT vec_id, x, sqrt(list_inner_product(x, x)) AS l FROM v),
e AS (SELECT p.vec_id AS a, q.vec_id AS b FROM u p JOIN u q ON p.vec_id <> q.vec_id AND list_inner_product(p.x, q.x) / (p.l * q.l) >= {cosine}),
reach AS (SELECT a, b FROM e UNION SELECT r.a, t.b FROM reach r JOIN e t ON r.b = t.a),
low AS (SELECT a AS vec_id, min(b) AS b FROM reach GROUP BY 1),
k AS (SELECT a AS vec_id, count(*) AS n FROM e GROUP BY 1)
SELECT vec_id, CAST(coalesce(k.n, 0) AS BIGINT) AS n_links, least(vec_id, coalesce(low.b, vec_id)) AS component_id,
       vec_id = least(vec_id, coalesce(low.b, vec_id)) AS kept
FROM embeddings LEFT JOIN k USING (vec_id) LEFT JOIN low USING (vec_id)
"""
