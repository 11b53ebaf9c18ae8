"""Connected components of an edge table, without collecting it.

Edges run from the larger node to the smaller.  A round gives every node u its
smallest neighbour m(u), links u to m(m(u)), and hangs u's other neighbours
below that as well.  Distances halve from round to round, the number of edges
never grows, and the rounds end with one edge from each node to its component's
smallest.  Rounds shuffle edges only, by node, and stage each round's table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .staging import drop_staged, stage


def _oriented(edges: DataFrame) -> DataFrame:
    return edges.where("a is not null and b is not null and a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()


def connected_components(edges: DataFrame, rounds: list[int] | None = None) -> DataFrame:
    """``edges(a, b)`` to ``(id, component_id)`` for every node above its component's smallest.

    Nodes may be of any type that has an order.  Those that are the smallest of
    their component, or have no edge, are left out; self-loops, repeated edges
    and nulls are ignored; an empty table gives no rows.  ``rounds`` receives the
    number of edges of every round.
    """
    now = stage(_oriented(edges), "cc-edges")
    while True:
        low = stage(now.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("c")), "cc-low")
        above = low.select(F.col("u").alias("k"), F.col("m").alias("above"))
        roots = stage(low.join(above, low.m == above.k, "left").select("u", "m", "c", F.coalesce("above", "m").alias("g"), F.col("above").isNotNull().alias("moves")), "cc-roots")
        state = roots.agg(F.sum("c").alias("edges"), F.max("c").alias("most"), F.max("moves").alias("moves")).first()
        if rounds is not None:
            rounds.append(state["edges"] or 0)
        drop_staged(low)
        if not state["moves"] and (state["most"] or 1) == 1:
            drop_staged(roots)
            return now.select(F.col("u").alias("id"), F.col("v").alias("component_id"))
        up = roots.select(F.col("u").alias("k"), "m", "g")
        joined = now.join(up, now.u == up.k)
        after = stage(joined.select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("g").alias("v")).where("u <> v").distinct(), "cc-edges")
        drop_staged(roots)
        drop_staged(now)
        now = after
