"""Connected components of an edge table by contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import kept


def components(edges: DataFrame, folder: str, name: str = "cc") -> DataFrame:
    """``edges``: a, b (long). Returns node, component (its least node) for every node of an edge.

    Each round sends every node to the least of itself and its neighbours and merges the edges of nodes
    that were sent to the same place. A node that stays is a local minimum. A star whose
    hub has the greatest id keeps its leaves for one round, since the hub alone moves; any two rounds at least halve the nodes that still have edges, so the
    rounds are logarithmic and their tables shrink. Each
    round's tables are written to the shared folder. The step to the least neighbour is a min() with
    map-side combining; where a hub's edges make a partition of a join too large, Spark splits it (AQE's skew join).
    """
    edges = kept(edges.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), folder, f"{name}-edges-0")
    moves: list[DataFrame] = []
    while not edges.isEmpty():
        k = len(moves) + 1
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        move = kept(both.groupBy(F.col("a").alias("node")).agg(F.least(F.col("node"), F.min("b")).alias("to")), folder, f"{name}-move-{k}")
        moves.append(move)
        a = move.select(F.col("node").alias("a"), F.col("to").alias("ta"))
        b = move.select(F.col("node").alias("b"), F.col("to").alias("tb"))
        merged = edges.join(a, "a").join(b, "b").filter("ta <> tb").select(F.least("ta", "tb").alias("a"), F.greatest("ta", "tb").alias("b")).distinct()
        edges = kept(merged, folder, f"{name}-edges-{k}")
    if not moves:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
    out = moves[-1].select("node", F.col("to").alias("component"))
    for k in range(len(moves) - 2, -1, -1):
        end = out.select(F.col("node").alias("to"), "component")
        out = kept(moves[k].join(end, "to", "left").select("node", F.coalesce("component", "to").alias("component")), folder, f"{name}-labels-{k}")
    return out
