"""Connected components of an edge table, by repeated contraction.

Each round hangs every node under its smallest neighbour, jumps along the paths
to the roots of these trees and rewrites the edges between the roots.  Edges
within a component vanish, so the edge table shrinks geometrically; no group of
neighbours is ever gathered in one task (the minimum is pre-aggregated, hub
joins are ordinary equi-joins that adaptive execution may split).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.plans.staging import drop_staged, stage

MAX_ROUNDS = 64
#: Jumps along the paths between two writes.
HOPS = 3


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Rows ``(node, root)`` for each node with an edge to another node; ``root`` is
    the smallest node of its component.  Null ends, loops and repeats are ignored;
    nodes without any edge do not appear."""
    e = edges.select(F.col(a).alias("a"), F.col(b).alias("b")).where("a <> b")
    e = stage(e.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    levels: list[DataFrame] = []
    for _ in range(MAX_ROUNDS):
        if e.isEmpty():
            break
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        up = both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m"))
        up = up.select("node", F.least("node", "m").alias("up"))
        up = stage(up, "parents")
        while True:  # to the roots: each round of jumps divides the paths by HOPS + 1
            jumped = up.select("node", F.col("up").alias("p0"))
            for i in range(HOPS):
                hop = up.select(F.col("node").alias("n"), F.col("up").alias(f"p{i + 1}"))
                jumped = jumped.join(hop, F.col(f"p{i}") == F.col("n")).drop("n")
            jumped = jumped.select("node", F.col(f"p{HOPS}").alias("up"), (F.col(f"p{HOPS - 1}") != F.col(f"p{HOPS}")).alias("moved"))
            jumped = stage(jumped, "parents")
            drop_staged(up)
            up = jumped
            if up.where("moved").isEmpty():
                break
        up = up.drop("moved")
        levels.append(up)
        left = up.select(F.col("node").alias("a"), F.col("up").alias("ra"))
        right = up.select(F.col("node").alias("b"), F.col("up").alias("rb"))
        nxt = e.join(left, "a").join(right, "b").where("ra <> rb")
        nxt = stage(nxt.select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")).distinct(), "edges")
        drop_staged(e)
        e = nxt
    else:
        raise RuntimeError(f"components did not settle in {MAX_ROUNDS} rounds")
    if not levels:
        return e.select(F.col("a").alias("node"), F.col("b").alias("root"))
    found = levels[0].select("node", F.col("up").alias("root"))
    for up in levels[1:]:
        step = up.select(F.col("node").alias("root"), "up")
        found = found.join(step, "root", "left").select("node", F.coalesce("up", "root").alias("root"))
    return found
