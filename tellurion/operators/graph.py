"""Connected components of a graph given as edges, by alternating large-star and small-star steps.

Every step is a grouping and a join over the edges; nothing is collected but a
count.  Edges are written to the shared folder after each round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tellurion.sources.scratch import materialise


def components(edges: DataFrame, max_rounds: int = 60, join: str | None = None) -> DataFrame:
    """(node, root) for every node of ``edges`` (columns ``u``, ``v``); root is the smallest node reachable.

    ``join`` is a hint for the joins with a node's least neighbour: "merge" where no node
    has very many edges, so that no round sends its nodes to all tasks.  Without it Spark
    chooses by size.

    Self loops are ignored; no edges give an empty result.  A hub's edges are
    combined before the shuffle for its minimum; the join back is one that Spark
    splits where it is skewed.
    """
    chosen = (lambda d: d.hint(join)) if join else (lambda d: d)
    edges = edges.where("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    edges = materialise(edges, "edges")
    if edges.isEmpty():
        return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
    last = None
    for _ in range(max_rounds):
        # large star: neighbours above a node go to the least of its neighbourhood
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(chosen(least), "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()
        # small star: neighbours at or below a node, and the node, go to the least of them
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(chosen(low), "u")
        small = joined.select(F.col("v").alias("a"), "m").unionByName(low.select(F.col("u").alias("a"), "m"))
        nxt = materialise(small.where("a != m").select(F.col("a").alias("u"), F.col("m").alias("v")).distinct(), "edges")
        state = nxt.agg(F.count(F.lit(1)), F.coalesce(F.bit_xor(F.xxhash64("u", "v")), F.lit(0))).first()
        edges = nxt
        if state == last:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
        last = state
    raise RuntimeError("components did not settle")
