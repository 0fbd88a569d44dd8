"""Connected components by alternating large-star and small-star steps.

Each step is a few shuffles of the edges, whose number does not grow. The edges are written to the
cluster's shared folder after each step, so a lost executor costs at most one step. The number of steps
grows with the logarithm of the longest path. Nothing but two sums per step reaches the driver.

A node with very many edges, such as the centre of a large group, is dealt in parts: its smallest
neighbour is found by partial aggregation, and the join that ties its other neighbours to it is spread.

Defined cases: null nodes are dropped, loops and repeated edges do no harm, no edges give no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from heddle.llm.textcore import discard, materialize, spread_join, spread_limit


def _large_star(edges: DataFrame, limit: int) -> DataFrame:
    """Tie each larger neighbour of a node to the smallest one."""
    both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    low = both.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n")).select("a", F.least("a", "m").alias("m"), "n")
    return spread_join(both, low, "a", limit).where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()


def _small_star(edges: DataFrame, limit: int) -> DataFrame:
    """Tie each smaller neighbour of a node, and the node itself, to the smallest one. Edges point to the smaller node."""
    low = edges.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n"))
    moved = spread_join(edges, low, "a", limit).where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.union(low.select("a", F.col("m").alias("b"))).distinct()


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) of all nodes that have an edge; the component is its smallest node. Loops and repeated edges do no harm, nulls are dropped."""
    down = edges.select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).where("a <> b").distinct()
    state, last = materialize(down, "edges"), None
    limit = spread_limit(2 * state.count())
    while True:
        after = materialize(_small_star(_large_star(state, limit), limit), "edges")
        discard(state)
        state = after
        now = tuple(state.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if now == last:
            break
        last = now
    roots = state.select(F.col("b").alias("node")).distinct().select("node", F.col("node").alias("component"))
    return state.select(F.col("a").alias("node"), F.col("b").alias("component")).union(roots)
