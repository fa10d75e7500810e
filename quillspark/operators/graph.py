"""Reachability over link tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.plans.scratch import materialize


def reachable(edges: DataFrame, starts: DataFrame, expand: DataFrame | None = None, depth: int = 20) -> DataFrame:
    """``node, depth``: nodes reached from ``starts`` breadth first, each at its least depth.

    ``edges`` is ``src, dst``; only nodes in ``expand`` (all, if none is given)
    are followed.  Cycles end because visited nodes aren't entered again;
    ``depth`` bounds the rounds.  Each round's lineage is cut by a written
    table.
    """
    visited = materialize(starts.select("node").where("node is not null").distinct().withColumn("depth", F.lit(0)), "bfs")
    front = visited
    for level in range(1, depth + 1):
        open_nodes = front if expand is None else front.join(expand, "node", "left_semi")
        step = edges.join(open_nodes.select(F.col("node").alias("src")), "src").select(F.col("dst").alias("node")).where("node is not null").distinct()
        front = materialize(step.join(visited, "node", "left_anti").withColumn("depth", F.lit(level)), "bfs")
        if front.isEmpty():
            break
        visited = visited.unionByName(front)
    return visited
