"""Connected components of a table of edges, without gathering it anywhere."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairloom.session import Scratch


def components(edges: DataFrame, scratch: Scratch | None = None) -> DataFrame:
    """(node, root) for every node of ``edges`` (a, b); the root is the smallest node reachable.
    Nodes are of any type that orders. Each round maps every node to the smallest of its
    neighbourhood, jumps once more, and contracts the edges; paths shrink by a factor in every round,
    so there are about as many rounds as the logarithm of the longest path. The rounds are written
    out, and only a count comes to the driver. The tables of the rounds belong to ``scratch``: the
    result must be written before that is cleared."""
    settle = (scratch or Scratch(edges.sparkSession)).settle
    edges = settle(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "cc-edges")
    nodes = edges.select(F.col("a").alias("node")).union(edges.select("b")).distinct()
    roots = nodes.select("node", F.col("node").alias("root"))
    while not edges.isEmpty():
        both = edges.select("a", "b").union(edges.select("b", "a"))
        least = both.groupBy("a").agg(F.min("b").alias("b")).select(F.col("a").alias("node"), F.least("a", "b").alias("up"))
        least = settle(least, "cc-least")
        jump = least.select(F.col("node").alias("mid"), F.col("up").alias("top"))
        up = least.join(jump, least["up"] == jump["mid"]).select("node", "top")
        up = settle(up, "cc-up")
        roots = roots.join(up.withColumnRenamed("node", "root"), "root", "left").select("node", F.coalesce("top", "root").alias("root"))
        roots = settle(roots, "cc-roots")
        left, right = up.select(F.col("node").alias("a"), F.col("top").alias("ta")), up.select(F.col("node").alias("b"), F.col("top").alias("tb"))
        moved = edges.join(left, "a").join(right, "b").where("ta <> tb")
        edges = settle(moved.select(F.least("ta", "tb").alias("a"), F.greatest("ta", "tb").alias("b")).distinct(), "cc-edges")
    return roots
