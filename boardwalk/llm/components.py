"""Connected components by contraction: each round joins every node to its smallest neighbour and
replaces the edges by those between what remains. Nothing is collected; the driver only sees
whether edges are left."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from boardwalk.session import stored


def components(edges: DataFrame) -> DataFrame:
    """``(a, b)`` edges to ``(id, root)``: every node of an edge with the smallest id it reaches.

    Edges may repeat, name a node twice, or hold nulls (ignored). Nodes without edges are not in
    the result. The number of rounds grows with the logarithm of the longest chain.
    """
    both = edges.select(F.col("a").alias("src"), F.col("b").alias("dst")).filter("src <> dst")
    left = stored(both.unionByName(both.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
                  .distinct())
    roots = None
    while True:
        near = left.groupBy("src").agg(F.least(F.col("src"), F.min("dst")).alias("root"))
        jumped = stored(near.alias("x").join(near.alias("y"), F.col("x.root") == F.col("y.src"))
                        .select(F.col("x.src").alias("id"), F.col("y.root").alias("root")))
        if roots is None:
            roots = jumped
        else:
            up = jumped.select(F.col("id").alias("root"), F.col("root").alias("upper"))
            roots = stored(roots.join(up, "root", "left")
                           .select("id", F.coalesce("upper", "root").alias("root")))
        src = jumped.select(F.col("id").alias("src"), F.col("root").alias("src_root"))
        dst = jumped.select(F.col("id").alias("dst"), F.col("root").alias("dst_root"))
        left = stored(left.join(src, "src").join(dst, "dst").filter("src_root <> dst_root")
                      .select(F.col("src_root").alias("src"), F.col("dst_root").alias("dst"))
                      .distinct())
        if left.isEmpty():
            return roots
