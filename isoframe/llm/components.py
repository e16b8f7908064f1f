"""Connected components by alternating star contraction, without collecting a component anywhere.

Large-star links every greater neighbour of a node to the least neighbour; small-star does so for the lesser
neighbours (Kiveris et al., "Connected Components in MapReduce and Beyond", 2014). Minima are pre-aggregated
before the shuffle, and the join that hands them back is one that adaptive execution can split by key.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from isoframe.llm.common import cut
from isoframe.sources.store import discard


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m"))
    return both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    moved = down.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.union(least.select("a", F.col("m").alias("b"))).where("a <> b").distinct()


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node that has an edge; root is the least node reachable.

    edges: columns a, b (long). Loops and repeated edges are harmless, null ends are ignored; no edges give no rows.
    """
    now = cut(edges.where("a is not null and b is not null and a <> b").select("a", "b").distinct())
    seen = None
    while True:
        print_of = now.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)")).alias("s")).first()
        if print_of["n"] == 0 or (print_of["n"], print_of["s"]) == seen:
            break
        seen = (print_of["n"], print_of["s"])
        before, now = now, cut(_small_star(_large_star(now)))
        discard(before)
    roots = now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).union(roots)
