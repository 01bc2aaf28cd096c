"""Connected components of a link table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.llm.shared import cut, forget, join_hot


def components(links: DataFrame, max_rounds: int = 64) -> DataFrame:
    """node, root (the smallest node reachable) for every node of links (a, b).

    Alternates large-star and small-star rewriting until no edge changes: every round
    replaces each node's neighbours by links to the smallest of them, so the number of
    edges doesn't grow and rounds grow with the logarithm of the longest chain. A node's
    smallest neighbour is aggregated before the shuffle, and comes to the links of a hub by
    broadcast, so no task holds a component or all links of a node. Loops and repeated
    links count once, null nodes aren't linked, and an empty table gives an empty table.
    """
    edges = cut(links.filter(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    before, n = None, edges.count()
    for _ in range(max_rounds):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        large = join_hot(both.filter("v > u"), least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = cut(large.filter("u <> v").distinct(), 2 * n)
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = join_hot(large, least, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.*")
        done, edges = edges, cut(small.filter("u <> v").distinct(), 2 * n)
        forget(done, large)
        state = edges.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if before == state:
            break
        before, n = state, state.n
    else:
        raise RuntimeError(f"components didn't settle in {max_rounds} rounds")
    roots = edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    out = cut(edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots), 2 * n)
    forget(edges)
    return out
