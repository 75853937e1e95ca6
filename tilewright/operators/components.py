"""Connected components of a graph given as a table of edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tilewright.session import Scratch


def connected(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """(v, root) for every vertex of edges(a, b); root is some vertex of its component, the same for all of it.

    Each round every vertex hangs itself from its least neighbour if that is smaller; pointers are doubled until they end at
    local minima, and the edges are drawn again between those. At most half of the vertices are left each time. Hubs are
    pre-aggregated; a vertex with most edges is split by adaptive execution. Pairs of equal vertices don't matter.
    """
    both = lambda d: d.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(d.select(F.col("b").alias("u"), F.col("a").alias("v")))
    left = scratch.write(both(edges.filter("a != b")).distinct())
    hung: list[DataFrame] = []
    while left.limit(1).count():
        up = scratch.write(left.groupBy("u").agg(F.least(F.first("u"), F.min("v")).alias("p")).withColumnRenamed("u", "v"))
        while True:
            above = up.select(F.col("v").alias("p"), F.col("p").alias("q"))
            nxt = scratch.write(up.join(above, "p").select("v", F.col("q").alias("p"), (F.col("q") != F.col("p")).alias("moved")))
            more = nxt.filter("moved").limit(1).count()
            scratch.drop(up)
            up = nxt.drop("moved")
            up._tilewright_path = nxt._tilewright_path
            if not more:
                break
        hung.append(up)
        root = lambda c: up.select(F.col("v").alias(c), F.col("p").alias(f"r{c}"))  # noqa: E731, B023
        now = scratch.write(left.join(root("u"), "u").join(root("v"), "v").filter("ru != rv").select(F.col("ru").alias("u"), F.col("rv").alias("v")).distinct())
        scratch.drop(left)
        left = now
    if not hung:
        return edges.select(F.col("a").alias("v"), F.col("b").alias("root")).limit(0)
    out = hung[0]
    for later in hung[1:]:
        out = scratch.write(out.join(later.select(F.col("v").alias("p"), F.col("p").alias("q")), "p", "left").select("v", F.coalesce("q", "p").alias("p")))
    return out.withColumnRenamed("p", "root")
