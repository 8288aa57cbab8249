"""Connected components of a link table, with links and labels kept in Spark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewater.llm.storage import materialize


def local_forest(a, b, n: int):
    """Links a[i]-b[i] among n nodes as a star (node, root) for each node that isn't a root.

    A helper for one task's links: numpy arrays in, numpy arrays out.
    """
    import numpy as np

    parent = np.arange(n)
    while True:
        low = np.minimum(parent[a], parent[b])
        np.minimum.at(parent, a, low)
        np.minimum.at(parent, b, low)
        np.minimum.at(parent, parent[a], low)
        np.minimum.at(parent, parent[b], low)
        jumped = parent[parent]
        while (jumped != parent).any():
            parent, jumped = jumped, jumped[jumped]
        if (parent[a] == parent[b]).all():
            break
    node = np.flatnonzero(parent != np.arange(n))
    return node, parent[node]


def _with_least(rows: DataFrame, by_node: DataFrame, most: int) -> DataFrame:
    """``rows`` (u, v) with m of their u, of ``by_node`` (u, m, n).

    A node of more than ``most`` rows is looked up in a broadcast table: there are
    fewer such nodes than rows / ``most``, whatever the links, and their rows stay
    where they are. All others meet by a shuffle.
    """
    hubs = by_node.where(F.col("n") > most).select("u", F.col("m").alias("hub"))
    marked = rows.join(F.broadcast(hubs), "u", "left")
    rest = marked.where("hub is null").drop("hub").join(by_node.where(F.col("n") <= most).select("u", "m"), "u")
    return marked.where("hub is not null").withColumnRenamed("hub", "m").unionByName(rest)


def components(links: DataFrame, a: str = "a", b: str = "b", rounds: int = 60) -> DataFrame:
    """(node, component) for every node of ``links``; component is the smallest node reachable.

    Alternates large-star and small-star steps, each a map-side combined minimum
    that links look up, until every node has one link, to a node that has none. What
    goes to the driver is two counts a round. A node with a large part of all links
    is no key of a shuffled row: see _with_least, whose broadcast holds at most
    10,000 nodes. Rows with a null end are no links; an
    empty table gives no rows.
    """
    edges = links.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    edges = materialize(edges, "links")
    for _ in range(rounds):
        ends = edges.select(F.col("u").alias("node"), F.lit(1).alias("below"), F.lit(0).alias("above")).union(edges.select("v", F.lit(0), F.lit(1)))
        ends = ends.groupBy("node").agg(F.sum("below").alias("below"), F.max("above").alias("above"))
        if not ends.where("below > 1 or (below = 1 and above = 1)").count():
            break
        most = max(100, edges.count() // 5_000)
        back = edges.select(F.col("v").alias("u"), F.col("u").alias("v"))
        low = edges.union(back).groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"), F.count("*").alias("n"))
        large = _with_least(back, low, most).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        large = materialize(large, "links")
        low = large.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
        small = _with_least(large, low, most).where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = materialize(small.union(low.select("u", F.col("m").alias("v"))).distinct(), "links")
    else:
        raise RuntimeError(f"links did not settle in {rounds} rounds")
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).union(edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
