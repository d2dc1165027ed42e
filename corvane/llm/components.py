"""Connected components of an edge table by alternating large-star and small-star joins.

Both operations are a min-aggregate per node and a join back, so a hub is pre-aggregated map-side and its edges may be
split by the adaptive skew join; no adjacency list is ever built. Each round's edges are stored in the shared folder, as they
are read several times. Joins hash the side with one row per node: nothing is sorted, and no key of that side is hot.
After each round the leaves are set aside: a node with a single link, to a smaller node, and none that links to it, has the
component of that node whatever happens to it. So each edge takes part only until it is settled, and rounds end when none
is left; the leaves are then resolved backwards, one join per round.

Cases: loops and repeated edges are ignored; an empty table gives no rows; null ends are dropped.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.session import Stored


def least_neighbour(directed: DataFrame) -> DataFrame:
    return directed.groupBy("u").agg(F.min("v").alias("m"))


def large_star(edges: DataFrame) -> DataFrame:
    """Link every larger neighbour of a node to the least node of its neighbourhood. edges: u > v."""
    both = edges.select(F.explode(F.array(F.struct("u", "v"), F.struct(F.col("v").alias("u"), F.col("u").alias("v")))).alias("e")).select("e.u", "e.v")
    least = least_neighbour(both).select("u", F.least("u", "m").alias("m"))
    return both.where("v > u").join(least.hint("shuffle_hash"), "u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def small_star(edges: DataFrame) -> DataFrame:
    """Link a node and its smaller neighbours to the least of them. edges: u > v."""
    least = least_neighbour(edges)
    moved = edges.join(least.hint("shuffle_hash"), "u").where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select("u", F.col("m").alias("v")))


def connected_components(edges: DataFrame, stored: Stored, most_rounds: int = 60) -> DataFrame:
    """(node, component) for every node of an edge; component is the least node. edges: two BIGINT columns."""
    a, b = edges.columns[:2]
    current = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col("u") != F.col("v")))
    current, path = stored.table(current.distinct())
    leaves: list[DataFrame] = []
    for _ in range(most_rounds):
        starred, star_path = stored.table(small_star(large_star(current)).distinct())
        stored.drop(path)
        marked, _ = stored.table(with_leaves(starred))
        stored.drop(star_path)
        leaves.append(marked.where("leaf").select("u", "v"))
        current, path = marked.where("NOT leaf").select("u", "v"), ""
        if current.isEmpty():
            break
        current, path = stored.table(current)
    else:
        raise RuntimeError(f"components not stable after {most_rounds} rounds")
    labels = None
    for level in reversed(leaves):
        own = level.select(F.col("u").alias("node"), F.col("v").alias("component"))
        if labels is None:
            labels = own
        else:
            above = labels.select(F.col("node").alias("v"), F.col("component").alias("higher"))
            resolved = level.join(above, "v", "left").select(F.col("u").alias("node"), F.coalesce("higher", "v").alias("component"))
            labels = labels.unionByName(resolved)
        labels, _ = stored.table(labels) if level is not leaves[0] else (labels, "")
    return labels.unionByName(labels.select(F.col("component").alias("node"), "component").distinct())


def with_leaves(edges: DataFrame) -> DataFrame:
    """u, v, leaf: whether u has this link only and none links to u."""
    up = edges.groupBy(F.col("u").alias("node")).agg(F.count("*").alias("up"), F.min("v").alias("v"))
    centres = edges.select(F.col("v").alias("node")).distinct().withColumn("down", F.lit(True))
    judged = up.join(centres.hint("shuffle_hash"), "node", "left")
    single = judged.where("up = 1").select(F.col("node").alias("u"), "v", F.col("down").isNull().alias("leaf"))
    several = judged.where("up > 1").select(F.col("node").alias("u"))
    # a node with one link needs no second look at its edges
    return single.unionByName(edges.join(several.hint("shuffle_hash"), "u", "left_semi").withColumn("leaf", F.lit(False)))
