"""Connected components over a table of links, by contraction; nothing is collected."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, settle


def _flattened(parents: DataFrame) -> DataFrame:
    """Pointer jumping until every node points at its root."""
    while True:
        up = parents.select(F.col("u").alias("p"), F.col("p").alias("root"))
        jumped = settle(
            parents.join(up, "p", "left").select("u", F.coalesce("root", "p").alias("p"), (F.col("root") != F.col("p")).alias("moved"))
        )
        moved = jumped.where("moved").limit(1).count()
        discard(parents.sparkSession, parents)
        parents = jumped.select("u", "p")
        if not moved:
            return parents


def connected_components(links: DataFrame) -> DataFrame:
    """``(id, component)`` of every id in the links ``(a, b)``; the component is its smallest id.

    Each round points every node at its smallest neighbour (or itself), flattens the trees, and contracts the links to
    links between roots.  At least half of the nodes that still have links go away in a round.
    """
    spark = links.sparkSession
    edges = settle(links.where("a != b").select("a", "b").distinct())
    labels = None
    while edges.limit(1).count():
        both = edges.union(edges.select("b", "a"))
        nearest = both.groupBy(F.col("a").alias("u")).agg(F.min("b").alias("p"))
        parents = _flattened(settle(nearest.select("u", F.least("u", "p").alias("p"))))
        if labels is None:
            merged = parents.select(F.col("u").alias("id"), F.col("p").alias("component"))
        else:
            merged = settle(
                labels.join(parents, F.col("component") == F.col("u"), "left").select(
                    "id", F.coalesce("p", "component").alias("component")
                )
            )
            discard(spark, labels)
        left = parents.select(F.col("u").alias("a"), F.col("p").alias("x"))
        right = parents.select(F.col("u").alias("b"), F.col("p").alias("y"))
        contracted = settle(
            edges.join(left, "a").join(right, "b").where("x != y")
            .select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()
        )
        discard(spark, edges)
        labels, edges = merged, contracted
    if labels is None:
        labels = edges.select(F.col("a").alias("id"), F.col("b").alias("component"))
    return labels
