"""Connected components of a table of links, by random contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seriesloom.llm.common import written


def components(links: DataFrame) -> DataFrame:
    """`node` and `component` (smallest node reachable) for every node of links (a, b).

    In each round a node joins the neighbour (or itself) of least hash, the hash being new
    in every round; links between merged nodes fall away, so a constant share of the nodes
    goes in each round. All steps are grouped minima and joins by node; a node with very
    many links is summed up on the map side. Each round is written, so losing an executor
    costs one round's read.
    """
    edges = written(links.where("a <> b").select("a", "b").distinct(), "links")
    labels = edges.select(F.col("a").alias("node")).union(edges.select("b")).distinct().withColumn("label", F.col("node"))
    turn = 0
    while not edges.isEmpty():
        both = edges.union(edges.select("b", "a"))
        hashed = F.xxhash64("b", F.lit(turn))
        least = both.groupBy("a").agg(F.min(F.struct(hashed.alias("h"), F.col("b"))).alias("m"))
        into = written(
            least.select(
                F.col("a").alias("was"),
                F.when(F.col("m.h") < F.xxhash64("a", F.lit(turn)), F.col("m.b")).otherwise(F.col("a")).alias("now"),
            ),
            "into",
        )
        left = into.select(F.col("was").alias("a"), F.col("now").alias("x"))
        right = into.select(F.col("was").alias("b"), F.col("now").alias("y"))
        edges = written(
            edges.join(left, "a").join(right, "b").where("x <> y")
            .select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(),
            "links",
        )
        labels = labels.join(into, F.col("label") == F.col("was"), "left").select(
            "node", F.coalesce("now", "label").alias("label")
        )
        turn += 1
        if turn % 4 == 0:
            labels = written(labels, "labels")
    labels = written(labels, "labels")
    smallest = labels.groupBy("label").agg(F.min("node").alias("component"))
    return labels.join(smallest, "label").select("node", "component")
