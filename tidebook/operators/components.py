"""Connected components of a graph given by its edges, without collecting any of it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidebook.session import drop_written, written


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) for every end of an edge; the component is its smallest node.

    Nodes have a fixed random order. In each round every node that has a lower neighbour is merged into the lowest, and
    the edges between what remains go on; a fraction of the nodes goes each round, so the rounds grow with the logarithm
    of the graph. Each round reads a written table, so that lost executors cost no more than a round. A hub's edges are
    aggregated before they are shuffled, and joins on a hub split under adaptive execution.

    Tables of earlier rounds are deleted. Edges with a null end and loops are ignored; repeated edges count once; without edges there are no rows.
    """
    order = lambda c: F.xxhash64(F.lit(17), c)
    left = written(
        edges.select(F.least(a, b).cast("long").alias("a"), F.greatest(a, b).cast("long").alias("b"))
        .where(F.col("a").isNotNull() & (edges[a] != edges[b]) & edges[a].isNotNull() & edges[b].isNotNull())
        .distinct(),
        "edges",
    )
    found = written(left.select(F.explode(F.array("a", "b")).alias("node")).distinct().withColumn("at", F.col("node")), "found")
    while not left.isEmpty():
        both = left.select(F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))).alias("e")).select("e.a", "e.b")
        lowest = both.groupBy("a").agg(F.min(F.struct(order(F.col("b")).alias("o"), F.col("b").alias("into"))).alias("m"))
        merged = written(lowest.where((F.col("m.o") < order(F.col("a"))) | ((F.col("m.o") == order(F.col("a"))) & (F.col("m.into") < F.col("a")))).select(F.col("a").alias("was"), F.col("m.into").alias("into")), "merged")
        before, found = found, written(found.join(merged, found["at"] == merged["was"], "left").select("node", F.coalesce("into", "at").alias("at")), "found")
        first = merged.select(F.col("was").alias("was_a"), F.col("into").alias("into_a"))
        second = merged.select(F.col("was").alias("was_b"), F.col("into").alias("into_b"))
        moved = left.join(first, F.col("a") == F.col("was_a"), "left").join(second, F.col("b") == F.col("was_b"), "left")
        moved = moved.select(F.coalesce("into_a", "a").alias("x"), F.coalesce("into_b", "b").alias("y")).where("x <> y")
        edges, left = left, written(moved.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), "edges")
        drop_written(before, merged, edges)
    drop_written(left)
    least = found.groupBy("at").agg(F.min("node").alias("component"))
    return found.join(least, "at").select("node", "component")
