"""Connected components of a table of links, by stars that shrink round by round."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.storage import discard, materialize


def _state(edges: DataFrame) -> tuple[int, int]:
    """Number of edges and a sum of their hashes, to see whether a round changed anything."""
    row = edges.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64("a", "b").cast("decimal(20,0)")), F.lit(0))).first()
    return int(row[0]), int(row[1])


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """node, root: for each node with a link, the least node that it reaches.

    Each round every node hands its larger neighbours to its least one, then its smaller ones likewise; about log n
    rounds leave one star per component. A hub's links are rows that any task can hold, its least neighbour a partial
    aggregate. Each round is a stored table. Self links and repeated links don't matter.
    """
    edges = links.select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).filter("a <> b").distinct()
    edges = materialize(edges, "links")
    state = _state(edges)
    while state[0]:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        new = materialize(small.unionByName(least.withColumnRenamed("m", "b")).distinct(), "links")
        discard(edges)
        edges, before, state = new, state, _state(new)
        if state == before:
            break
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
