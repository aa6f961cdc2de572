"""Connected components by alternating star contraction, each round a few joins and a stored table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratiform.llm.frames import stored


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root) for every node with a link to another; root is the smallest node reachable.

    A round links every node's larger neighbours to the smallest one it knows, then all its smaller neighbours; the
    links end as stars. Ends of null and links of a node to itself are ignored. A busy node is one key of a plain
    equi join with a side of one row a node, which AQE splits; the number of rounds grows with the logarithm of the
    longest chain.
    """
    edges = links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).filter("u != v").distinct()
    edges = stored(edges, "links")
    state = None
    while True:
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == state or not now[0]:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(
                edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
            )
        state = now
        both = edges.select(F.col("u").alias("n"), F.col("v").alias("m")).unionByName(edges.select(F.col("v").alias("n"), F.col("u").alias("m")))
        lowest = both.groupBy("n").agg(F.min("m").alias("r")).select("n", F.least("n", "r").alias("r"))
        large = both.filter("m > n").join(lowest, "n").select(F.col("m").alias("u"), F.col("r").alias("v")).distinct()
        smallest = large.groupBy("u").agg(F.min("v").alias("r"))
        rest = large.join(smallest, "u").filter("v != r").select(F.col("v").alias("u"), F.col("r").alias("v"))
        edges = stored(rest.unionByName(smallest.select("u", F.col("r").alias("v"))).distinct(), "links")
