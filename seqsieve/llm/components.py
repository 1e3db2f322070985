"""Connected components of an edge table by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import written


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of edges(a long, b long): root is the smallest node of its component.

    Each round replaces edges by edges to smaller nodes; hubs cost a partial minimum and a join that Spark can split.
    Self loops and repeated or reversed edges do no harm. Each round's edges are a written table.
    """
    # An edge points from its larger node u to its smaller node v.
    directed = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct()
    now, state = _saved(directed)
    while True:
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = now.select(F.col("v").alias("u"), F.col("u").alias("w")).join(least, "u").select(F.col("w").alias("u"), F.col("m").alias("v"))
        large, _ = _saved(large.distinct())
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        after, later = _saved(small.union(least.select("u", F.col("m").alias("v"))).distinct())
        if later == state:
            break
        now, state = after, later
    roots = after.groupBy("u").agg(F.min("v").alias("root")).select(F.col("u").alias("node"), "root")
    return roots.union(roots.select(F.col("root").alias("node"), "root").distinct())


def _saved(edges: DataFrame):
    table = written(edges, "edges")
    row = table.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    return table, tuple(row)
