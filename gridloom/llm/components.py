"""Connected components of a graph held in a DataFrame."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.sources.tables import drop, materialize, written


def _to_least(pairs: DataFrame) -> DataFrame:
    """(u, v) with m, the least of u and its neighbours. Grouping combines before it shuffles, so a hub costs no large task;
    the join back is one whose large partitions Spark splits at run time."""
    least = pairs.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return pairs.join(least, "u")


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges(a long, b long)``: root is the least node that it reaches.

    Alternates large-star and small-star steps, which end in stars after about log(n) rounds. Each round is written to the
    shared folder, the one before goes. Nothing but two sums a round comes to the driver. No edges: no rows. Loops and repeats change nothing.
    """
    edges = materialize(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    mark, held = None, set()
    while True:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _to_least(both).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        small = _to_least(large)
        star = small.select(F.col("v").alias("u"), F.col("m").alias("v")).union(small.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        old = written()
        edges = materialize(star)
        if held:
            drop(held)
        held = written() - old
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).head()
        if tuple(now) == mark:
            break
        mark = tuple(now)
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).union(edges.select(F.col("v").alias("node"), F.col("v").alias("root"))).distinct()
