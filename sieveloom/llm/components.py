"""Connected components by alternating large-star and small-star steps (Kiveris et al., 2014)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sieveloom.llm.common import drop_stash, stash


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root) for every node on an edge; root is the smallest node of its component.

    A step joins the edges with the least neighbour of each node, and its result is written to the
    shared folder. The number of steps grows with the logarithm of the diameter.
    Null ends, loops and repeated edges don't count.
    """
    e = (
        edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"), F.col(a).alias("x"), F.col(b).alias("y"))
        .where("x is not null and y is not null and u <> v")
        .select("u", "v")
        .distinct()
    )
    e, before = stash(e), None
    least = lambda e: e.groupBy("u").agg(F.min("v").alias("m"))  # noqa: E731  # combined before it is sent, so that a hub is no hot key
    while True:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = both.where("v > u").join(least(both), "u").select(F.col("v").alias("u"), F.least("u", "m").alias("v")).distinct()
        small = large.join(least(large), "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("p")).select("p.u", "p.v").where("u <> v").distinct()
        new = stash(small)
        state = new.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        drop_stash(e)
        e = new
        if state == before:
            break
        before = state
    return e.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
