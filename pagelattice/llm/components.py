"""Connected components by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagelattice.llm.common import delete, written


def _large_star(edges: DataFrame) -> DataFrame:
    """Links each node's larger neighbours to the smallest node around it. edges: hi > lo."""
    both = edges.select(F.col("hi").alias("u"), F.col("lo").alias("v")).union(edges.select("lo", "hi"))
    least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("hi"), F.col("m").alias("lo")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Links each node and its smaller neighbours to the smallest of these."""
    least = edges.groupBy("hi").agg(F.min("lo").alias("m"))
    moved = edges.join(least, "hi").where("lo <> m").select(F.col("lo").alias("hi"), F.col("m").alias("lo"))
    return moved.union(least.select("hi", F.col("m").alias("lo"))).distinct()


def connected_components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """(id, component) of every node in `edges`, component being the smallest node that links reach; edges with a null end and loops count for nothing.

    A node's neighbours are never gathered: each step takes minima by key, which are combined before they are shuffled, and joins
    them back. Each round is written to the shared folder, and the one before it deleted; rounds end when a round changes nothing, after about log2 of the longest path.
    """
    now = edges.select(F.greatest(a, b).alias("hi"), F.least(a, b).alias("lo")).where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b))).distinct()
    now = written(now, "components")
    state = None
    while True:
        found = now.agg(F.count("*").alias("n"), F.sum(F.xxhash64("hi", "lo").cast("decimal(38,0)")).alias("h")).first()
        if state == found or not found["n"]:
            break
        state = found
        before, now = now, written(_small_star(_large_star(now)), "components")
        delete(before)
    return now.select(F.col("hi").alias("id"), F.col("lo").alias("component")).union(now.select("lo", "lo").distinct())
