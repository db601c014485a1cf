"""Connected components of an edge table, by alternating large and small stars.

Every step is a partial minimum per node and a join back, in which the edges of a hub are dealt to many tasks; edge tables
are written to the shared folder after each step, and nothing but a few sums per step reaches the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, spread_join, written


def _stars(edges: DataFrame, large: bool) -> DataFrame:
    """edges (u, v) with u > v; all rows once."""
    if large:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")).withColumn("m", F.least("m", "u"))
        out = spread_join(both, least, ["u"], "n").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        least = edges.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
        out = spread_join(edges, least, ["u"], "n").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
    return out.filter("u <> v").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(id, label) for every node of the bigint edge table (a, b): the smallest node it is connected with. Loops and repeats do no harm."""
    e = written(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct(), "edges")
    sign = lambda t: tuple(t.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).head())
    mark = sign(e)
    while mark[0]:
        half = written(_stars(e, large=True), "edges")
        both = written(_stars(half, large=False), "edges")
        discard(e, half)
        e, old, mark = both, mark, sign(both)
        if old == mark:
            break
    nodes = e.select(F.col("u").alias("id"), F.col("v").alias("label"))
    return written(nodes.unionByName(e.select(F.col("v").alias("id"), F.col("v").alias("label")).distinct()), "labels")
