"""Sets of names that edges join, without gathering them: every name learns the least name it is joined with."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .session import kept


def union_labels(edges: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """(keys, name, label) for every name of edges (keys, a, b), which only join names of equal keys; loops and repeats do no harm.

    A round hooks each name to the least of its smaller neighbours, follows these hooks to their ends by doubling, and goes on with
    the edges between the ends. At least every name that has a smaller neighbour is hooked, so few rounds are needed,
    and edge tables shrink. All tables are written to the shared folder; only their emptiness is asked for.
    """
    by = list(keys)
    edge = lambda a, b: [*by, F.greatest(a, b).alias("a"), F.least(a, b).alias("b")]
    left = kept(edges.filter("a <> b").select(*edge("a", "b")).distinct(), "edges")
    names = left.select(*by, F.col("a").alias("name")).unionByName(left.select(*by, F.col("b").alias("name")))
    labels = kept(names.distinct().withColumn("label", F.col("name")), "labels")
    while not left.isEmpty():
        hooks = kept(left.groupBy(*by, "a").agg(F.min("b").alias("to")), "hooks")
        while True:  # a name is hooked to a smaller one, so there are no cycles
            next_ = hooks.select(*by, F.col("a").alias("to"), F.col("to").alias("next"))
            moved = kept(hooks.join(next_, [*by, "to"], "left").select(*by, "a", F.coalesce("next", "to").alias("to"), F.col("next").isNotNull().alias("moved")), "hooks")
            hooks = moved.drop("moved")
            if moved.filter("moved").isEmpty():
                break
        end_a, end_b = (hooks.select(*by, F.col("a").alias(c), F.col("to").alias(f"end_{c}")) for c in ("a", "b"))
        ends = left.join(end_a, [*by, "a"], "left").join(end_b, [*by, "b"], "left").select(*by, F.coalesce("end_a", "a").alias("x"), F.coalesce("end_b", "b").alias("y"))
        left = kept(ends.filter("x <> y").select(*edge("x", "y")).distinct(), "edges")
        of_label = hooks.select(*by, F.col("a").alias("label"), "to")
        labels = kept(labels.join(of_label, [*by, "label"], "left").select(*by, "name", F.coalesce("to", "label").alias("label")), "labels")
    return labels
