"""Connected components of an edge table by contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise, release


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for all nodes of `edges(a, b)`; component is the smallest node reachable.

    In each round every node hooks to its least smaller neighbour (a partial aggregate, so a hub may have any number of neighbours), chains of hooks are
    shortened by pointer jumping, and the edges are renamed to the roots. Edges inside a root vanish and equal ones merge, so the table shrinks
    quickly; the rounds end when no edge is left. Edges and hooks are written to the shared folder in each round.
    """
    pair = lambda a, b: (F.least(a, b).alias("a"), F.greatest(a, b).alias("b"))
    e = materialise(edges.where("a <> b").select(*pair("a", "b")).distinct(), "edges")
    labels = edges.select(F.explode(F.array("a", "b")).alias("node")).distinct().withColumn("component", F.col("node"))
    rounds = []
    while not e.isEmpty():
        first = hooks = materialise(e.groupBy(F.col("b").alias("low")).agg(F.min("a").alias("root")), "hooks")
        for _ in range(2):
            upper = hooks.select(F.col("low").alias("root"), F.col("root").alias("above"))
            hooks = hooks.join(upper, "root", "left").select("low", F.coalesce("above", "root").alias("root"))
        hooks = materialise(hooks, "hooks")
        rounds += [first, hooks, e]
        of_a, of_b = (hooks.select(F.col("low").alias(c), F.col("root").alias(f"r{c}")) for c in "ab")
        renamed = e.join(of_a, "a", "left").join(of_b, "b").select(F.coalesce("ra", "a").alias("a"), F.col("rb").alias("b"))
        e = materialise(renamed.where("a <> b").select(*pair("a", "b")).distinct(), "edges")
        labels = labels.join(hooks.select(F.col("low").alias("component"), "root"), "component", "left").select("node", F.coalesce("root", "component").alias("component"))
    out = materialise(labels, "components")
    release(*rounds, e)
    return out
