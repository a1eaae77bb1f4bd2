"""Connected components of an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from agoradesk.llm.shared import write_stage


def components(edges: DataFrame) -> DataFrame:
    """(node, component): the smallest node that can be reached, for every node of ``edges`` (columns a, b; nulls are dropped).

    Each round every node takes the smallest of its neighbours and itself as its name and the edges are renamed, so the graph shrinks
    to its components' minima; stars end after one round, chains after a number of rounds in the logarithm of their length. A node
    with very many edges is only ever one side of a join, which adaptive execution splits, or a key of a pre-aggregated minimum.
    """
    left = write_stage(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    names = None
    while not left.isEmpty():
        both = left.unionAll(left.select(F.col("b").alias("a"), F.col("a").alias("b")))
        step = both.groupBy("a").agg(F.min("b").alias("lowest")).select(F.col("a").alias("node"), F.least("a", "lowest").alias("name"))
        step = write_stage(step, "names")
        if names is None:
            names = step.withColumnRenamed("name", "component")
        else:
            moved = names.join(step.withColumnsRenamed({"node": "component", "name": "next"}), "component", "left")
            names = write_stage(moved.select("node", F.coalesce("next", "component").alias("component")), "components")
        one = left.join(step.withColumnsRenamed({"node": "a", "name": "x"}), "a").select("b", "x")
        two = one.join(step.withColumnsRenamed({"node": "b", "name": "y"}), "b").where("x <> y")
        left = write_stage(two.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), "edges")
    return names if names is not None else left.select(F.col("a").alias("node"), F.col("b").alias("component"))
